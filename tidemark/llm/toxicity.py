"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, mix, span_hashes, text_chunks, tidy, word_spans
from .shared import drop_tables, write_table

#: Labelled rows that the classifier is learned from; the smallest hashes of doc_id.
SAMPLE = 8_000
#: How often a label is right: on the labelled rows it is one more voter, apart from the tree.
LABEL_TRUST = 0.95
#: Terms that voters know, and features of the classifier, by evidence: what goes to the driver.
MOST_TERMS, MOST_FEATURES = 20_000, 20_000
#: Candidate terms up to this many go to all executors; more of them are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Labelled ids up to this many go to all executors to meet their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is a term that a row has so many times at least; the last one, if that is also once
#: in so many of its words.
LEVELS, DENSE = (1, 2, 4, 2), 100
#: A mined term is in so many toxic labelled rows; the lower bound of its log odds over the base
#: rate tells its voter.
LEAST_ROWS, STRENGTHS = 4, (1.5, 2.0, 2.5, 3.0, 3.75)

# General insults of four languages, by what they aim at.
LEXICONS = (
    "idiot moron stupid dumb imbecile fool dummkopf trottel idiota imbécil estúpido tonto crétin imbécile",
    "scum trash garbage vermin filth abschaum müll ordure déchet basura escoria",
    "worthless pathetic loser useless failure wertlos versager minable raté inútil patético perdedor",
    "disgusting clown ugly creep freak ekelhaft widerlich dégoûtant asqueroso payaso",
)
#: Mined terms vote by kind (a word, a beginning, either one repeated) and strength.
KINDS = 3
VOTERS = len(LEXICONS) + KINDS * len(STRENGTHS) + 3
_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[65:91] = False
_GAP[128:] = False


def word_key(word: str) -> np.uint64:
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, whether a whole word) of all words and word beginnings in a chunk, as often as
    they stand there, and the number of words of each row."""
    low = LOWER[data]
    starts, ends, head = word_spans(low, offsets, _GAP)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(head))
    rows, keys, whole = [row], [span_hashes(low, starts, ends)], [np.ones(len(row), bool)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        keys.append(mix(span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)))
        whole.append(np.zeros(int(long.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(whole), np.diff(head)


def feature_key(key: np.ndarray, level: int) -> np.ndarray:
    return mix(key + np.uint64(0x632BE59BD9B4E019 * level % 2**64)) if level else key


def _levels(row: np.ndarray, key: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, level) of distinct (row, key) that stand there n times."""
    rows, keys, levels = [], [], []
    for level, least in enumerate(LEVELS):
        hit = n >= least
        if level == len(LEVELS) - 1:
            hit &= n * DENSE >= words[row]
        rows.append(row[hit])
        keys.append(feature_key(key[hit], level))
        levels.append(np.full(int(hit.sum()), level))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(levels)


def _counted(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), how often each stands there, and the index of a first one."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return r[at], k[at], np.diff(np.append(at, len(k))), order[at]


def _find(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index into the sorted ``known`` of each key, -1 if it isn't there."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


@dataclass
class Terms:
    """Sorted feature keys and the voter that each belongs to, and the sorted keys of their terms."""

    keys: np.ndarray
    voter: np.ndarray
    bases: np.ndarray


def _known_features(data: np.ndarray, offsets: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the terms ``bases`` in a chunk, each once a row."""
    rows, keys, _, words = _terms(data, offsets)
    hit = _find(keys, bases) >= 0
    row, key, n, _ = _counted(rows[hit], keys[hit])
    return _levels(row, key, n, words)[:2]


def votes(column: pa.Array, terms: Terms) -> np.ndarray:
    """Bit mask of the voters that call each row toxic."""
    out = np.zeros(len(column), np.int64)
    for first, last, data, offsets in text_chunks(column):
        out[first:last] = _votes(data, offsets, *_known_features(data, offsets, terms.bases), terms)
    return out


def _votes(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, keys: np.ndarray, terms: Terms) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    at = _find(keys, terms.keys)
    rows, voter = rows[at >= 0], terms.voter[at[at >= 0]]
    np.bitwise_or.at(out, rows, np.int64(1) << voter)
    running = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    of = lambda total: total[offsets[1:]] - total[offsets[:-1]]
    upper, bang, letters = running((data >= 65) & (data < 91)), running(data == 33), running(~_GAP[data])
    shout = (of(upper) > 0.6 * np.maximum(of(letters), 1)) & (of(letters) >= 20)
    excited = of(bang) * 40 > np.maximum(np.diff(offsets), 1)
    several = np.bincount(rows[voter < len(LEXICONS)], minlength=len(out)) >= 2
    for bit, mask in enumerate((shout, excited, several)):
        out |= mask.astype(np.int64) << (VOTERS - 3 + bit)
    return out


def _tallied(rows: DataFrame, weight: Column) -> DataFrame:
    """(feature, base, level, word, n, w): in how many of ``rows`` (text) each feature is, and the
    sum of their weights; added up by task and then by feature."""

    def tally(batches):
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_chunks(batch.column(0)):
                rows, keys, whole, words = _terms(data, offsets)
                row, key, n, at = _counted(rows, keys)
                index = np.arange(len(key))
                row_, feature, level = _levels(row, key, n, words)
                base = np.concatenate([index[n >= least] if lv < len(LEVELS) - 1 else index[(n >= least) & (n * DENSE >= words[row])] for lv, least in enumerate(LEVELS)])
                found, start, place = np.unique(feature, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)), pa.array(key[base[start]].view(np.int64)), pa.array(level[start], pa.int32()), pa.array(whole[at[base[start]]]),
                        pa.array(np.bincount(place), pa.int64()), pa.array(np.bincount(place, weights[first + row_])),
                    ],
                    ["feature", "base", "level", "word", "n", "w"],
                )

    made = rows.select("text", weight.cast("double").alias("weight")).mapInArrow(tidy(tally), "feature long, base long, level int, word boolean, n long, w double")
    return made.groupBy("feature").agg(F.first("base").alias("base"), F.first("level").alias("level"), F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("w").alias("w"))


def toxic_terms(labelled: DataFrame, toxic: int, others: int, most: int = MOST_TERMS) -> DataFrame:
    """(feature, base, level, word, strength) of the features that toxic rows of ``labelled``
    (toxic, text) have more often than others: what counts is the lower bound (Wilson's, of two
    standard errors) of the share of toxic rows, as log odds over the base rate, so a term need
    not be pure, only certain. The ``most`` with the highest bounds."""
    bad = write_table(_tallied(labelled.where("toxic = 1"), F.lit(1.0)).where(F.col("n") >= LEAST_ROWS), "terms")
    keys = bad.select("feature")
    clean = _tallied(labelled.where("toxic = 0"), F.lit(0.0)).select("feature", F.col("n").alias("good"))
    joined = bad.join(clean.join(F.broadcast(keys) if keys.count() <= BROADCAST_TERMS else keys, "feature", "left_semi"), "feature", "left")
    n = F.col("n") + F.coalesce("good", F.lit(0))
    share, z = F.col("n") / n, 2.0
    least = (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    odds = F.log(least / (1 - least)) - float(np.log(toxic / others))
    strong = joined.withColumn("strength", odds).where(F.col("strength") >= STRENGTHS[0])
    return strong.select("feature", "base", "level", "word", "strength").orderBy(F.desc("strength"), "feature").limit(most)


def mined(found) -> Terms:
    """Fixed lexicons and the mined terms (:func:`toxic_terms`, as pandas) with their voters."""
    key, voter, base = [], [], []
    for number, words in enumerate(LEXICONS):
        for word in words.split():
            key.append(word_key(word))
            voter.append(number)
            base.append(word_key(word))
    key, voter, base = np.array(key, np.uint64), np.array(voter, np.int64), np.array(base, np.uint64)
    own = found["feature"].to_numpy(np.int64).view(np.uint64)
    kind = np.where(found["level"].to_numpy(np.int64) > 0, 2, np.where(found["word"].to_numpy(bool), 0, 1))
    tier = np.searchsorted(STRENGTHS, found["strength"].to_numpy(float), "right") - 1
    key = np.concatenate([key, own])
    voter = np.concatenate([voter, len(LEXICONS) + kind * len(STRENGTHS) + tier])
    base = np.unique(np.concatenate([base, found["base"].to_numpy(np.int64).view(np.uint64)]))
    first = np.unique(key, return_index=True)[1]
    return Terms(key[first], voter[first], base)


def _with_voters(rows: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` and ``keys`` with a feature for each voter that speaks: by it terms count that are
    too rare for a weight of their own."""
    row, voter = np.nonzero((masks[:, None] >> np.arange(VOTERS)) & 1)
    return np.append(rows, row), np.append(keys, mix(voter.astype(np.uint64) + np.uint64(0x5EED)))


@dataclass
class LabelModel:
    """The share of toxic rows, and of each voter P(vote | class, vote of its parent): voters form
    a tree, whose edges are the model's correlations. ``rate`` is by class, parent's vote and
    voter; a root (parent -1) has both alike."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray

    def posterior(self, masks: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """P(toxic | votes); ``more`` is the log odds of evidence beside the voters."""
        x = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
        above = np.where(self.parent >= 0, x[:, self.parent], 0)
        ratio = np.zeros(len(masks)) + more
        for sign, y in ((1, 1), (-1, 0)):
            p = self.rate[y, above, np.arange(VOTERS)]
            ratio += sign * np.log(np.where(x, p, 1 - p)).sum(1)
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + ratio, -30, 30)))


def _tree(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Parents of the spanning tree with the greatest information between voters given the class;
    ``weight`` is by class and row."""
    gain = np.zeros((VOTERS, VOTERS))
    for own in weight:
        n = own.sum() + 1
        one = (own @ x + 0.5) / n
        both = (x * own[:, None]).T @ x
        for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
            u, v = (one if a else 1 - one), (one if b else 1 - one)
            count = both if a and b else (own @ x)[:, None] - both if a else (own @ x)[None, :] - both if b else own.sum() - (own @ x)[:, None] - (own @ x)[None, :] + both
            p = (np.maximum(count, 0) + 0.25) / n
            gain += n / weight.sum() * p * np.log(p / np.outer(u, v))
    parent = np.full(VOTERS, -1)
    best, over = gain[0].copy(), np.zeros(VOTERS, np.int64)
    left = np.arange(1, VOTERS)
    while len(left):
        pick = left[np.argmax(best[left])]
        parent[pick] = over[pick]
        left = left[left != pick]
        over = np.where(gain[pick] > best, pick, over)
        best = np.maximum(best, gain[pick])
    return parent


def _fitted(x: np.ndarray, weight: np.ndarray) -> LabelModel:
    """The model of rows ``x`` with their ``weight`` by class."""
    parent = _tree(x, weight)
    rate = np.zeros((2, 2, VOTERS))
    for y, own in enumerate(weight):
        flat = (own @ x + 0.5) / (own.sum() + 1)
        for value in (0, 1):
            here = np.where(parent >= 0, x[:, parent] == value, True) * own[:, None]
            # a parent's vote that hardly occurs leaves the voter's own rate
            rate[y, value] = ((here * x).sum(0) + 2 * flat) / (here.sum(0) + 2)
    prior = float(np.clip(weight[1].sum() / weight.sum(), 1e-4, 0.5))
    return LabelModel(prior, parent, np.clip(rate, 1e-5, 1 - 1e-5))


def fit_label_model(masks: np.ndarray, counts: np.ndarray, toxic: np.ndarray, rounds: int = 15) -> LabelModel:
    """EM over vote patterns with their numbers of rows; 2 ** VOTERS patterns at most. It starts
    from the rows whose class is known (``toxic`` isn't NaN), which keep it; each round fits
    the voters' accuracies and the tree of their correlations anew."""
    x = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    known = ~np.isnan(toxic)
    model = _fitted(x, np.stack([counts * (toxic == 0), counts * (toxic > 0)]))
    for _ in range(rounds):
        p = np.where(known, toxic > 0, model.posterior(masks))
        model = _fitted(x, np.stack([counts * (1 - p), counts * p]))
    return model


@dataclass
class Linear:
    """A logistic model of presence features: sorted keys, their weights, the bias; what the
    voters know, and the sorted keys of all terms that either needs."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float
    terms: Terms
    bases: np.ndarray


def fit_linear(rows: np.ndarray, index: np.ndarray, m: int, target: np.ndarray, rounds: int = 800, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of m features and the bias of a logistic regression on soft labels, from (row,
    feature index) pairs."""
    n, base = len(target), target.mean()
    w, b = np.zeros(m), float(np.log(base / (1 - base)))
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[index], minlength=n), -30, 30)))
        error = (p - target) / n
        grad = np.append(np.bincount(index, error[rows], minlength=m) + penalty * w / max(m, 1), error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _scores(column: pa.Array, model: Linear) -> np.ndarray:
    out = np.full(len(column), model.bias)
    for first, last, data, offsets in text_chunks(column):
        rows, keys = _known_features(data, offsets, model.bases)
        rows, keys = _with_voters(rows, keys, _votes(data, offsets, rows, keys, model.terms))
        at = _find(keys, model.keys)
        out[first:last] += np.bincount(rows[at >= 0], model.weight[at[at >= 0]], minlength=last - first) if len(model.keys) else 0
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear | None:
    """The classifier, from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels of held-out rows are never read. Terms come from all other labelled rows; the label
    model from the votes on all rows that aren't held out, counted by pattern; the classifier from its posteriors on at most ``sample`` labelled rows, whose label is a voter too.
    Features are chosen in Spark (five standard errors and five rows), so only their keys and
    the sample's rows of them come to the driver. None without toxic or other rows.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = write_table(known, "known")
    ids = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    labelled = docs.join(ids, "doc_id").select("doc_id", "toxic", "text")
    counted = {r.toxic: r.n for r in docs.select("doc_id").join(ids, "doc_id").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(counted) < 2:
        drop_tables(known)
        return None
    terms = mined(toxic_terms(labelled, counted[1], counted[0]).toPandas())
    shared = spark.sparkContext.broadcast(terms)

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes(batch.column(1), shared.value))], ["toxic", "mask"])

    free = docs.where(~held_out(F.col("doc_id"))).join(ids, "doc_id", "left").select("toxic", "text")
    patterns = free.mapInArrow(tidy(vote), "toxic int, mask long").groupBy("toxic", "mask").count().toPandas()
    masks, counts, toxic = patterns["mask"].to_numpy(np.int64), patterns["count"].to_numpy(float), patterns["toxic"].to_numpy(float)
    model = fit_label_model(masks, counts, toxic)

    trust = float(np.log(LABEL_TRUST / (1 - LABEL_TRUST)))

    def target(batches):
        for batch in batches:
            said = np.where(batch.column(1).to_numpy(zero_copy_only=False) > 0, trust, -trust)
            p = model.posterior(votes(batch.column(0), shared.value), said)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["text", "p"])

    chosen = known.orderBy(F.xxhash64("doc_id")).limit(sample)
    taught = write_table(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(tidy(target), "text string, p double"), "taught")
    drop_tables(known)
    n, base = taught.agg(F.count("*"), F.avg("p")).first()
    error = F.sqrt(F.greatest(F.col("n") * base * (1 - base), F.lit(1e-9)))
    away = F.abs(F.col("w") - F.col("n") * base) / error
    clear = _tallied(taught, F.col("p")).where((F.col("n") >= 5) & (away > 5)).orderBy(F.desc(away), "feature").limit(MOST_FEATURES).select("feature", "base").toPandas()
    voters = mix(np.arange(VOTERS).astype(np.uint64) + np.uint64(0x5EED))
    keys = np.unique(np.concatenate([clear["feature"].to_numpy(np.int64).view(np.uint64), voters]))
    bases = np.unique(np.concatenate([clear["base"].to_numpy(np.int64).view(np.uint64), terms.bases]))

    def features(batches):
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(0)):
                rows, found = _known_features(data, offsets, bases)
                rows, found = _with_voters(rows, found, _votes(data, offsets, rows, found, shared.value))
                at = _find(found, keys)
                rows, at = rows[at >= 0], at[at >= 0].astype(np.int32)
                order = np.argsort(rows, kind="stable")
                cut = np.searchsorted(rows[order], np.arange(last - first + 1))
                made = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at[order]))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first), made], ["p", "at"])

    got = taught.select("text", "p").mapInArrow(tidy(features), "p double, at array<int>").toPandas()
    index = np.concatenate([np.asarray(a, np.int64) for a in got["at"]]) if len(got) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(got)), [len(a) for a in got["at"]])
    p = got["p"].to_numpy(float)
    if not len(p) or not 0 < p.mean() < 1:
        return None
    weight, bias = fit_linear(rows, index, len(keys), p)
    drop_tables(taught)
    return Linear(keys, weight, bias, terms, bases)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Only the text makes the score. Null, empty and wordless texts get the classifier's base
    rate. Without labelled rows of both kinds every score is 0. Repeated rows are scored each;
    a null id is not held out. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            made = _scores(batch.column(1), shared.value) if shared.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "score"])

    made = docs.mapInArrow(tidy(run), "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
