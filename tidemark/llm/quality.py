"""Quality classifier: a Kneser-Ney model of byte n-grams (``byte_model``), trained on trusted text.

Trusted text is halved by text, and each text is scored by the half that it would not be in:
limits come from texts that the model hasn't seen, and copies of trusted texts have no
advantage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_model import TEXT_ROWS, byte_model, byte_perplexities, gram_counts
from .shared import drop_tables, write_table

#: Trusted ids up to this many go to all executors; more of them are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Steps of the logarithm of perplexity in which values are counted before they are ranked.
STEPS = 4096


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text_key, perplexity) of ``docs`` (doc_id, lang, text), by models of all
    texts that ``labels`` calls good."""
    keyed = docs.withColumn("text_key", F.xxhash64("text")).withColumn("half", F.col("text_key").bitwiseAND(1).cast("int"))
    counts = write_table(gram_counts(_trusted(keyed, labels).withColumn("side", F.col("half"))), "counts", TEXT_ROWS)
    model = byte_model(counts)
    out = byte_perplexities(keyed.withColumn("side", 1 - F.col("half")), model)
    drop_tables(counts, model)
    return out


def exact_quantile(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, limit): the smallest value of each group that a share ``q`` of its rows doesn't
    exceed. Values are counted in steps of their logarithm first; only those of the step that
    holds the rank are then put in order, as distinct values with their numbers of rows."""
    stepped = values.withColumn("step", F.floor(F.log(value) * STEPS))
    counts = stepped.groupBy(group, "step").agg(F.count("*").alias("n"))
    ranks = Window.partitionBy(group)
    before = ranks.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.ceil(F.sum("n").over(ranks) * F.lit(q))).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = ranked.where("rank > before AND rank <= before + n").select(F.col(group).alias("_group"), F.col("step").alias("_step"), (F.col("rank") - F.col("before")).alias("rest"))
    inside = stepped.join(F.broadcast(held), (F.col(group) == F.col("_group")) & (F.col("step") == F.col("_step")))
    each = inside.groupBy(group, value, "rest").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("upto", F.sum("n").over(upto)).where("upto >= rest").groupBy(group).agg(F.min(value).alias("limit"))


def language_limits(scores: DataFrame, labels: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang, limit): the quantile of trusted perplexities by language, and over all of them."""
    good = write_table(_trusted(scores, labels).where("perplexity IS NOT NULL").select("lang", "perplexity"), "trusted")
    limits = write_table(exact_quantile(good.where("lang IS NOT NULL"), "lang", "perplexity", quantile), "limits")
    pooled = exact_quantile(good.withColumn("lang", F.lit("")), "lang", "perplexity", quantile).first()
    drop_tables(good)
    return limits, pooled["limit"] if pooled else None


def _chosen(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def _verdicts(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    scores = score(docs, labels)
    limits, pooled = language_limits(scores, labels, quantile)
    limits = F.broadcast(limits) if limits.count() <= 10_000 else limits
    found = scores.join(limits, "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(pooled).cast("double")))
    return found.withColumn("kept", F.coalesce(F.col("perplexity") <= F.coalesce("limit", F.lit(float("inf"))), F.lit(False)))


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, perplexity, limit, kept.

    The models learn all texts with quality 1 in ``labels`` (doc_id, quality); an id that is
    labelled more than once is trusted if one of its labels says so. A document is kept when
    its perplexity a byte is at most its language's limit: the smallest perplexity that the
    share ``quantile`` of the trusted documents in that language doesn't exceed, or of all of
    them for a language without any and for a null one. Without trusted text there is no limit
    and every text is kept. Null and empty texts have no perplexity and aren't kept. Repeated
    rows are scored each. Other columns are not read; an empty table gives an empty result.
    """
    found = _verdicts(_chosen(docs, id_col, text_col, lang_col), labels, quantile)
    return found.select("doc_id", "lang", "perplexity", "limit", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and what else there is) that the classifier
    keeps, with all their columns; texts stay where they are unless many are rejected."""
    found = _verdicts(_chosen(docs, "doc_id", "text", "lang"), labels, quantile)
    bad = write_table(found.where("NOT kept").select(F.col("text_key").alias("_bad"), F.col("lang").alias("_lang")).distinct(), "rejected")
    same = (F.xxhash64(docs["text"]) == bad["_bad"]) & docs["lang"].cast("string").eqNullSafe(bad["_lang"])
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, same, "left_anti")
