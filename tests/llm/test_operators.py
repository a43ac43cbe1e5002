"""The training-data operators: SQL or brute force, edge cases, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import DATA, database, same
from tests.llm.test_jaccard_join import brute as components
from tidemark.llm import queries
from tidemark.llm.chat import format_preferences
from tidemark.llm.components import connected_components
from tidemark.llm.decontam import contaminated
from tidemark.llm.exact_dedup import CuckooIndex, build_index, content_digests, exact_dedup, update_index
from tidemark.llm.kernels import shingles
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import hilbert_keys, pack
from tidemark.llm.quality import classify_quality, exact_quantile, keep_quality
from tidemark.llm.substring import compact_windows, repeated_passages, sliding_minima
from tidemark.llm.token_file import SegmentReader, read_tokens, write_segment, write_tokens
from tidemark.llm.tokens import encoder
from tidemark.llm.toxicity import held_out, score_toxicity
from tidemark.llm.warc import payload_chunks, read_warc, write_warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows):
    """Rows of (id, text), with columns whose names operators use inside."""
    extra = DOC + ", digest int, hash string, key string, stretch int, rep long, w string, score int, ids string"
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "x", "k", 2, 3, "w", 4, "ids") for i, t in rows], extra)


LONG = " ".join(f"word{i}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (5, "One TWO"), (None, "one two"), (6, LONG), (7, LONG.upper()), (8, "é   ü\U0001f600")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), database(), queries.SQL[name])


PARTS = [*"aBz ,.'\n\t\r19ßÀ×<|>_-\x0b\x1c\x00é中😀\u0085\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\u0301\u0308\u200b", "'s", "'LL", "  ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]


@pytest.mark.parametrize("path, lower", [(BYTE, False), (WORD, True)])
def test_ids_are_those_of_the_library(path, lower):
    rng, fresh, own = random.Random(7), Tokenizer.from_file(path), encoder(path, lower)
    for _ in range(5):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(2000)] + [None]
        want = [x.ids for x in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in own.encode(pa.array(texts, pa.string())) for i in range(b - a)]
        assert got == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aB \x0b\x85é\n", max_size=30), max_size=8), st.integers(1, 4))
def test_shingles_like_sets_of_words(texts, k):
    import re

    names = defaultdict(set)
    for row, found in shingles(pa.array(texts, pa.string()), k):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[row]))
        want = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))]
        assert len(found) == len(want)
        for name, value in zip(want, found.tolist()):
            names[value].add((name, len(words) >= k or len(words)))
    assert all(len(v) == 1 for v in names.values())


def test_cuckoo_index_resizes_and_deletes():
    index, keys = CuckooIndex(8), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, key in enumerate(keys):
        index.insert(key, i)
    assert index.resizes and index.size == 3000 and all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) for k in keys[:4]] == [None, 1, None, 3] and sorted(v for _, v in index.items()) == list(range(1, 3000, 2))


def test_exact_edges(spark):
    got = sorted((tuple(r) for r in exact_dedup(documents(spark, EDGES)).collect()), key=str)
    by = {(r[0], r[4]): r[1:4] for r in got}
    one = hashlib.sha256(b"one two").hexdigest()
    assert len(got) == len(EDGES) and by[1, hashlib.sha256(b"").hexdigest()] == (2, 2, False)
    assert by[5, one] == (5, 4, True) and by[4, one] == (5, 4, False) and by[None, one] == (5, 4, False)
    assert exact_dedup(documents(spark, [])).count() == 0


def test_index_update(spark):
    docs = [(i, f"t{i % 40}") for i in range(100)]
    index = build_index(content_digests(documents(spark, docs)), 3)
    batch = content_digests(documents(spark, [(200, "t0"), (201, "new")])).withColumn("op", F.lit("insert")).unionAll(content_digests(documents(spark, [(1, "t1"), (41, "t1"), (81, "t1"), (5, "none")])).withColumn("op", F.lit("delete")))
    members = content_digests(documents(spark, docs))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in update_index(index, batch, members, 3).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert got[digest("t0")] == (200, 4) and got[digest("new")] == (201, 1) and digest("t1") not in got and len(got) == 40
    # the copy that stayed goes: the largest one left stays
    batch = content_digests(documents(spark, [(82, "t2"), (43, "t3"), (7, "t5")])).withColumn("op", F.lit("delete"))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in update_index(index, batch, members, 3).collect()}
    assert got[digest("t2")] == (42, 2) and got[digest("t3")] == (83, 2) and got[digest("t5")] == (85, 3)


def test_index_update_with_repeated_rows_and_deletions(spark):
    docs = [(1, "a"), (2, "a"), (3, "a"), (5, "b"), (5, "b"), (4, "b"), (None, "c"), (None, "c"), (6, "c")]
    members = content_digests(documents(spark, docs))
    gone = content_digests(documents(spark, [(1, "a"), (1, "a"), (5, "b"), (None, "c"), (6, "c"), (6, "c"), (9, "c")])).withColumn("op", F.lit("delete"))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in update_index(build_index(members, 2), gone, members, 2).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {digest("a"): (3, 2), digest("b"): (5, 2), digest("c"): (None, 1)}


def test_near_edges(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(documents(spark, EDGES), 4).collect() if r.doc_id}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[4] == (1, 4) and got[5] == (1, 4) and got[7] == (29_997, 6)
    assert near_dedup(documents(spark, [])).count() == 0


def test_near_hub_unlike_its_bucket(spark):
    """Variants of one text, of which many are too unlike the smallest, against all pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 6, 9])):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    label = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in near_dedup(documents(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 90


def test_near_links_of_a_block_are_a_forest():
    """A block pair gives fewer links than it has components, and joins what all links join."""
    from tidemark.llm.near_dedup import _block_links

    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**63, 60, dtype=np.uint64)
    rows = []
    for i in range(900):
        own = base.copy()
        own[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(1, 2**63, 1, dtype=np.uint64)
        rows.append(np.unique(own))
    table = pa.table({"rep": np.arange(900), "component": np.arange(900), "block": np.repeat([0, 1], 450), "hashes": pa.array([x.tobytes() for x in rows], pa.binary())})
    got = _block_links(80)((pa.scalar(1), pa.scalar(0), pa.scalar(1)), table).to_pydict()
    both = {(i, j) for i in range(450) for j in range(450, 900) if 100 * (n := len(np.intersect1d(rows[i], rows[j]))) >= 80 * (len(rows[i]) + len(rows[j]) - n)}
    assert len(both) > 50_000 and len(got["a"]) < 900 and set(zip(got["a"], got["b"])) <= both

    def parts(links):
        label = {i: i for i in range(900)}
        for a, b in sorted(links):
            x, y = label[a], label[b]
            if x != y:
                label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
        return label

    assert parts(zip(got["a"], got["b"])) == parts(both)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(None, 3), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_quality_tells_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = classify_quality(docs, labels).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.15
    assert set(map(tuple, keep_quality(docs, labels).select("doc_id").collect())) == {(r.doc_id,) for r in classify_quality(docs, labels).where("kept").collect()}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_quality(documents(spark, EDGES), labels).collect() if r.doc_id}
    assert got[1].perplexity is None and not got[2].kept and got[4].kept and got[4].limit is not None
    kept = keep_quality(documents(spark, EDGES), labels)
    assert kept.columns == documents(spark, []).columns and kept.where("doc_id = 4").count() == 1
    none = classify_quality(documents(spark, EDGES), labels.where("doc_id < 0"))
    assert none.where("kept").count() == 8 and classify_quality(documents(spark, []), labels).count() == 0


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, " ".join(f"Word{i}" for i in range(100, 130)), 0), (2, "one two", 0), (3, None, 0), (4, "a b c d e f", 0), (4, "a b c d e f", 0), (None, "one two", 1)], "item_id long, text string, hash int")
    got = sorted(map(tuple, contaminated(documents(spark, EDGES), items).collect()))
    assert got == [(4, 2, 1, 1), (5, 2, 1, 1), (6, 1, 26, 26), (7, 1, 26, 26)]
    more = documents(spark, [(30, "x y one two z w v u t"), (31, "one x two y z w v u t"), (32, "ends with one TWO"), (33, "one")])
    assert sorted((r.doc_id, r.item_id) for r in contaminated(more, items).collect()) == [(30, 2), (32, 2)]
    assert contaminated(documents(spark, []), items).count() == 0 and contaminated(documents(spark, EDGES), items.where("false")).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(2)
    for n, width in ((0, 3), (2, 3), (50, 1), (200, 7), (200, 46)):
        values = rng.integers(0, 60, n).astype(np.uint64)
        got = {tuple(x) for x in compact_windows(values, width).tolist()}
        for l, c, r in got:
            assert values[c] == values[l : r + 1].min() and r - l + 1 >= width
        # each run of the width lies in one window round its minimum
        for i in range(n - width + 1):
            c = i + int(values[i : i + width].argmin())
            assert sum(l <= i and i + width - 1 <= r and l <= x <= r and x == c for l, x, r in got) == 1
        if n >= width > 0:
            assert compact_windows(np.zeros(5000, np.uint64), 46).tolist() == [[i, i, 4999] for i in range(4955)]
            assert sliding_minima(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(n - width + 1)]


def test_passages_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    where = defaultdict(set)
    for doc, text in rows:
        for _, found in shingles(pa.array([text]), 50):
            if len((text or "").split()) >= 50:
                for value in found.tolist():
                    where[value].add(doc)
    want = set().union(*(v for v in where.values() if len(v) > 1))
    got = repeated_passages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert want <= set(got.doc_id) | set(got.other_id) and (got.n_words >= 50).all()
    near = got[got.common.notna()]
    assert (100 * near.common >= 80 * near.shingles).all()


def test_passages_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    passage = [word() for _ in range(60)]
    text = lambda n, part: " ".join([word() for _ in range(n)] + part + [word() for _ in range(n)])
    nearly = passage[:30] + ["other"] + passage[31:]
    rows = EDGES + [(20, text(70, passage)), (21, text(9, [w.upper() for w in passage])), (22, text(300, nearly)), (23, text(40, passage[:40])), (24, text(200, []))]
    got = repeated_passages(documents(spark, rows)).collect()
    linked = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in got}
    assert (6, 7) in linked and {x for p in linked for x in p} == {6, 7, 20, 21, 22}
    exact = next(r for r in got if {r.doc_id, r.other_id} == {20, 21})
    start, other = (exact.start, exact.other_start) if exact.doc_id == 20 else (exact.other_start, exact.start)
    assert (start, other, exact.n_words, exact.other_words) == (70, 9, 60, 60)
    assert repeated_passages(documents(spark, [])).count() == 0


def test_hilbert_curve_steps():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_keys(cells, 3))
    assert sorted(hilbert_keys(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_packing(spark):
    got = pack(documents(spark, EDGES + [(i, f"text {i} " * i) for i in range(20, 60)]), BYTE).toPandas()
    tokenizer = Tokenizer.from_file(BYTE)
    for doc, text in EDGES[:6] + EDGES[7:]:
        if doc == 5:
            continue
        own = got[got.doc_id == doc].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [0] and (own.doc_tokens == len(ids)).all()
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        total = int(sequence.length.sum())
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and total <= 1024 and total & (total - 1) == 0
    assert pack(documents(spark, []), BYTE).count() == 0


def test_toxicity_held_out_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.6 * (got.toxic == 1).sum() and hit >= 0.8 * (got.predicted == 1).sum()
    edges = {r.doc_id: r for r in score_toxicity(documents(spark, EDGES), labels.where("false")).collect()}
    assert all(r.score == 0 and r.predicted == 0 for r in edges.values())
    assert edges[8].held_out == (zlib.crc32(b"8") % 4 == 2) and not edges[None].held_out
    assert score_toxicity(documents(spark, []), labels).count() == 0


def test_toxicity_is_found_in_each_language(spark):
    """On rows whose labels were never read: recall over all and by language, and precision."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("toxic IS NOT NULL").toPandas()
    hit, toxic = (got.predicted == 1) & (got.toxic == 1), got.toxic == 1
    assert hit.sum() >= 0.9 * toxic.sum() and hit.sum() >= 0.9 * (got.predicted == 1).sum()
    assert (hit.groupby(got.lang).sum() >= 0.8 * toxic.groupby(got.lang).sum()).all()


def test_label_model_recovers_rates_and_a_pair_of_voters_that_copy_each_other():
    from tidemark.llm import toxicity

    rng = np.random.default_rng(2)
    y = rng.random(60_000) < 0.2
    x = rng.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], 0.6, 0.1)
    x[:, 3] = np.where(rng.random(len(y)) < 0.95, x[:, 8], x[:, 3])
    masks, counts = np.unique((x.astype(np.int64) << np.arange(toxicity.VOTERS)).sum(1), return_counts=True)
    known = np.full(len(masks), np.nan)
    first = np.unique((x[:3000].astype(np.int64) << np.arange(toxicity.VOTERS)).sum(1) * 2 + y[:3000], return_counts=True)
    masks, counts, known = np.append(masks, first[0] // 2), np.append(counts, first[1]).astype(float), np.append(known, first[0] % 2)
    model = toxicity.fit_label_model(masks, counts, known)
    assert abs(model.prior - 0.2) < 0.02 and (model.parent[3] == 8 or model.parent[8] == 3)
    own = model.posterior((x.astype(np.int64) << np.arange(toxicity.VOTERS)).sum(1))
    assert ((own > 0.5) == y).mean() > 0.99


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (dict(score_toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert one == two


def test_token_segments(tmp_path):
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 2**b, 700, dtype=np.uint64) for b in (4, 8, 16, 24, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    with open(tmp_path / "a", "wb") as out:
        out.write(b"x" * 8)
        write_segment(out, [5, None, 9], [100, 0, 3400], ids)
    with open(tmp_path / "a", "rb") as source:
        reader = SegmentReader(source, 8)
        assert reader.tokens().tolist() == ids.tolist() and [reader.token(i) for i in range(0, 3500, 7)] == ids[::7].tolist()
        assert reader.doc_starts().tolist() == [0, 100, 100, 3500] and reader.doc_ids()[0] == 5
        with pytest.raises(IndexError):
            reader.token(3500)


def test_token_files(spark):
    got = read_tokens(write_tokens(documents(spark, EDGES), WORD, 2)).toPandas().sort_values(["start"])
    tokenizer = Tokenizer.from_file(WORD)
    assert len(got) == len(EDGES) and got.doc_id.isna().tolist() == [True] + [False] * 9 and got.doc_id.iloc[1:].is_monotonic_increasing
    at = 0
    text = {d: t for d, t in EDGES}
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == tokenizer.encode(text[None if np.isnan(r.doc_id) else int(r.doc_id)] or "", add_special_tokens=False).ids + [2] and (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    assert read_tokens(write_tokens(documents(spark, []), WORD, 2)).count() == 0


def test_warc_round_trip(spark):
    big = "päge\r\n\r\n" * 200_000
    pages = spark.createDataFrame([(3, "http://a/ b\n", big, 1), (1, None, big, 1), (4, "u", None, 1), (5, "u", "", 1), (6, "u", "x", 1), (6, "u", "x", 1), (None, "u", "x", 1)], "page_id long, url string, html string, chunk int")
    chunks = payload_chunks(pages.where("page_id = 3")).orderBy("chunk").collect()
    assert len(chunks) > 1 and b"".join(bytes(c.data) for c in chunks) == big.encode() and bytes(chunks[0].running) == hashlib.sha1(bytes(chunks[0].data)).digest()
    got = read_warc(write_warc(pages))
    text = lambda i: b"".join(bytes(r.data) for r in got.where(f"page_id = {i}").orderBy("chunk").collect() if r.data)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got.where("last").collect())
    n = len(big.encode())
    assert kinds == [("1", "response", None, n), ("3", "revisit", 1, n), ("4", "response", None, 0), ("5", "revisit", 4, 0), ("6", "response", None, 1), ("6", "response", None, 1), ("None", "response", None, 1)]
    assert text(1) == big.encode() and read_warc(write_warc(pages.where("false"))).count() == 0
    assert read_warc(write_warc(pages, least_bytes=5)).where("record_type = 'revisit'").count() == 1


def test_preferences(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<|im_end|>"), (1, 2, "user", "more"), (7, 0, "user", "q"), (7, 1, "assistant", "b"), (9, 0, "user", "q"), (9, 1, "assistant", "a<|im_end|>"), (9, 1, "assistant", "a<|im_end|>"), (None, 0, "user", "q"), (11, None, "user", "q"), (12, 0, None, None), (13, 0, "user", "z")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, split int, part int")
    got = sorted((r.chosen_id, r.rejected_id, r.part, r.turn, r.loss) for r in format_preferences(turns).collect())
    assert got == sorted([(1, 7, "prompt", 0, False), (1, 7, "chosen", 1, True), (1, 7, "chosen", 2, False), (1, 7, "rejected", 1, True), (1, 9, "prompt", 0, False), (1, 9, "chosen", 1, True), (1, 9, "chosen", 2, False), (1, 9, "rejected", 1, True), (1, 9, "rejected", 1, True), (12, 13, "chosen", 0, False), (12, 13, "rejected", 0, False)])
    assert format_preferences(turns.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "/root/testdata/sf0.001")
        after.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        steps.append(before)
    for got in steps[:-1]:
        assert got.columns == docs.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    first, exact, near, clean = map(text, steps[:-1])
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for i, t in first.items():
        best[lower(t)] = max(i, best.get(lower(t), -1))
    assert set(exact) == set(best.values())
    judged = classify_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert set(first) == {r.doc_id for r in judged.where("kept").collect()}  # held against a plain model below
    assert set(near) == {i for _, i, _, c in components(list(exact.items()), 5, 80) if i == c}
    words = lambda t: [w for w in re.split("[\\x20\\x09-\\x0D]+", (t or "").lower()) if w]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    items = [words(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    wanted = [(min(len(w), 5), runs(w, min(len(w), 5))) for w in items if w]
    held = {i for i, t in near.items() if any(100 * len(runs(words(t), k) & item) >= 80 * len(item) for k, item in wanted)}
    assert held and set(clean) == set(near) - held
    assert {r.doc_id for r in steps[-1].select("doc_id").distinct().collect()} == set(clean)


def _plain_model(texts):
    """p(gram) of an interpolated modified Kneser-Ney model of bytes, by dictionaries."""
    from tidemark.llm.byte_model import ORDER, discounts

    levels = [defaultdict(int)]
    for t in texts:
        line = bytes(ORDER - 1) + t.encode()
        for i in range(len(line) - ORDER + 1):
            levels[0][line[i : i + ORDER]] += 1
    for _ in range(ORDER - 1):
        levels.append(defaultdict(int))
        for g in levels[-2]:
            levels[-1][g[1:]] += 1
    cuts = [discounts({i: sum(c == i for c in x.values()) for i in range(1, 5)}) for x in levels]
    after = [defaultdict(list) for _ in levels]
    for x, own in zip(after, levels):
        for g, c in own.items():
            x[g[:-1]].append(c)

    def p(gram, depth=0):
        if depth == ORDER:
            return 1 / 256
        seen = after[depth].get(gram[:-1])
        if not seen:
            return p(gram[1:], depth + 1)
        cut = lambda c: cuts[depth][min(c, 3) - 1] if c else 0
        own = levels[depth].get(gram, 0)
        return (own - cut(own)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(gram[1:], depth + 1)

    def perplexity(text):
        line = bytes(ORDER - 1) + text.encode()
        logs = [np.log(p(line[i : i + ORDER])) for i in range(len(line) - ORDER + 1)]
        return np.exp(-np.mean(logs))

    return p, perplexity


@pytest.mark.parametrize("shard_rows, block", [(250_000, 32 << 20), (300, 700)])
def test_quality_against_plain_sums(spark, monkeypatch, shard_rows, block):
    """Perplexity, limit and verdict of every document, in one block and in many of them."""
    from tidemark.llm import byte_model

    monkeypatch.setattr(byte_model, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(byte_model, "BLOCK_BYTES", block)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices("the of a cat dog sat on Ärger 猫 x1 zebra quick".split(), k=n))
    rows = [(i, text(rng.randint(3, 50)), rng.choice(["en", "de", None])) for i in range(60)] + [(60, "zq#" * 30, "en"), (61, "cat " * 40, "fr"), (62, "", "en"), (63, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.xxhash64("text"))
    half = {r.doc_id: r.key & 1 for r in docs.collect()}
    trusted = list(range(0, 60, 2))
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(1, 0), (2, 0), (60, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify_quality(docs, labels, 0.9).collect()}
    models = [_plain_model([t for i, t, _ in rows if i in trusted and half[i] == side])[1] for side in (0, 1)]
    want = {i: models[1 - half[i]](t) for i, t, _ in rows if t}
    assert got.keys() == set(range(64)) and got[62].perplexity is None and got[63].perplexity is None
    assert all(got[i].perplexity == pytest.approx(want[i], rel=1e-5) for i in want)

    def limit(of):
        ranked = sorted(got[i].perplexity for i in of)
        return ranked[int(np.ceil(len(ranked) * 0.9)) - 1]

    by = {lang: limit([i for i, _, x in rows if i in trusted and x == lang]) for lang in ("en", "de")}
    for i, t, lang in rows:
        bound = by.get(lang, limit(trusted))
        assert got[i].limit == bound and got[i].kept == bool(t and got[i].perplexity <= bound)


def test_bytes_of_a_context_sum_to_one(spark):
    from tidemark.llm.byte_model import byte_model, gram_counts, log_probabilities

    rows = byte_model(gram_counts(spark.createDataFrame([(0, "abracadabra and so on"), (1, "other text")], "side int, text string"))).toPandas()
    tables = {}
    for kind, own in rows.sort_values("key").groupby("kind"):
        tables[kind] = (own["key"].to_numpy(), own["value"].to_numpy())
    for context in (b"\0\0\0\0", b"abra", b"zzzz", b"xbra", b" and"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert np.exp(log_probabilities(grams, tables).astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_exact_quantile(spark):
    rng = random.Random(5)
    values = {g: [rng.choice([1.0, 1.5, 2 + rng.random() * 1e-4, rng.random() * 90 + 1]) for _ in range(n)] for g, n in (("a", 1), ("b", 500), ("c", 777))}
    rows = spark.createDataFrame([(g, v) for g, own in values.items() for v in own], "g string, v double")
    for q in (0.01, 0.5, 0.99, 1.0):
        got = {r.g: r.limit for r in exact_quantile(rows, "g", "v", q).collect()}
        assert got == {g: sorted(own)[int(np.ceil(len(own) * q)) - 1] for g, own in values.items()}
    assert exact_quantile(rows.where("false"), "g", "v", 0.5).count() == 0


def test_quality_sees_word_order(spark):
    rng = random.Random(8)
    follow = {i: rng.sample(range(40), 2) for i in range(40)}

    def prose(n):
        at, out = rng.randrange(40), []
        for _ in range(n):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return out

    good = [prose(120) for _ in range(160)]
    mixed = [rng.sample(x, len(x)) for x in good[:20]]
    docs = documents(spark, [(i, " ".join(x)) for i, x in enumerate(good + mixed)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    assert sum(got[i].kept for i in range(160)) >= 150 and not any(got[i].kept for i in range(160, 180)), [got[i] for i in (0, 1, 160, 161, 162)]


def _words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=8)) for _ in range(n)]


def _digest(words):
    return int.from_bytes(hashlib.sha256(" ".join(words).encode()).digest()[:8], "little", signed=True)


def test_passage_inside_a_near_copy(spark):
    """B has a quote of A; A's near copy, edited in the quote, covers A's side of it only."""
    rng = random.Random(12)
    rows, groups = [], 8
    for group in range(groups):
        while True:
            head, quote, tail = _words(rng, 400), _words(rng, 60), _words(rng, 400)
            a, b = head + quote + tail, _words(rng, 50) + quote + _words(rng, 50)
            copy = head + quote[:20] + _words(rng, 1) + quote[21:40] + _words(rng, 1) + quote[41:] + tail
            if _digest(b) < _digest(copy) < _digest(a):
                break
        rows += [(10 * group + i, " ".join(x)) for i, x in enumerate((a, copy, b))]
    got = repeated_passages(documents(spark, rows)).collect()
    assert {10 * g + 2 for g in range(groups)} <= {x for r in got for x in (r.doc_id, r.other_id)}


def test_passages_of_a_repeated_phrase():
    """Any stretch of a text that repeats a phrase, copied into another text."""
    from tidemark.llm.substring import profile, shared_passages

    rng, width = np.random.default_rng(9), 46
    windows = lambda x: profile(x, width)
    fresh = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    for period in (1, 7, 29, 40):
        x = np.concatenate([fresh(20), np.tile(fresh(period), 400 // period), fresh(20)])
        for at in rng.integers(20, 300, 12).tolist():
            y = np.concatenate([fresh(30), x[at : at + 50], fresh(30)])
            for one, two in ((x, y), (y, x)):
                found = shared_passages(one, windows(one), two, windows(two), width, 80)
                a, b = (0, 1) if one is y else (2, 3)
                assert any(p[a] <= 30 and p[b] >= 79 for p in found), (period, at)


def test_passages_that_their_hub_lacks(spark):
    """The hub of their keys has too little of a passage that two others share."""
    rng = random.Random(14)
    rows, groups = [], 12
    for group in range(groups):
        while True:
            quote = _words(rng, 50)
            a, b, hub = (_words(rng, 40) + part + _words(rng, 40) for part in (quote, quote, quote[3:46]))
            if _digest(hub) < min(_digest(a), _digest(b)):
                break
        rows += [(10 * group + i, " ".join(x)) for i, x in enumerate((a, b, hub))]
    got = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in repeated_passages(documents(spark, rows)).collect()}
    assert {(10 * g, 10 * g + 1) for g in range(groups)} <= got


def test_toxicity_of_terms_rarer_than_the_sample(spark):
    rng = random.Random(15)
    plain, vile = _words(rng, 300), _words(rng, 12)
    rare = _words(rng, 6)
    rows = []
    for i in range(4000):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.sample(plain, 20) + (rng.sample(vile, 1) * 2 if bad else [])), int(bad)))
    rows += [(5000 + i, " ".join(rng.sample(plain, 20) + [rare[i % 6]] * 2), 1) for i in range(72)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = score_toxicity(documents(spark, [r[:2] for r in rows]), labels, sample=400).where("held_out").toPandas()
    assert got[got.doc_id >= 5000].predicted.mean() > 0.8 and got[(got.doc_id < 5000) & (got.doc_id % 5 != 0)].predicted.mean() < 0.05


def test_near_passages_are_found(spark):
    """Recall of planted near passages of similarity 0.8 and more, and documents left alone."""
    rng, rows, sizes = random.Random(21), [], {}
    for i in range(200):
        quote = _words(rng, rng.choice([60, 120, 200]))
        copy = list(quote)
        for at in range(len(quote) // 2 - 2, len(quote) - 5, 60) if len(quote) > 60 else [len(quote) // 2]:
            copy[at] = _words(rng, 1)[0]
        rows += [(3 * i, " ".join(_words(rng, 80) + quote + _words(rng, 60))), (3 * i + 1, " ".join(_words(rng, 30) + copy + _words(rng, 90))), (3 * i + 2, " ".join(_words(rng, 150)))]
        a, b = ({" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for w in (quote, copy))
        sizes[i] = len(a & b) / len(a | b)
    assert min(sizes.values()) >= 0.8
    got = repeated_passages(documents(spark, rows)).collect()
    pairs = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in got}
    assert sum((3 * i, 3 * i + 1) in pairs for i in range(200)) >= 190 and pairs <= {(3 * i, 3 * i + 1) for i in range(200)}


@pytest.mark.parametrize("parts", [((0, 40), (20, 60)), ((0, 45), (15, 60)), ((0, 48), (5, 49), (12, 60), (10, 55))])
def test_near_passages_are_found_beside_texts_that_hold_parts(spark, parts):
    rng, rows = random.Random(22), []
    for i in range(60):
        quote = _words(rng, 60)
        copy = quote[:30] + _words(rng, 1) + quote[31:]
        texts = [_words(rng, 70) + quote + _words(rng, 40), _words(rng, 30) + copy + _words(rng, 90)]
        texts += [_words(rng, 50) + quote[a:b] + _words(rng, 50) for a, b in parts]
        rows += [(10 * i + n, " ".join(t)) for n, t in enumerate(texts)]
    got = repeated_passages(documents(spark, rows)).collect()
    pairs = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in got}
    assert sum((10 * i, 10 * i + 1) in pairs for i in range(60)) >= 57
    assert all(a // 10 == b // 10 for a, b in pairs)


@pytest.mark.parametrize("joined", [False, True])
def test_near_passages_are_found_in_a_crowd_of_texts_that_hold_parts(spark, joined):
    """Many others share the windows but no near passage, or other passages join the two by a third text."""
    rng, rows, groups = random.Random(23), [], 20
    for i in range(groups):
        quote, one, two = _words(rng, 60), _words(rng, 55), _words(rng, 55)
        copy = quote[:30] + _words(rng, 1) + quote[31:]
        parts = [(0, 43), (17, 60), (5, 47), (12, 55)]
        crowd = [[_words(rng, 50) + quote[a:b] + _words(rng, 50) for _ in range(2 if joined else 5)] for a, b in parts]
        low, high = max(min(map(_digest, kind)) for kind in crowd), min(max(map(_digest, kind)) for kind in crowd)
        while low > high:
            crowd = [[_words(rng, 50) + quote[a:b] + _words(rng, 50) for _ in kind] for (a, b), kind in zip(parts, crowd)]
            low, high = max(min(map(_digest, kind)) for kind in crowd), min(max(map(_digest, kind)) for kind in crowd)
        texts = []
        for part, more in ((quote, one), (copy, two)):
            while True:
                text = _words(rng, 70) + part + _words(rng, 60) + (more if joined else [])
                if low < _digest(text) < high:
                    break
            texts.append(text)
        texts += [x for kind in crowd for x in kind] + ([one + _words(rng, 50) + two] if joined else [])
        rows += [(100 * i + n, " ".join(t)) for n, t in enumerate(texts)]
    got = repeated_passages(documents(spark, rows)).collect()
    assert len({r.doc_id // 100 for r in got if r.doc_id // 100 == r.other_id // 100 and {r.doc_id % 100, r.other_id % 100} == {0, 1}}) >= 19


def test_places_of_a_crowd_are_compared_like_all_pairs():
    from tidemark.llm.substring import _meeting

    rng = np.random.default_rng(6)
    line = rng.integers(0, 2**32, 38, dtype=np.uint32)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    sets = [np.concatenate([line, fresh(60)]) for _ in range(300)]
    for i in range(0, 40, 2):
        sets[i + 1][38:50] = sets[i][38:50]
    sets = [np.unique(x) for x in sets]
    least = np.full(300, 46)
    least[100:110] = 30
    group = np.arange(300) // 3
    common = [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:120]]
    need = lambda i, j: -(-80 * (least[i] + least[j]) // 180)
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if common[i][j] >= need(i, j) and group[i] != group[j]]
    got = [tuple(x) for x in _meeting(sets, least, group, 46, 80)]
    assert [x for x in got if x[1] < 120] == want and {(2, 3), (8, 9)} <= set(got)
    assert sorted(tuple(x) for x in _meeting(sets[:120], least[:120], group[:120], 46, 80)) == want


def test_progressions_align_like_all_pairs():
    from tidemark.llm.substring import _aligned, _progressions

    rng = np.random.default_rng(3)
    for _ in range(60):
        cx, cy = (np.cumsum(rng.choice([3, 3, 3, 3, 5, 8], rng.integers(1, 40))) for _ in "ab")
        parts = _progressions(cx)
        assert sum(m for _, m, _ in parts) == len(cx)
        assert all((np.diff(cx[a : a + m]) == p).all() for a, m, p in parts)
        found = {}
        for a, m, p in parts:
            for b, q, s in _progressions(cy):
                for head, tail in zip(*(z.T.tolist() for z in _aligned(a, m, p, b, q, s, cx, cy))):
                    assert cy[head[1]] - cx[head[0]] == cy[tail[1]] - cx[tail[0]]
                    found.setdefault(int(cy[head[1]] - cx[head[0]]), []).append((head, tail))
        want = defaultdict(set)
        for i, x in enumerate(cx):
            for j, y in enumerate(cy):
                want[int(y - x)].add((i, j))
        assert found.keys() == want.keys()


def test_windows_of_a_chunk_are_those_of_its_texts():
    from tidemark.llm.substring import _profiles, profile

    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=n)) for n in (0, 3, 200, 51, 50, 49, 700)] + [None, " ".join(["x"] * 90), " ".join(_words(rng, 300))]
    got = {row: (x.tolist(), sorted(map(tuple, w.tolist()))) for row, x, w in _profiles(pa.array(texts), 5, 46)}
    for row, x in shingles(pa.array(texts), 5):
        if len((texts[row] or "").split()) >= 5:
            assert got[row] == (x.tolist(), sorted(map(tuple, profile(x, 46).tolist())))
        else:
            assert got[row] == ([], [])


def _edited(rng, base, n):
    """Copies of ``base`` (32-bit shingles) with some replaced, and on every other one also one left out."""
    out = []
    for i in range(n):
        row = base.copy()
        n = int(rng.integers(0, 8))
        row[rng.choice(len(row), n, replace=False)] = rng.integers(0, 2**32, n, np.uint32)
        row[60:] = rng.permutation(row[60:]) if i % 5 == 4 else row[60:]
        out.append(np.delete(row, [int(x) for x in rng.choice(40, i % 2)]))
    return out


def test_rows_compared_at_once_leave_out_none_that_is_alike():
    from tidemark.llm.substring import _Around, _in_line, _in_order

    rng, alike = np.random.default_rng(4), [0, 0]
    for _ in range(20):
        rows = _edited(rng, rng.integers(0, 2**32, int(rng.integers(60, 120)), np.uint32), 12)
        at = [int(x) for x in rng.integers(20, 40, 12)]
        near = _Around(at, rows, 46, 80)
        for i in range(12):
            others = np.delete(np.arange(12), i)
            line, dense = near.line(i, others).tolist(), near.dense(i, others).tolist()
            for j in others.tolist():
                if _in_line(rows[i], at[i], rows[j], at[j], 46, 80)[0]:
                    assert j in line
                    alike[0] += 1
                kind, places = _in_order(rows[i], rows[j], 46, 80)
                if kind == 2:
                    a, b, c, d = places
                    one, two = set(rows[i][a : b + 1].tolist()), set(rows[j][c : d + 1].tolist())
                    assert b - a >= 45 and d - c >= 45 and 100 * len(one & two) >= 80 * len(one | two)
                    assert j in dense or len(np.unique(rows[i])) < len(rows[i]) or len(np.unique(rows[j])) < len(rows[j])
                    alike[1] += 1
    assert min(alike) > 20


def test_texts_with_words_left_out_are_joined_by_few_pairs():
    """Of n alike rows n - 1 pairs at most, not all; each says which places are alike."""
    from tidemark.llm.substring import _place_links

    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, 160, np.uint32)
    rows = [np.delete(base, [10 + 4 * i, 150 - 2 * i]) for i in range(30)]
    at = [int(np.flatnonzero(row == base[79])[0]) for row in rows]
    for i, row in enumerate(rows):  # each has others of its own between those that all have
        row[i % 12 :: 12] = rng.integers(0, 2**32, len(row[i % 12 :: 12]), np.uint32)
        row[at[i]] = base[79]
    found = _place_links(np.zeros(30, bool), at, np.full(30, 46), rows, 46, 70)
    assert 0 < len(found) < 30
    for i, j, (a, b, c, d) in found:
        one, two = set(rows[i][a : b + 1].tolist()), set(rows[j][c : d + 1].tolist())
        assert 100 * len(one & two) >= 70 * len(one | two)


def test_alike_places_are_verified_without_windows():
    from tidemark.llm.substring import shared_passages

    rng, none = np.random.default_rng(1), np.zeros((0, 4), np.int64)
    x = rng.integers(0, 2**63, 90, np.uint64)
    y = np.concatenate((rng.integers(0, 2**63, 7, np.uint64), x[20:80]))
    y[30] = 1
    assert shared_passages(x, none, y, none, 46, 80) == []
    assert shared_passages(x, none, y, none, 46, 80, places=[(25, 75, 12, 62)]) == [(20, 79, 7, 66, 59, 61)]
    assert shared_passages(x, none, y, none, 46, 80, places=[(0, 50, 0, 50)]) == []
