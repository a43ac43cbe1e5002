"""The Jaccard join against all pairs, with tiles in blocks and in one piece, and its edge cases."""

import random

import numpy as np
import pytest

from tests.compare import database, same
from tidemark.llm import jaccard_join as module
from tidemark.llm.jaccard_join import folded, jaccard_join, parity_signature, width_for
from tidemark.llm.queries import SQL, op12_jaccard_join

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingle_set(text, k):
    words = [w for w in (text or "").translate(UPPER).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()


def brute(rows, k, percent):
    """{(id, size): component} over all pairs; rows of one id are one node."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (i, x) in enumerate(sets):
        for j, y in sets[:at]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i is None, i or 0, len(x), None if i is None else find(i) if x else i) for i, x in sets)


def results(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def test_query_against_sql(spark):
    same(op12_jaccard_join(spark, SF), database(SF), SQL["op12_jaccard_join"])


SCHEMA = "doc_id long, text string, component long, n int, token string"


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("rows, size", [(512, 8 << 20), (4, 8 << 20), (512, 2000)])
def test_families_in_small_and_large_tiles(spark, monkeypatch, rows, size):
    """Families whose members are linked to some of the others only, by chains off the hub too."""
    monkeypatch.setattr(module, "BLOCK_ROWS", rows)
    monkeypatch.setattr(module, "BLOCK_BYTES", size)
    rng = random.Random(5)
    texts = []
    for family in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice((6, 15, 40, 120)))]
        for _ in range(14):
            base = edited(rng, base, 0.02) if family % 2 else base
            cut = rng.randrange(0, 1 + len(base) // 5)
            texts.append(" ".join(edited(rng, base, rng.choice((0, 0.01, 0.03)))[cut:]))
    ids = rng.sample(range(10**6), len(texts))
    docs = [(i, t, 7, 8, "x") for i, t in zip(ids, texts)]
    got = results(jaccard_join(spark.createDataFrame(docs, SCHEMA).repartition(4), k=3, percent=80))
    assert got == brute([d[:2] for d in docs], 3, 80)
    assert len({c for *_, c in got}) < len(got) - 30


def test_exact_threshold(spark):
    """85 of 100 shingles in common is a link, 84 of 100 none; sizes 85 and 100 are a band apart."""
    words = [f"w{i}" for i in range(200)]
    rows = [(2, " ".join(words[:103])), (1, " ".join(words[:88])), (4, " ".join(words[100:200] + ["x", "y", "z"])), (3, " ".join(words[100:187]))]
    got = results(jaccard_join(spark.createDataFrame([(*r, 1, 1, "") for r in rows], SCHEMA), k=4, percent=85))
    assert got == [(False, 1, 85, 1), (False, 2, 100, 1), (False, 3, 84, 3), (False, 4, 100, 4)]


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rng = random.Random(6)
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (5, "One TWO"), (None, "one two"), (None, None),
        (6, " ".join(long)), (7, " ".join(long[:55_000])), (8, "a b c d e f g h"), (9, "a b c d e f g h"), (10, "k l m n o p q r s"), (9, "k l m n o p q r s"),
    ]
    frame = spark.createDataFrame([(*r, 1, 1, "t") for r in rows], SCHEMA)
    assert results(jaccard_join(frame, k=4, percent=85)) == brute(rows, 4, 85)
    assert jaccard_join(frame.limit(0), k=4, percent=85).collect() == []


def test_bitmaps_never_refute_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, rng.integers(2, 400), dtype=np.uint64)
        x = np.unique(pool[rng.random(len(pool)) < 0.9])
        y = np.unique(pool[rng.random(len(pool)) < 0.9])
        if not len(x) or not len(y):
            continue
        width = min(width_for(len(x)), width_for(len(y)))
        a, b = folded(parity_signature(x, width_for(len(x))), width), folded(parity_signature(y, width_for(len(y))), width)
        assert (a == parity_signature(x, width)).all()
        common = len(np.intersect1d(x, y))
        differing = int(np.bitwise_count(a ^ b).sum())
        assert differing <= len(x) + len(y) - 2 * common
        for percent in (50, 80, 85, 100):
            if 100 * common >= percent * (len(x) + len(y) - common):
                assert module._may_link(len(x), len(y), differing, percent)
