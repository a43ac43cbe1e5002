"""Spelling variants against a plain computation, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import database, same
from tidemark.llm import spelling
from tidemark.llm.queries import SQL, op13_spelling
from tidemark.llm.spelling import near_words, spelling_variants

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least_length=5, least_count=3, factor=2, modulus=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    others = defaultdict(set)
    for group in holes.values():
        for a in group:
            others[a] |= {b for b in group if near(a, b)}
    form = {}
    for w in n:
        best = min(others[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def results(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_plain_computation(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = results(op13_spelling(spark, SF))
    assert got == brute(rows) and any(form for _, form, *_ in got)


def test_query_against_sql(spark):
    same(op13_spelling(spark, SF), database(SF), SQL["op13_spelling"])


@pytest.mark.parametrize("block, queries, slices", [(16384, 8192, 1 << 20), (3, 2, 5)])
def test_random_words_in_small_and_large_blocks(spark, monkeypatch, block, queries, slices):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(400)} | {"a" * 30, "a" * 31, "b" * 3000, "b" * 3001, "ÿ", "z"})
    got = near_words(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")).collect()
    want = {(a, b, i + 1) for a in words for i, b in enumerate(words) if near(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # and the kernel with queries in pieces
    monkeypatch.setattr(spelling, "QUERIES", queries)
    codes, ends = spelling._codes(pa.array(words))
    x, y = spelling.one_edit_apart(np.zeros(len(words), np.int64), codes, ends[:-1], np.diff(ends), np.ones(len(words), bool), np.ones(len(words), bool))
    assert {(words[i], words[j]) for i, j in zip(x, y)} == {(a, b) for a, b, _ in want}
    monkeypatch.setattr(spelling, "SLICE", slices)
    text = "Été straße, l'a-b  ABCdef ÀÿX×÷y " * 3
    assert [r for part in spelling._runs(text) for r in part] == re.findall("[A-Za-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


SCHEMA = "doc_id long, text string, word string, n int, form double"


def test_nulls_empties_ties_chains_and_clashing_names(spark):
    rows = [
        (1, "colour " * 6 + "colours " * 8 + "coloured"), (2, None), (3, ""), (None, "Colou colou colou"), (4, "coloxr " * 8), (4, "coloxr " * 8),
        (5, "tests " * 3 + "testa " * 6 + "testb " * 6 + "x" * 50_000 + " " + "..." * 10), (6, ("y" * 20_000 + " ") * 3), (7, "straße straße STRAßE"),
    ]
    got = results(spelling_variants(spark.createDataFrame([(i, t, "w", 1, 2.0) for i, t in rows], SCHEMA), modulus=10**9))
    assert got == brute(rows, modulus=10**9)
    by = {r[0]: r for r in got}
    assert by["colou"][1:3] == ("colour", "coloxr") and by["colour"][1:3] == ("coloxr", "coloxr")  # near the most frequent, chained
    assert by["tests"][1] == "testa" and by["straße"][1] is None  # the smaller of two as frequent


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
