"""Whitening against plain numpy, its exact parts against integers, and its edge cases."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import charpoly
from tidemark.llm.queries import op11_whitening
from tidemark.llm.whitening import whiten

SF = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """(n, {id: deviation}, {id: whitened}, explained) from a dense eigh of centred vectors."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    white = {i: (np.array([c - s / n for c, s in zip(v, sums)]) @ vectors) / np.sqrt(values) for i, v in x.items()}
    return n, deviation, white, values / (centred * centred).sum() * n


def test_query_against_numpy(spark):
    got = op11_whitening(spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, explained = brute(rows)
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert max(r.identity_error for r in got) < 1e-9
    assert max(abs(r.explained / explained[r.component - 1] - 1) for r in got) < 1e-9
    for c in range(1, 17):
        mine = np.array([r.whitened for r in got if r.component == c])
        theirs = np.array([white[r.vec_id][c - 1] for r in got if r.component == c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def test_nulls_copies_lengths_and_clashing_names(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0, 0.25]), (2, [0.5, 1.0, 0.25]), (3, [-1.0, 0.0, 2.0]), (4, [3.0, -2.0, 0.1]), (5, [0.0, 0.7, 0.9]), (None, [1.0, 1.0, 1.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 0.0, 0.0]), (10, []), (11, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], SCHEMA)
    got = whiten(table).collect()
    assert sorted({(r.vec_id is None, r.vec_id) for r in got}) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, None)]
    n, deviation, _, explained = brute(rows)
    assert {r.n for r in got} == {5} == {n}
    assert all(int(r.deviation) == deviation[r.vec_id] for r in got)
    assert {r.component: pytest.approx(r.explained) for r in got} == dict(enumerate(explained, 1))


def test_one_vector_and_empty_table_have_no_components(spark):
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rank_and_equal_eigenvalues(spark):
    """Corners of a square in a plane of three dimensions: one eigenvalue, twice, and no third."""
    rows = [(i, [a / 64, b / 64, 0.0], 0, "") for i, (a, b) in enumerate([(5, 0), (-5, 0), (0, 5), (0, -5)])]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.component, r.explained) for r in got} == {(1, 0.5), (2, 0.5)}
    assert max(r.identity_error for r in got) < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 3.0], 0, ""), (2, [2e12, -5.0], 0, ""), (3, [-7e11, 9.0], 0, ""), (4, [3e38, 0.5], 0, "")]
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()}
    x = {i: [min(math.floor(64 * float(np.float32(c))), 1 << 50) for c in v] for i, v, *_ in rows}
    sums = [sum(c) for c in zip(*x.values())]
    assert {i: int(r.deviation) for i, r in got.items()} == {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}


def test_polynomial_and_roots_are_exact():
    rng = random.Random(4)
    for d in (1, 2, 3, 5, 9):
        roots = sorted((rng.choice((0, 1, 7, 7, 30, 10**6)) for _ in range(d)), reverse=True)
        matrix = np.diag(np.array(roots, object))
        for _ in range(3 * d):  # similar integer matrices: row i += q row j, column j -= q column i
            i, j, q = rng.randrange(d), rng.randrange(d), rng.randrange(-3, 4)
            if i != j:
                matrix[i] = matrix[i] + q * matrix[j]
                matrix[:, j] = matrix[:, j] - q * matrix[:, i]
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([0] + poly, poly + [0])]
        bits = max(abs(c).bit_length() for c in poly) + 2
        assert charpoly.remaindered([(p, charpoly.charpoly_mod(matrix, p)) for p in charpoly.primes(bits)]) == poly
        found = [r / 2**64 for r, times in charpoly.top_roots(poly, d, 64) for _ in range(times)]
        assert found == [r for r in roots if r > 0]
