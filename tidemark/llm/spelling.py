"""Spelling variants: words one edit apart by dynamic programming over the sorted vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import tidy
from .shared import drop_tables, write_table

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Code points of a text that are split at a time, and words a worker counts before it hands
#: its counts on.
SLICE, HELD_WORDS = 1 << 20, 200_000
#: Rows of documents that a Python worker gets at a time.
TEXT_ROWS = 2_000
#: Words of one group that are compared in one task; a larger group becomes pairs of blocks.
BLOCK = 16_384
#: Rows of small groups in one task, and queries that walk the list together.
TILE_ROWS, QUERIES = 65_536, 8_192


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a whole text, in slices that end between runs."""
    text = text.encode().translate(_LOWER).decode()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def vocabulary(docs: DataFrame, modulus: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, with their counts. A run whose
    crc32 of ``<id>:<run>`` is divisible by ``modulus`` loses one code point."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: Counter = Counter()
                for runs in _runs(text.as_py() or ""):
                    own.update(runs)
                for run, n in own.items():
                    h = zlib.crc32(f"{row_id}:{run}".encode())
                    if h % modulus == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in one array, and where each string starts (one more at the end)."""
    words = column.to_pylist()
    ends = np.cumsum([0, *map(len, words)])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), ends


def _common_prefixes(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it (0 for the first)."""
    out = np.zeros(len(size), np.int64)
    open_ = np.arange(1, len(size))
    depth = 0
    while len(open_):
        both = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = both[codes[start[both] + depth] == codes[start[both - 1] + depth]]
        depth += 1
        out[open_] = depth
    return out


def one_edit_apart(group: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, queries: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, target) of one group whose strings differ by exactly one edit.

    The strings are sorted by group and then by code point. Of the edit matrix between a query
    and a target only the three diagonals within one edit are kept. A row of it belongs to a
    prefix, so all targets in the range of that prefix (those between which the common prefix is
    as long) share it: it is computed once, and a range whose row is beyond one edit everywhere
    is skipped whole. Rows of all queries and ranges of one depth are computed together.
    """
    listed = np.flatnonzero(targets)
    t_group, t_start, t_size = group[listed], start[listed], size[listed]
    shared = _common_prefixes(codes, t_start, t_size)
    shared[np.flatnonzero(np.diff(t_group, prepend=-1))] = -1
    guard = np.append(codes, np.uint32(0))
    asked = np.flatnonzero(queries)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(asked), QUERIES):
        q = asked[at : at + QUERIES]
        low, high = np.searchsorted(t_group, group[q]), np.searchsorted(t_group, group[q], "right")
        some = high > low
        q, low, high = q[some], low[some], high[some]
        row = np.empty((3, len(q)), np.int8)
        row[0], row[1], row[2] = 2, 0, np.where(size[q] > 0, 1, 2)
        live, depth = np.arange(len(listed)), 0
        while len(q):
            # the target that ends here is the first of its range
            ends = np.flatnonzero((t_size[low] == depth) & (np.abs(size[q] - depth) <= 1))
            hit = ends[row[size[q[ends]] - depth + 1, ends] == 1]
            found.append((q[hit], listed[low[hit]]))
            live = live[t_size[live] > depth]
            heads = live[shared[live] <= depth]
            first, last = np.searchsorted(heads, low), np.searchsorted(heads, high)
            n = last - first
            parent = np.repeat(np.arange(len(q)), n)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + first[parent]
            low_next = heads[child]
            high_next = np.minimum(np.append(heads, len(listed))[child + 1], high[parent]) if len(parent) else child
            q, old = q[parent], row[:, parent]
            c, base, length = guard[t_start[low_next] + depth], start[q], size[q]

            def other(j):
                """1 where the query's j-th code point (from 0) isn't c."""
                return ((j < 0) | (j >= length) | (guard[np.minimum(base + max(j, 0), len(codes))] != c)).astype(np.int8)

            row = np.empty((3, len(q)), np.int8)
            row[0] = np.minimum(old[0] + other(depth - 1), old[1] + 1)
            row[1] = np.minimum(np.minimum(old[1] + other(depth), old[2] + 1), row[0] + 1)
            row[2] = np.minimum(old[2] + other(depth + 1), row[1] + 1)
            for k in range(3):
                row[k][depth + k > length] = 2
            keep = np.flatnonzero(row.min(0) <= 1)
            row = np.minimum(row[:, keep], 2)
            q, low, high = q[keep], low_next[keep], high_next[keep]
            depth += 1
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _near(rows: pa.Table) -> pa.Table:
    """The pairs of one tile: (word, near, near_n)."""
    key = rows["key"].combine_chunks().dictionary_encode()
    rows = rows.append_column("group", key.indices.cast(pa.int64()))
    rows = rows.take(pc.sort_indices(rows, [("group", "ascending"), ("rest", "ascending")]))
    codes, ends = _codes(rows["rest"].combine_chunks())
    size = np.diff(ends)
    role = rows["role"].to_numpy()
    x, y = one_edit_apart(rows["group"].to_numpy(), codes, ends[:-1], size, role != 2, role != 1)
    base = rows["base"].to_numpy()
    fit = np.minimum(size[x], size[y]) == base[x]  # two long words meet in their own group
    x, y = x[fit], y[fit]
    # a letter put where both halves agree is found by the group of the first half
    twice = np.flatnonzero((rows["tail"].to_numpy(zero_copy_only=False)[x]) & (size[x] != size[y]))
    rest = rows["rest"]
    drop = [i for i in twice if (a := rest[int(x[i])].as_py()).startswith(b := rest[int(y[i])].as_py()) or b.startswith(a)]
    x, y = np.delete(x, drop), np.delete(y, drop)
    word, n = rows["word"], rows["n"]
    return pa.table({"word": word.take(pa.array(x)), "near": word.take(pa.array(y)), "near_n": n.take(pa.array(y))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of distinct ``words`` (word, n) one edit apart.

    One edit leaves one half of the shorter word whole, at the same end. So a word of length m
    is listed by its halves, and by those it would have if it were the longer word of a pair:
    four groups each. Groups are compared by :func:`one_edit_apart`, small ones many to a task;
    a group of more than BLOCK words becomes a square of block pairs, so no group is one task's.
    """
    size = F.char_length("word")
    halves = F.explode(F.array(*(F.struct((size - less).alias("m"), F.lit(tail).alias("tail")) for less in (0, 1) for tail in (False, True))))
    listed = words.withColumn("half", halves).select("word", "n", "half.m", "half.tail").where("m > 0")
    cut = F.expr("CASE WHEN tail THEN char_length(word) - (m - m div 2) ELSE m div 2 END").cast("int")
    listed = listed.withColumn("cut", cut).select(
        "word", "n", "tail",
        F.expr("concat(m, CASE WHEN tail THEN '-' ELSE '+' END, CASE WHEN tail THEN substring(word, cut + 1) ELSE substring(word, 1, cut) END)").alias("key"),
        F.expr("CASE WHEN tail THEN substring(word, 1, cut) ELSE substring(word, cut + 1) END").alias("rest"),
        F.expr("CASE WHEN tail THEN m div 2 ELSE m - m div 2 END").cast("long").alias("base"),
    )
    held = listed.groupBy("key").agg(F.count("*").alias("held"), F.min(F.char_length("rest") - F.col("base")).alias("least"))
    held = held.where("held > 1 AND least = 0").select("key", "held")
    rows = write_table(listed.join(held, "key"), "halves")
    tiles = max(1, -(-rows.count() // TILE_ROWS))
    small = rows.where(F.col("held") <= BLOCK).withColumn("role", F.lit(0)).withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    large = rows.where(F.col("held") > BLOCK).withColumn("own", F.pmod(F.xxhash64("word"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asks = large.withColumn("role", F.lit(1)).withColumn("tile", F.xxhash64("key", F.col("own").cast("int"), F.col("other").cast("int")))
    answers = large.withColumn("role", F.lit(2)).withColumn("tile", F.xxhash64("key", F.col("other").cast("int"), F.col("own").cast("int")))
    every = small.unionByName(asks.drop("own", "other")).unionByName(answers.drop("own", "other"))
    out = every.groupBy("tile").applyInArrow(_near, "word string, near string, near_n long")
    pairs = write_table(out, "near")
    drop_tables(rows)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in each pass.
    A form is more frequent than its word by a factor, so there is no circle."""
    now = write_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = write_table(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_tables(now)
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, factor: int = 2, modulus: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root string; n, n_near, form_n long.

    Words are the maximal runs of A-Z, a-z and U+00C0-U+00FF of the whole texts, A-Z lower-cased
    (see :func:`vocabulary` for the planted slips), of ``least_length`` code points and
    ``least_count`` occurrences or more. Near words differ by one inserted, deleted or replaced
    code point. A word's form is its most frequent near word (ties: the smallest) if that occurs
    ``factor`` times as often at least; its root is the end of its chain of forms.

    Null and empty texts have no runs; rows of a null id count under an empty one; repeated rows
    count again; other columns are not read; an empty table gives an empty result.
    """
    words = write_table(vocabulary(docs, modulus, id_col, text_col).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length)), "words", TEXT_ROWS)
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("enough", -F.col("best.less") >= factor * F.col("n"))
    found = write_table(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("enough"), F.col("best.near")).alias("form"), F.when(F.col("enough"), -F.col("best.less")).alias("form_n")), "forms")
    drop_tables(words, pairs)
    end = roots(found.where("form IS NOT NULL"))
    return found.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
