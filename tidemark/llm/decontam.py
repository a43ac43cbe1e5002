"""Benchmark decontamination by size-partitioned MinHash containment search; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: Sketch entries, shingles or ids up to which a side is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words of a text: maximal runs other than 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def _runs(w: str, k: int, make) -> Column:
    """make(list of k element columns) for each run of k words; the whole sequence if shorter."""
    array = F.col(w)
    many = F.transform(F.sequence(F.lit(0), F.size(array) - k), lambda i: make(i, [F.get(array, i + j) for j in range(k)]))
    short = F.array(make(F.lit(0), [F.get(array, F.lit(j)) for j in range(k)]))
    return F.when(F.size(array) >= k, many).when(F.size(array) > 0, short)


def shingle_hashes(w: str, k: int) -> Column:
    return _runs(w, k, lambda i, parts: F.xxhash64(*parts))


def shingle_texts(w: str, k: int) -> Column:
    return F.array_distinct(_runs(w, k, lambda i, parts: F.concat_ws(" ", *parts)))


def _with_short(w: str, k: int, sizes: list[int], make, joined) -> Column:
    """The runs of k words and those of each of the shorter ``sizes``, each once."""
    array = F.col(w)

    def short(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(array) - n), lambda i: joined(*[F.get(array, i + j) for j in range(n)]))
        return F.when(F.size(array) >= n, runs).otherwise(F.array())

    return F.array_distinct(F.concat(F.coalesce(make(w, k), F.array()), *map(short, sizes)))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, hash, size_class): a MinHash sketch of each item, as long as its class needs.

    Items are partitioned by the power of two above their number of shingles q. A text that
    holds ``percent`` of an item lacks at most q * (100 - percent) / 100 of its shingles, so of
    the smallest so many hashes and one more it has at least one. The class's largest q sets
    the length for all of the class.
    """
    sized = items.withColumn("size_class", F.ceil(F.log2(F.col("q") + F.lit(1))).cast("int"))
    longest = sized.groupBy("size_class").agg(F.max("q").alias("most"))
    length = F.floor(F.col("most") * (100 - percent) / 100).cast("int") + 1
    kept = sized.join(longest, "size_class").select("item_id", "size_class", F.slice(F.array_sort("hashes"), 1, length).alias("h"))
    return kept.select("item_id", "size_class", F.explode("h").alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_contained): documents that hold a benchmark item.

    An item is held when ``percent`` or more of its distinct k-word shingles are among the
    document's; shingles are of lower-cased words. An item of fewer than k words is one shingle
    as a whole and is held wherever its words stand together. An item_id with several texts
    is held once for each of them that is. Candidates are
    documents of which a shingle's hash is in the item's MinHash sketch (no document is
    missed, see :func:`item_sketches`); they are verified on the shingles themselves. Null,
    empty and blank texts hold nothing and are held by nothing. Rows that repeat a doc_id
    count as one document. Rows of null ids take no part. Other columns are not read; if
    either table is empty, so is the result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    bench = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id IS NOT NULL AND size(w) > 0").distinct()
    items = write_table(bench.select("item_id", F.array_distinct(shingle_hashes("w", k)).alias("hashes"), shingle_texts("w", k).alias("shingles")).withColumn("q", F.size("hashes")), "items")
    sketch = write_table(item_sketches(items, percent), "sketch")
    bounds = sketch.agg(F.max("hash").alias("top"), F.count("*").alias("n")).first()
    top = bounds["top"] if bounds["top"] is not None else -(2**63)
    sizes = sorted(r["n"] for r in bench.select(F.size("w").alias("n")).where(F.col("n") < k).distinct().collect())
    hashes = _with_short("w", k, sizes, shingle_hashes, F.xxhash64)
    own = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.filter(hashes, lambda h: h <= F.lit(top))).alias("hash"))
    hits = own.join(_small(sketch.select("hash", "item_id").distinct(), bounds["n"]), "hash").select("doc_id", "item_id").distinct()
    pairs = write_table(hits, "candidates")
    ids = pairs.select("doc_id").distinct()
    found = docs.join(_small(ids), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(_with_short("w", k, sizes, shingle_texts, lambda *parts: F.concat_ws(" ", *parts))).alias("shingle"))
    wanted = items.select("item_id", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("shingle"))
    held = found.join(_small(wanted), "shingle").groupBy("doc_id", "item_id", "n_shingles").agg(F.count_distinct("shingle").alias("n_contained"))
    enough = held.where(100 * F.col("n_contained") >= percent * F.col("n_shingles"))
    return enough.join(pairs, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_contained")
