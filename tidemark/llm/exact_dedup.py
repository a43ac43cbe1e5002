"""Exact dedup over a sharded cuckoo-filter index of live content digests."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import tidy
from .shared import partitions, write_table

SLOTS = 4
KICKS = 128
#: Rows of the input for one shard of the index: bounds a shard's memory.
SHARD_ROWS = 250_000
#: Rows of texts that a Python worker gets at a time.
TEXT_ROWS = 2_000
#: Partial groups in which the copies of one digest reach its shard.
SALTS = 8


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints whose buckets also hold what they stand for.

    A fingerprint hit is only a suspicion: it counts after the full digest in the bucket has
    been compared. ``delete`` removes a live digest; when an insertion kicks too often, the
    table doubles and all entries are placed anew from the stored digests.
    """

    def __init__(self, capacity: int = 1024):
        self.size = 0
        self.resizes = 0
        self._allocate(max(2, 1 << max(1, (int(capacity / (SLOTS * 0.9)) + 1).bit_length())))

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[tuple[bytes, object] | None] = [None] * (SLOTS * buckets)

    def _buckets(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        home = int.from_bytes(digest[8:16], "big") & self.mask
        return mark, home, home ^ self._jump(mark)

    def _jump(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, one, two = self._buckets(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self._slot(digest)
        return None if slot < 0 else self.content[slot][1]

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that isn't live yet."""
        entry, (mark, bucket, other) = (digest, value), self._buckets(digest)
        self.size += 1
        for b in (bucket, other):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = mark, entry
                    return
        for kick in range(KICKS):
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.content[slot], entry = entry, self.content[slot]
            bucket ^= self._jump(mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.content[free] = mark, entry
                    return
        stored = [x for x in self.content if x is not None] + [entry]
        self.resizes += 1
        self.size = 0
        self._allocate(2 * (self.mask + 1))
        for key, kept in stored:
            self.insert(key, kept)

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def items(self):
        return (x for x in self.content if x is not None)


def content_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; null counts as empty."""

    def digest(batches):
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            made = [hashlib.sha256(memoryview(x.as_buffer())).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(digest), "doc_id long, digest binary")


def _merge(index: CuckooIndex, digest: bytes, doc_id, count: int) -> None:
    """Insert; on a verified hit the smaller id's entry is deleted and the larger id's lives."""
    live = index.get(digest)
    if live is not None:
        index.delete(digest)
        ids = [x for x in (live[0], doc_id) if x is not None]
        doc_id, count = max(ids, default=None), count + live[1]
    index.insert(digest, (doc_id, count))


def _entries(index: CuckooIndex) -> pd.DataFrame:
    rows = [(key, keep, n) for key, (keep, n) in index.items()]
    return pd.DataFrame({"digest": [r[0] for r in rows], "keep_id": pd.array([r[1] for r in rows], "Int64"), "group_size": pd.array([r[2] for r in rows], "Int64")})


def _ids(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of the live digests, from one cuckoo index a shard.

    Copies are counted before the shuffle in ``SALTS`` partial groups, so that a digest with
    a third of all rows brings its shard that many rows at most.
    """
    partial = digests.groupBy("digest", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)).alias("salt")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return _sharded(partial, shards).groupBy("shard").applyInPandas(_build_shard, "digest binary, keep_id long, group_size long")


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex(len(rows))
    for digest, doc_id, n in zip(rows["digest"], _ids(rows["doc_id"]), rows["n"]):
        _merge(index, bytes(digest), doc_id, int(n))
    return _entries(index)


def update_index(index: DataFrame, batch: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """The index after a batch of (digest, doc_id, op) rows, op 'insert' or 'delete'.

    ``members`` (digest, doc_id) are the copies that the index was made of, a row each. Deletions
    apply before insertions. A deletion takes one copy of its doc_id off its digest's group, as
    often as there are copies of that id; the digest leaves the index with the last. The largest
    id of which a copy is left stays. Deleting what isn't live does nothing.
    """
    gone, new = batch.where("op = 'delete'"), batch.where("op = 'insert'")
    touched = members.join(gone.select("digest").distinct(), "digest", "left_semi")
    both = touched.select("digest", "doc_id", F.lit(1).alias("have"), F.lit(0).alias("drop")).unionAll(gone.select("digest", "doc_id", F.lit(0), F.lit(1)))
    each = both.groupBy("digest", "doc_id").agg(F.sum("have").alias("have"), F.least(F.sum("have"), F.sum("drop")).alias("drop"))
    heir = F.max(F.when(F.col("have") > F.col("drop"), F.col("doc_id")))
    old = each.groupBy("digest").agg(heir.alias("doc_id"), F.sum("drop").alias("n")).where("n > 0").select("digest", F.lit("delete").alias("op"), "doc_id", "n")
    counted = old.unionByName(new.groupBy("digest", "op").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")))

    def apply(key, live: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(live) + len(rows))
        for digest, keep, n in zip(live["digest"], _ids(live["keep_id"]), live["group_size"]):
            index.insert(bytes(digest), (keep, int(n)))
        old = rows[rows["op"] == "delete"]
        for digest, n, heir in zip(old["digest"], old["n"], _ids(old["doc_id"])):
            held = index.get(bytes(digest))
            if held is not None:
                index.delete(bytes(digest))
                if held[1] > n:
                    index.insert(bytes(digest), (heir, held[1] - int(n)))
        new = rows[rows["op"] == "insert"]
        for digest, doc_id, n in zip(new["digest"], _ids(new["doc_id"]), new["n"]):
            _merge(index, bytes(digest), doc_id, int(n))
        return _entries(index)

    return _sharded(index, shards).groupBy("shard").cogroup(_sharded(counted, shards).groupBy("shard")).applyInPandas(apply, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    Null and empty texts form one group. Repeated rows count in group_size and share one
    decision; a null id never wins against a number, and a group of null ids keeps null. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    digests = write_table(content_digests(docs, id_col, text_col), "digests", TEXT_ROWS)
    shards = max(partitions(spark), -(-digests.count() // SHARD_ROWS))
    index = build_index(digests, shards)
    return digests.join(index, "digest", "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
