"""Token-id files of directly addressable codes.

Layout of a file (little-endian): segments, then the offset of each segment as uint64, their
number as uint64 and ``MAGIC``. A segment:

    MAGIC, n_docs uint64, n_tokens uint64, n_levels uint64, n_levels x entries uint64
    doc ids int64 x n_docs, first token of each document uint64 x (n_docs + 1)
    per level: chunk bytes padded to 8; continuation bitmap as uint64 words; rank directory:
    number of set bits before each 512-bit block as uint64

Level 0 holds the low byte of every id and a bit that says whether the id goes on; level j + 1
holds the next byte of those that go on, in order. The place of a token's next byte is the
rank of its bit, so any token is read with one byte, one block of bitmap and one directory
entry a level.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import tidy
from .shared import new_path, partitions, write_table
from .tokens import encoder

MAGIC = b"TDAC0001"
#: Tokens of a segment: what writer and reader hold at a time (a longer document is one segment).
SEGMENT_TOKENS = 2 << 20
_BLOCK = 512


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // _BLOCK) * 8, "<u8")
        words.view(np.uint8)[: len(bits)] = bits
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words.reshape(-1, 8)).sum(1, dtype=np.uint64))))[:-1].astype("<u8")
        out.append(((rest & 255).astype(np.uint8), words, ranks))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return out


def write_segment(out, doc_ids: list, lengths: list[int], ids: np.ndarray) -> int:
    """Append a segment; its size in bytes. A null doc id is written as the smallest int64."""
    levels = _levels(ids)
    low = np.iinfo(np.int64).min
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels), *(len(c) for c, _, _ in levels)], "<u8").tobytes()]
    parts += [np.array([low if d is None else d for d in doc_ids], "<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()]
    for chunks, words, ranks in levels:
        parts += [chunks.tobytes(), bytes(-len(chunks) % 8), words.tobytes(), ranks.tobytes()]
    for part in parts:
        out.write(part)
    return sum(map(len, parts))


class SegmentReader:
    """One segment of an open file; reads no more than it is asked for."""

    def __init__(self, source, at: int):
        self.source = source
        head = self._read(at, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_tokens, levels = (int(x) for x in np.frombuffer(head, "<u8", 3, 8))
        self.entries = [int(x) for x in np.frombuffer(self._read(at + 32, 8 * levels), "<u8")]
        self.ids_at = at + 32 + 8 * levels
        self.starts_at = self.ids_at + 8 * self.n_docs
        at = self.starts_at + 8 * (self.n_docs + 1)
        self.places = []
        for n in self.entries:
            words = at + n + -n % 8
            ranks = words + -(-n // _BLOCK) * 64
            self.places.append((at, words, ranks))
            at = ranks + -(-n // _BLOCK) * 8

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._read(self.ids_at, 8 * self.n_docs), "<i8")

    def doc_starts(self) -> np.ndarray:
        return np.frombuffer(self._read(self.starts_at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """The i-th id of the segment, by one byte and one rank a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, words, ranks) in enumerate(self.places):
            value |= self._read(chunks + i, 1)[0] << (8 * level)
            block = np.frombuffer(self._read(words + i // _BLOCK * 64, 64), "<u8")
            word, bit = divmod(i % _BLOCK, 64)
            if not int(block[word]) >> bit & 1:
                break
            before = int(np.frombuffer(self._read(ranks + i // _BLOCK * 8, 8), "<u8")[0])
            i = before + int(np.bitwise_count(block[:word]).sum()) + (int(block[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def tokens(self) -> np.ndarray:
        """All ids of the segment."""
        out, where = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for level, (n, (chunks, words, _)) in enumerate(zip(self.entries, self.places)):
            out[where] |= np.frombuffer(self._read(chunks, n), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(np.frombuffer(self._read(words, -(-n // 8)), np.uint8), count=n, bitorder="little").astype(bool)
            where = where[more]
        return out


def segments(source) -> list[SegmentReader]:
    size = source.seek(0, io.SEEK_END)
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file")
    n = int(np.frombuffer(tail, "<u8", 1)[0])
    source.seek(size - 16 - 8 * n)
    return [SegmentReader(source, int(at)) for at in np.frombuffer(source.read(8 * n), "<u8")]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each with ``end_id`` behind, in ascending doc_id order.

    Tasks write to ``folder`` (a new one in the shared folder if None), which must be a path
    that Arrow's file systems can open. Returns the manifest: path, first_doc, n_docs,
    n_tokens, start (ids in the files before). Only files of the manifest count, so what a
    lost or repeated task leaves is ignored. Null and empty texts are the end id alone; null
    ids come first; repeated rows are written each. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def write(batches):
        encode, out, offsets, first = None, None, [], None
        docs_, lengths, parts, held = [], [], [], 0
        total, n_docs, size = 0, 0, 0

        def close_segment():
            nonlocal docs_, lengths, parts, held, size
            if docs_:
                offsets.append(size)
                size += write_segment(out, docs_, lengths, np.concatenate(parts))
                docs_, lengths, parts, held = [], [], [], 0

        for batch in batches:
            if out is None and batch.num_rows:
                store, path = fs.FileSystem.from_uri(folder)
                name = f"{uuid.uuid4().hex}.dac"
                out, encode, first = store.open_output_stream(f"{path}/{name}"), encoder(tokenizer_path, lower).encode, batch.column(0)[0].as_py()
            for a, b, ids, at in encode(batch.column(1)) if batch.num_rows else ():
                for row, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    own = np.append(ids[at[row] : at[row + 1]], np.uint32(end_id))
                    docs_.append(doc)
                    lengths.append(len(own))
                    parts.append(own)
                    held, total, n_docs = held + len(own), total + len(own), n_docs + 1
                    if held >= SEGMENT_TOKENS:
                        close_segment()
        if out is not None:
            close_segment()
            out.write(np.array([*offsets, len(offsets)], "<u8").tobytes() + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], ["path", "first_doc", "n_docs", "n_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = chosen.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    files = write_table(dealt.mapInArrow(tidy(write), "path string, first_doc long, n_docs long, n_tokens long"), "manifest")
    # one row a file
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian
    unsigned 32-bit integers, start the number of ids before it over all files."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    for segment in segments(source):
                        ids, at, docs = segment.tokens().astype("<u4"), segment.doc_starts(), segment.doc_ids()
                        for row in range(0, len(docs), 1000):
                            end = min(row + 1000, len(docs))
                            made = [ids[at[i] : at[i + 1]].tobytes() for i in range(row, end)]
                            null = docs[row:end] == np.iinfo(np.int64).min
                            yield pa.RecordBatch.from_arrays([pa.array(docs[row:end], mask=null), pa.array(start + at[row:end]), pa.array(np.diff(at[row : end + 1])), pa.array(made, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        start += len(ids)

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids binary")
