"""Packing along a space-filling curve: neighbours on the Hilbert curve share sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, span_hashes, text_chunks, tidy, word_spans
from .shared import partitions
from .tokens import encoder

DIMENSIONS, BITS = 3, 10
#: Width of the hashed word vector that is projected.
FEATURES = 4096
_PROJECT = np.random.default_rng(11).standard_normal((FEATURES, DIMENSIONS)).astype(np.float32)
#: Documents in one stretch of the curve, about; a stretch is packed by itself.
STRETCH_DOCS = 8192


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows; one column a dimension)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


def curve_keys(column: pa.Array, ids: pa.Array) -> np.ndarray:
    """Sort keys: the Hilbert key of the projected hashed word vector, then a hash of the id,
    so that copies of one text, which share their cell, can still be dealt apart."""
    out = np.zeros(len(column), np.uint64)
    for first, last, data, offsets in text_chunks(column):
        starts, ends, head = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        sign = np.where(words >> np.uint64(63), 1, -1).astype(np.float32)
        spread = np.zeros((len(words) + 1, DIMENSIONS))
        np.cumsum(_PROJECT[words % np.uint64(FEATURES)] * sign[:, None], 0, out=spread[1:])
        mean = (spread[head[1:]] - spread[head[:-1]]) / np.maximum(head[1:] - head[:-1], 1)[:, None]
        cells = ((np.arctan(4 * mean) / np.pi + 0.5) * (1 << BITS)).astype(np.int64)
        out[first:last] = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))
    own = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return ((out << np.uint64(32)) | (own >> np.uint64(32))).view(np.int64)


def _pieces(length: int, pending: list[tuple]) -> list[list[tuple]]:
    """Cut the last, short sequence of a stretch into powers of two, which need no padding."""
    total, out = sum(len(p[2]) for p in pending), []
    sizes = [1 << b for b in range(length.bit_length(), -1, -1) if total >> b & 1]
    for size in sizes:
        own = []
        while size:
            doc, start, ids, n = pending[0]
            if len(ids) <= size:
                own.append(pending.pop(0))
                size -= len(ids)
            else:
                own.append((doc, start, ids[:size], n))
                pending[0] = (doc, start + size, ids[size:], n)
                size = 0
        out.append(own)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; ``ids`` is a piece's ids as little-endian unsigned
    32-bit integers. Documents follow each other in the order of a Hilbert curve through the
    projections of their hashed word vectors; the curve is cut at approximate quantiles into
    stretches of about equal numbers of documents, and each stretch fills sequences of
    ``length`` one after the other. Its rest becomes sequences of a power of two, so nothing
    is padded. Null and empty texts are the end id alone; repeated rows are packed each by
    themselves, null ids too. Other columns are not read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(batch.column(1), batch.column(0)))], ["k"])

    n = partitions(spark)
    total = docs.count()
    stretches = max(4 * n, -(-total // STRETCH_DOCS))
    cuts = docs.mapInArrow(tidy(keys), "k long").select(F.percentile_approx("k", [i / stretches for i in range(1, stretches)], 20 * stretches)).first()[0]
    cuts = np.array(cuts or [], np.int64)

    def tokenize(batches):
        encode = encoder(tokenizer_path, False).encode
        for batch in batches:
            ks = curve_keys(batch.column(1), batch.column(0))
            for a, b, ids, offsets in encode(batch.column(1)):
                rows = [np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4" if end_id > 65535 or len(ids) and ids.max() > 65535 else "<u2") for i in range(b - a)]
                width = pa.array([x.itemsize for x in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, ks[a:b]).astype(np.int32)), pa.array(ks[a:b]), batch.column(0).slice(a, b - a), width, pa.array([x.tobytes() for x in rows], pa.binary())], ["stretch", "k", "doc_id", "width", "ids"])

    def fill(batches):
        stretch, pending, held, count, out = None, [], 0, 0, []

        def emit(pieces):
            nonlocal count
            offset = 0
            for doc, start, ids, n in pieces:
                out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, (stretch << 32) + count, offset))
                offset += len(ids)
            count += 1

        def flush():
            cols = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for s, doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if s != stretch:
                    for pieces in _pieces(length, pending):
                        emit(pieces)
                    stretch, pending, held, count = s, [], 0, 0
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - held]
                    pending.append((doc, start, part, len(ids)))
                    start, held = start + len(part), held + len(part)
                    if held == length:
                        emit(pending)
                        pending, held = [], 0
                if len(out) >= 2000:
                    yield flush()
        for pieces in _pieces(length, pending):
            emit(pieces)
        yield flush()

    made = docs.mapInArrow(tidy(tokenize), "stretch int, k long, doc_id long, width int, ids binary")
    return made.repartition(n, "stretch").sortWithinPartitions("stretch", "k", "doc_id").mapInArrow(tidy(fill), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
