"""Interpolated modified Kneser-Ney over byte n-grams, in tables sharded by context.

A gram of ``k`` bytes is one long: its side (which half of the training texts it is from)
above its bytes. Counts, context totals and probabilities are tables joined on grams and
contexts; they grow with the text. Only orders up to LOW, of which there can be 2 * 256 ** LOW
grams, reach the driver.

Documents are scored in blocks. A block asks for each of its distinct grams once; the requests
meet the model in shards of the last two context bytes, which a gram, its contexts and all its
shorter forms have in common, and the answers are joined with the block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK, text_chunks, tidy
from .shared import batches_of, drop_path, drop_tables, new_path, partitions, write_table

ORDER, LOW = 5, 2
#: Bytes of text in a block, the unit that asks the model and is scored.
BLOCK_BYTES = 16 << 20
#: Rows of the model in a shard, about, and blocks that ask one copy of it.
SHARD_ROWS, ASKING = 250_000, 8
#: Distinct grams that a counting task holds before it sums them up.
HELD = 1 << 20
#: Rows of texts, and of blocks, that a Python worker gets at a time.
TEXT_ROWS, BLOCK_ROWS = 500, 8
_MODEL = -1


def discounts(of_counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of
    grams with counts of 1 to 4; where those are too few for it, half the count."""
    n = [of_counts.get(i, 0) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    made = [(i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) / 2 for i in range(3)]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(made)]


def byte_grams(data: np.ndarray, offsets: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte; every row begins behind ORDER - 1 zero bytes."""
    size = np.diff(offsets)
    line = np.zeros(len(data) + (ORDER - 1) * len(size), np.uint8)
    at = np.arange(len(data)) + (ORDER - 1) * np.repeat(np.arange(1, len(size) + 1), size)
    line[at] = data
    out = np.repeat(side.astype(np.int64), size)
    for back in range(ORDER - 1, -1, -1):
        out = (out << 8) | line[at - back]
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, index = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(index, np.concatenate(counts), len(found)).astype(np.int64)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(g, c) of all ORDER-grams of ``texts`` (side, text); tasks count before the shuffle."""

    def count(batches):
        keys, counts = [], []
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(batch.column(1)):
                g, n = np.unique(byte_grams(data, offsets, side[first:last]), return_counts=True)
                keys.append(g)
                counts.append(n)
                if sum(map(len, keys)) > HELD:
                    (g, n), keys, counts = _summed(keys, counts), [], []
                    keys.append(g)
                    counts.append(n)
                    if len(g) > HELD // 2:
                        yield _rows(["g", "c"], g, n)
                        keys, counts = [], []
        if keys:
            yield _rows(["g", "c"], *_summed(keys, counts))

    counted = texts.select("side", "text").mapInArrow(tidy(count), "g long, c long")
    return counted.groupBy("g").agg(F.sum("c").alias("c"))


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _shorter(g: Column, order: int) -> Column:
    """A gram of ``order`` bytes without its first one."""
    bits = 8 * (order - 1)
    return F.shiftleft(F.shiftright(g, 8 * order), bits).bitwiseOR(g.bitwiseAND((1 << bits) - 1))


def byte_model(counts: DataFrame) -> DataFrame:
    """(kind, key, value): kind 2k has log p of each seen gram of k bytes, kind 2k + 1 the log of
    the weight that each seen context of k - 1 bytes leaves to lower orders.

    Counts below the highest order are continuation counts; below order 1 all 256 bytes are
    equally likely. For each order counts are joined with their contexts' totals and with the
    probabilities of the order below.
    """
    levels, made = [], []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            counts = counts.groupBy(_shorter(F.col("g"), order + 1).alias("g")).agg(F.count("*").alias("c"))
        counts = write_table(counts, f"grams{order}")
        levels.append(counts)
    below = None
    for order, counts in zip(range(1, ORDER + 1), levels[::-1]):
        side = F.shiftright("g", 8 * order)
        few = counts.where("c <= 4").groupBy(side.alias("side"), "c").agg(F.count("*").alias("n")).collect()
        cut = F.lit(0.0)
        for number in (0, 1):
            d = discounts({r["c"]: r["n"] for r in few if r["side"] == number})
            cut = F.when(side == number, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
        x = F.shiftright("g", 8).alias("x")
        totals = write_table(counts.groupBy(x).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("rest")), f"contexts{order}")
        own = counts.select("g", x, (F.col("c") - cut).alias("own")).join(totals, "x")
        own = own.select("g", (F.col("own") / F.col("total")).alias("share"), "rest")
        if below is None:
            p = own.select("g", (F.col("share") + F.col("rest") / 256).alias("p"))
        else:
            joined = own.withColumn("lower", _shorter(F.col("g"), order)).join(below, "lower")
            p = joined.select("g", (F.col("share") + F.col("rest") * F.col("below")).alias("p"))
        p = write_table(p, f"shares{order}")
        below = p.select(F.col("g").alias("lower"), F.col("p").alias("below"))
        made += [(2 * order, p, p.select("g", F.log("p"))), (2 * order + 1, totals, totals.select("x", F.log("rest")))]
    parts = [rows.toDF("key", "value").select(F.lit(kind).alias("kind"), "key", F.col("value").cast("float").alias("value")) for kind, _, rows in made]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    out = write_table(out, "model")
    drop_tables(*levels, *(t for _, t, _ in made))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, their differences compressed."""
    return len(keys).to_bytes(8, "little") + pa.compress(np.diff(keys, prepend=0).astype("<i8").tobytes(), "zstd", asbytes=True)


def unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), "<i8")) if n else np.zeros(0, np.int64)


def _look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and its value or 0."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, np.where(hit, values[at], np.float32(0))


def log_probabilities(grams: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log p of ORDER-grams from the model's tables by kind: the longest seen form of a gram, and
    what the longer contexts leave to it."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.float32))
    out, open_ = np.zeros(len(grams)), np.arange(len(grams))
    for order in range(ORDER, 0, -1):
        own = grams[open_]
        g = (own >> (8 * ORDER) << (8 * order)) | (own & ((1 << 8 * order) - 1))
        seen, value = _look_up(g, tables.get(2 * order, empty))
        left = _look_up(g >> 8, tables.get(2 * order + 1, empty))[1]
        out[open_] += np.where(seen, value, left)
        open_ = open_[~seen]
    out[open_] -= np.log(256)
    return out.astype(np.float32)


def _shard(pair, shards: int):
    """The shard of the last two bytes of a context, for columns and for arrays."""
    if isinstance(pair, Column):
        return F.shiftright((pair * 40503).bitwiseAND(0xFFFF) * shards, 16).cast("int")
    return ((pair * 40503 & 0xFFFF) * shards >> 16).astype(np.int64)


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, rows): the rows of ``docs`` in blocks of about so many bytes of text (or of one
    longer text). A block is a number of its own; it has a row for each CHUNK of text or so,
    compressed, which stand behind each other."""

    def blocks(batches):
        block, size = uuid.uuid4().int >> 65, 0
        for batch in batches:
            at = 0
            for _, end, data, _ in text_chunks(batch.column("text"), min(CHUNK, block_bytes)):
                if size and size + len(data) > block_bytes:
                    block, size = uuid.uuid4().int >> 65, 0
                part, sink = batch.slice(at, end - at), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield _rows(["block", "rows"], [block], pa.array([sink.getvalue().to_pybytes()], pa.binary()))
                at, size = end, size + len(data)

    return docs.mapInArrow(tidy(blocks), "block long, rows binary")


def _opened(raw) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(raw.as_buffer()) as source:
        yield from source


def _sides(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("side").to_numpy(zero_copy_only=False)


def _requests(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, keys): the distinct grams of each block, by shard. A block that is read in
    several tasks asks in each."""

    def requests(block, keys):
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        of = _shard(found >> 8 & 0xFFFF, shards)
        made = [pack_keys(found[of == s]) for s in range(shards)]
        return _rows(["shard", "block", "keys"], pa.array(range(shards), pa.int32()), pa.array([block] * shards, pa.int64()), pa.array(made, pa.binary()))

    def ask(batches):
        own, keys = None, []
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != own:
                    if own is not None:
                        yield requests(own, keys)
                    own, keys = block, []
                for rows in _opened(raw):
                    side = _sides(rows)
                    for first, last, data, offsets in text_chunks(rows.column("text")):
                        keys.append(np.unique(byte_grams(data, offsets, side[first:last])))
                        if sum(map(len, keys)) > HELD:
                            keys = [np.unique(np.concatenate(keys))]
        if own is not None:
            yield requests(own, keys)

    return blocks.mapInArrow(tidy(ask), "shard int, block long, keys binary")


def _packed_model(model: DataFrame, shards: int) -> DataFrame:
    """(shard, block, keys, values), block _MODEL: a shard's tables above order LOW, one row a kind."""
    pair = F.when(F.col("kind") % 2 == 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(0xFFFF)

    def pack(rows: pa.Table) -> pa.Table:
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        out = []
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own], kind="stable")]
            out.append((int(rows.column("shard")[0].as_py()), _MODEL - k, pack_keys(key[own]), value[own].astype("<f4").tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "keys", "values"])

    high = model.where(F.col("kind") >= 2 * (LOW + 1)).withColumn("shard", _shard(pair, shards))
    return high.groupBy("shard").applyInArrow(pack, "shard int, block long, keys binary, values binary")


def _answers(requests: DataFrame, model: DataFrame, shards: int, copies: int) -> DataFrame:
    """(block, keys, values): log p of the keys of each request. A task streams the requests to
    a copy of a shard past the shard's tables, which stand before them."""
    spark = requests.sparkSession
    low = {}
    for r in model.where(F.col("kind") < 2 * (LOW + 1)).collect():
        low.setdefault(r["kind"], []).append((r["key"], r["value"]))
    low = {k: (np.array([x for x, _ in sorted(v)], np.int64), np.array([y for _, y in sorted(v)], np.float32)) for k, v in low.items()}
    shared = spark.sparkContext.broadcast(low)

    def answer(batches):
        place, tables = None, {}
        for batch in batches:
            blocks, keys, values = [], [], []
            for shard, copy, block, raw, own in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                if (shard, copy) != place:
                    place, tables = (shard, copy), dict(shared.value)
                found = unpack_keys(raw.as_py())
                if block < 0:
                    tables[_MODEL - block] = (found, np.frombuffer(own.as_py(), "<f4"))
                elif len(found):
                    blocks.append(block)
                    keys.append(raw.as_py())
                    values.append(log_probabilities(found, tables).astype("<f4").tobytes())
            yield _rows(["block", "keys", "values"], pa.array(blocks, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()))

    every = _packed_model(model, shards).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = requests.withColumn("copy", F.pmod("block", F.lit(copies)).cast("int")).withColumn("values", F.lit(None).cast("binary"))
    names = ["shard", "copy", "block", "keys", "values"]
    rows = every.select(names).unionAll(asked.select(names))
    dealt = rows.repartition(max(partitions(spark), shards * copies), "shard", "copy").sortWithinPartitions("shard", "copy", "block")
    return dealt.mapInArrow(tidy(answer), "block long, keys binary, values binary")


def _scored(rows: pa.RecordBatch, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """(doc_id, lang, text_key, perplexity) of a part of a block, by log p of its sorted grams."""
    side, out = _sides(rows), np.full(rows.num_rows, np.nan)
    for first, last, data, offsets in text_chunks(rows.column("text")):
        grams, where = np.unique(byte_grams(data, offsets, side[first:last]), return_inverse=True)
        log = values[np.searchsorted(keys, grams)].astype(np.float64)[where] if len(grams) else np.zeros(0)
        total, n = np.concatenate(([0.0], np.cumsum(log))), np.diff(offsets)
        mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
        out[first:last] = np.where(n > 0, np.exp(-mean), np.nan)
    same = ("doc_id", "lang", "text_key")
    return _rows([*same, "perplexity"], *(rows.column(c) for c in same), pa.array(out, mask=np.isnan(out)))


def byte_perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, text_key, perplexity) a byte, of ``docs`` (doc_id, lang, text_key, side,
    text); null for texts without bytes. The result is a written table."""
    spark = docs.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    # bucketed by block: the join below moves the answers and leaves the texts where they are
    blocks = text_blocks(docs.select("doc_id", "lang", "text_key", "side", "text"), BLOCK_BYTES)
    with batches_of(spark, TEXT_ROWS):
        blocks.write.bucketBy(partitions(spark), "block").option("path", path).saveAsTable(name)
    try:
        held = spark.table(name)
        shards = max(1, -(-model.count() // SHARD_ROWS))
        copies = max(1, -(-held.select("block").distinct().count() // ASKING))
        requests = write_table(_requests(held, shards), "requests", BLOCK_ROWS)
        answers = write_table(_answers(requests, model, shards, copies), "answers", BLOCK_ROWS)
        drop_tables(requests)

        def score(rows: pa.Table, known: pa.Table) -> pa.Table:
            keys = [np.zeros(0, np.int64), *map(unpack_keys, known.column("keys").to_pylist())]
            values = [np.zeros(0, "<f4"), *(np.frombuffer(v, "<f4") for v in known.column("values").to_pylist())]
            keys, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(keys)
            return pa.Table.from_batches([_scored(part, keys[order], value[order]) for raw in rows.column("rows") for part in _opened(raw)])

        made = "doc_id long, lang string, text_key long, perplexity double"
        scored = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, made)
        out = write_table(scored, "perplexities", BLOCK_ROWS)
        drop_tables(answers)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)
    return out
