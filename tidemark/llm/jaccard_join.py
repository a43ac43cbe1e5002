"""N-gram Jaccard join: tiles of size bands, bitmap signatures, exact intersection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import mix, shingles, tidy
from .near_dedup import linked, shingle_sets, texts_of
from .shared import drop_tables, without, write_table

#: Counters of how often shingles occur, by the top bits of their hash; fixed at every size.
COUNTER_BITS, SLAB = 20, 1 << 13
#: Rows of texts, and of pairs of sets, that a Python worker gets at a time.
TEXT_ROWS, PAIR_ROWS = 2_000, 500
#: Most classes, and most bytes of their sets, in one block of a tile.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows in one pass over the texts: (doc_id, n_shingles, set_key) of each
    document, and (slab, counts) of each task: in how many of its documents shingles occur."""
    top = np.uint64(64 - COUNTER_BITS)

    def sketch(batches):
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            sizes, keys, held = [], [], []
            for _, found in shingles(batch.column(1), k):
                found = np.unique(found)
                sizes.append(len(found))
                keys.append(found.sum(dtype=np.uint64).tobytes() + mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes())
                held.append((found >> top).astype(np.int64))
                if len(held) == 1000:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        slabs = [(i, s.tobytes()) for i, s in enumerate(counts.astype(np.int32).reshape(-1, SLAB)) if s.any()]
        none = pa.nulls(len(slabs))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([i for i, _ in slabs], pa.int32()), pa.array([s for _, s in slabs], pa.binary())], names)

    names = ["doc_id", "n_shingles", "set_key", "slab", "counts"]
    return docs.select("doc_id", "text").mapInArrow(tidy(sketch), "doc_id long, n_shingles long, set_key binary, slab int, counts binary")


def frequencies(sketch: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: 2**COUNTER_BITS numbers, whatever the input."""

    def add(key, rows):
        total = sum(np.frombuffer(c.as_buffer(), np.int32).astype(np.int64) for c in rows["counts"])
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    out = np.zeros(1 << COUNTER_BITS, np.int32).reshape(-1, SLAB)
    for row in sketch.where("slab IS NOT NULL").select("slab", "counts").groupBy("slab").applyInArrow(add, "slab int, counts binary").collect():
        out[row.slab] = np.frombuffer(row.counts, np.int32)
    return out.reshape(-1)


def prefixes(docs: DataFrame, k: int, percent: int, frequency: np.ndarray) -> DataFrame:
    """(token, rep, n, head): each document's rarest shingles, one of which any linked document
    must have among its own. ``head`` marks those that do for the smaller one of a pair."""
    top = np.uint64(64 - COUNTER_BITS)

    def rare(batches):
        for batch in batches:
            tokens, owner, size, head = [], [], [], []
            ids = batch.column(0).to_pylist()
            for row, found in shingles(batch.column(1), k):
                found = np.unique(found)
                n = len(found)
                if not n:
                    continue
                p = n - -(-percent * n // 100) + 1
                h = n - -(-2 * percent * n // (100 + percent)) + 1
                order = np.argsort(frequency[(found >> top).astype(np.int64)], kind="stable")[:p]
                tokens.append(found[order].view(np.int64))
                owner.append(np.full(p, ids[row]))
                size.append(np.full(p, n))
                head.append(np.arange(p) < h)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owner, size, head)], ["token", "rep", "n", "head"])

    return docs.select("doc_id", "text").mapInArrow(tidy(rare), "token long, rep long, n long, head boolean")


def parity_signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """Bitmap of ``width`` bits (a power of two, 64 at least): a bit tells if an odd number of
    hashes fall on it. Common elements of two sets cancel, so their bitmaps differ in no more
    bits than there are elements in only one of them; and a narrower bitmap is a folded wide one."""
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def width_for(n: int) -> int:
    """Bits for sets of about n elements: two to four for each."""
    return max(64, 1 << (2 * n - 1).bit_length())


def folded(signature: np.ndarray, width: int) -> np.ndarray:
    while 64 * len(signature) > width:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return signature


def _may_link(na, nb, differing, percent: int):
    """Whether the most elements that two sets can share, by what their bitmaps tell, are enough."""
    most = (na + nb - differing) // 2
    return 100 * most >= percent * (na + nb - most)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, signature): the sizes and bitmaps of documents' shingle sets."""

    def sign(batches):
        for batch in batches:
            made = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch.column(2)]
            signature = [parity_signature(h, width_for(len(h))).tobytes() for h in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signature, pa.binary())], ["id", "n", "signature"])

    return shingle_sets(docs, k).where("n > 0").mapInArrow(tidy(sign), "id long, n long, signature binary")


def unrefuted(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out."""

    def test(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                width = 64 * min(len(x), len(y))
                differing = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                keep.append(bool(_may_link(na, nb, differing, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(signed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("y")), "b")
    both = one.join(signed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("x")), "a")
    fit = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return fit.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(test), "a long, b long")


def _by_tile(rows) -> list[np.ndarray]:
    """The row numbers of each tile in a group."""
    token = np.unique(rows["token"].to_numpy(), return_inverse=True)[1]
    return np.split(np.argsort(token, kind="stable"), np.cumsum(np.bincount(token))[:-1])


def _met(i: int, side: np.ndarray, size: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """The rows of a tile that row i is held against: of the other block, or after it in its own;
    of another component and a size that can be linked."""
    later = side != 1 if side[i] == 1 else np.arange(len(side)) > i
    return np.flatnonzero(later & apart & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))


def _tile_suspects(percent: int):
    """The rows of each tile whose bitmap refutes not all links to other components."""

    def mark(key, rows):
        n, side, of = (rows[c].to_numpy() for c in ("n", "side", "component"))
        wide = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["signature"].combine_chunks()]
        kept = np.zeros(len(n), bool)
        for tile in _by_tile(rows):
            size, part, comp = n[tile], side[tile], of[tile]
            lengths = np.array([len(wide[i]) for i in tile])
            for length in np.unique(lengths):
                width = 64 * int(length)
                # a link's sizes differ by less than two, so its widths by one step at most
                own = np.flatnonzero((lengths == length) | (lengths == 2 * length))
                signature = np.stack([folded(wide[i], width) for i in tile[own]])
                for x in np.flatnonzero(part[own] != 2):
                    y = _met(x, part[own], size[own], comp[own] != comp[own[x]], percent)
                    if len(y):
                        differing = np.bitwise_count(signature[y] ^ signature[x]).sum(1, dtype=np.int64)
                        y = y[_may_link(size[own[y]], size[own[x]], differing, percent)]
                        if len(y):
                            kept[tile[own[y]]] = kept[tile[own[x]]] = True
        return rows.drop_columns(["signature"]).filter(pa.array(kept))

    return mark


def _tile_links(percent: int):
    """Links between different components within each tile of a group by exact intersection of
    sorted sets, unless links before join the two."""

    def compare(key, rows):
        out_a, out_b = [], []
        n, rep, side, of = (rows[c].to_numpy() for c in ("n", "rep", "side", "component"))
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows["hashes"].combine_chunks()]
        for tile in _by_tile(rows):
            names, comp = np.unique(of[tile], return_inverse=True)
            parent, size, part = np.arange(len(names)), n[tile], side[tile]
            for i in np.flatnonzero(part != 2):
                x = sets[tile[i]]
                for o in _met(i, part, size, parent[comp] != parent[comp[i]], percent):
                    if parent[comp[o]] == parent[comp[i]]:
                        continue
                    y = sets[tile[o]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out_a.append(rep[tile[i]])
                        out_b.append(rep[tile[o]])
                        parent[parent == parent[comp[o]]] = parent[comp[i]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return compare


def tile_links(tiles: DataFrame, comps: DataFrame, signed: DataFrame, percent: int, sets_of) -> DataFrame:
    """Links between different components that share a tile, as many as join what all would.

    Bitmaps first tell which rows of a tile may be linked at all; only those bring their sets,
    ``sets_of`` (ids), to be intersected.
    ``tiles`` (token, band, rep, n). A tile that fits in a block is compared in one task, many
    small ones together; a larger one is cut into blocks by size band, and each block meets the
    blocks of its own band and of the next one. Of tiles with equal members one is compared.
    """
    rows = tiles.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    digest = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(20,0)")).alias(f"digest{i}") for i in range(2)]
    held = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum(8 * F.col("n")).alias("bytes"), *digest)
    held = held.where("m > 2 AND c0 <> c1").groupBy("m", "digest0", "digest1").agg(F.min_by(F.struct("token", "bytes"), "token").alias("t")).select("t.token", "m", "t.bytes")
    open_ = write_table(rows.join(held, "token"), "open-tiles")
    whole = (F.col("m") <= BLOCK_ROWS) & (F.col("bytes") <= BLOCK_BYTES)
    groups = max(1, open_.where(whole).count() // BLOCK_ROWS)
    columns = ["token", "rep", "n", "component"]
    small = open_.where(whole).select(*columns, F.lit(0).alias("side"), F.pmod(F.xxhash64("token"), F.lit(groups)).alias("block"))
    large = open_.where(~whole)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("blocks")
    bands = large.groupBy("token", "band").agg(blocks)
    near = bands.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("band").alias("met"), F.col("blocks").alias("met_blocks"))
    dealt = large.join(bands, ["token", "band"]).join(near, ["token", "band"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met_blocks") - 1)))
    mine, met = F.struct("band", "own"), F.struct(F.col("met").alias("band"), F.col("other").alias("own"))
    side = F.when(mine == met, 0).when(mine < met, 1).otherwise(2).alias("side")
    dealt = dealt.select(*columns, side, F.xxhash64("token", F.least(mine, met), F.greatest(mine, met)).alias("block"))
    every = small.unionByName(dealt).join(signed.select(F.col("id").alias("rep"), "signature"), "rep").select(*columns, "side", "block", "signature")
    schema = "token long, rep long, n long, component long, side int, block long"
    suspects = write_table(every.groupBy("block").applyInArrow(_tile_suspects(percent), schema), "suspects")
    sets = sets_of(suspects.select("rep"))
    full = suspects.join(sets.select(F.col("id").alias("rep"), "hashes"), "rep")
    links = write_table(full.groupBy("block").applyInArrow(_tile_links(percent), "a long, b long").distinct(), "links")
    drop_tables(open_, suspects, sets)
    return links


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents whose sets of distinct k-word shingles (A-Z lower-cased) have a Jaccard similarity
    of ``percent`` / 100 or more are linked; component_id is the smallest doc_id reachable. The
    join is exact. Linked documents share one of their rarest shingles, so a tile is what shares
    such a shingle; within it only sizes of the same or the next band can be linked. In each
    band of a tile all are held against the smallest id, in those tiles that this leaves in more
    than one component all against all, in blocks. Bitmaps bound each overlap from above first.

    With fewer than k words the whole sequence is the one shingle; null, empty and blank texts
    have none and stay alone. Equal sets are one from the start. Rows of one doc_id are one
    document as to links, whatever their texts, and each has its row; rows with a null id keep a
    null component. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = write_table(sketches(docs, k), "sketches", TEXT_ROWS)
    rows = sketch.where("slab IS NULL").drop("slab", "counts")
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = write_table(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    of = filled.join(classes, "set_key")
    copies = of.groupBy("doc_id").agg(F.min(F.col("rep") != F.col("doc_id")).alias("copy")).where("copy")
    tokens = prefixes(without(docs.where("doc_id IS NOT NULL"), copies), k, percent, frequencies(sketch))
    same_token = Window.partitionBy("token")
    # a little wider than the similarity, so that rounding can't put a link's sizes two bands apart
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * 1.0001 if percent < 100 else 1.0)).cast("int")
    shared = tokens.withColumn("m", F.count("*").over(same_token)).withColumn("small", F.max("head").over(same_token)).where("m > 1 AND small")
    tiles = write_table(shared.select("token", band.alias("band"), "rep", "n"), "tiles", TEXT_ROWS)
    ids = write_table(tiles.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    signed = write_table(signatures(texts_of(docs, ids, ids.count()), k), "signatures", TEXT_ROWS)

    def sets_of(ids: DataFrame) -> DataFrame:
        """The sets of so few documents as are still suspected."""
        few = write_table(ids.toDF("doc_id").distinct(), "ids")
        sets = write_table(shingle_sets(texts_of(docs, few, few.count()), k), "sets", TEXT_ROWS)
        drop_tables(few)
        return sets

    hubs = tiles.groupBy("token", "band").agg(F.min("rep").alias("hub"))
    stars = tiles.join(hubs, ["token", "band"]).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    steps = hubs.join(hubs.select("token", (F.col("band") - 1).alias("band"), F.col("hub").alias("b")), ["token", "band"]).select(F.col("hub").alias("a"), "b")
    pairs = stars.unionAll(steps).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = write_table(unrefuted(pairs, signed, percent), "pairs", PAIR_ROWS)
    sets = sets_of(likely.select("a").unionAll(likely.select("b")))
    links = write_table(linked(likely, sets, percent), "links", PAIR_ROWS)
    several = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a")
    own = of.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = links.unionAll(own)
    comps = connected_components(links)
    more = tile_links(tiles, comps, signed, percent, sets_of)
    if not more.isEmpty():
        comps = connected_components(links.unionAll(more))
    drop_tables(tiles, ids, signed, sets, likely)
    final = classes.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("of_class"))
    out = rows.join(final, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("of_class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
