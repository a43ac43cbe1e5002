"""MinHash near-dedup: one-permutation hashing, optimal densification, banded star edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import mix, shingles, tidy
from .shared import drop_tables, write_table

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Ids up to this many go to all executors to pick texts; more of them are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows of texts, and of pairs of sets, that a Python worker gets at a time.
TEXT_ROWS, PAIR_ROWS = 2_000, 500
#: Most classes and most bytes of sets in one block of a bucket that stars left open.
BLOCK_CLASSES = 512
BLOCK_BYTES = 8 << 20
_BOUNDS = (np.arange(1, BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
_PROBES = np.random.default_rng(7).integers(0, BINS, (192, BINS))
_BAND = np.random.default_rng(8).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each of BINS bins of the sorted distinct ``hashes``, empty bins filled.

    An empty bin copies the first filled bin on its own random walk over the bins (optimal
    densification), so two sets copy alike wherever they agree.
    """
    at = np.concatenate(([0], np.searchsorted(hashes, _BOUNDS), [len(hashes)]))
    full = at[1:] > at[:-1]
    source = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_PROBES[:, empty]]
        first = hit.argmax(0)
        source[empty] = np.where(hit[first, np.arange(len(empty))], _PROBES[first, empty], np.flatnonzero(full)[0])
    return hashes[at[:-1][source]]


def band_keys(signature: np.ndarray) -> np.ndarray:
    return mix((signature.reshape(BANDS, ROWS) * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): size, 128-bit key of the shingle set, band keys."""

    def sketch(batches):
        for batch in batches:
            sizes, keys, bands = [], [], []
            for _, found in shingles(batch.column(1), k):
                found = np.unique(found)
                sizes.append(len(found))
                keys.append(found.sum(dtype=np.uint64).tobytes() + mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes())
                bands.append(band_keys(one_permutation(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(sketch), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, hashes): the distinct shingle hashes of each document, sorted, as bytes."""

    def sets(batches):
        for batch in batches:
            made = [np.unique(found) for _, found in shingles(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, made)), pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["id", "n", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(tidy(sets), "id long, n long, hashes binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    size = sets.select("id", "n")
    # sizes first: only pairs that can reach the bound carry their sets
    fit = pairs.join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    one = fit.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(confirm), "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among the n distinct ``ids``."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of ``left`` with all of ``right``, by slices of hashes."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        grids = []
        for side in (left, right):
            grid = np.zeros((len(side), len(part)), np.float32)
            for row, own in enumerate(side):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                column = np.searchsorted(part, own)
                grid[row, column[part[column] == own]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Index of those links (a, b) that join what the links before them left apart."""
    parent, keep = list(range(nodes)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(i)
            if len(keep) == nodes - 1:
                break
    return np.array(keep, np.int64)


def _block_links(percent: int):
    def compare(key, rows):
        low, high = key[1].as_py(), key[2].as_py()
        ids, block = rows["rep"].to_numpy(), rows["block"].to_numpy()
        names, comps = np.unique(rows["component"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"].combine_chunks()]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = ([], [])
        if len(one) and len(two) and len(names) > 1:
            common = _common_counts([sets[i] for i in one], [sets[i] for i in two])
            size = np.array([len(x) for x in sets], np.float32)
            union = size[one][:, None] + size[two][None, :] - common
            hit = (100 * common >= percent * union) & (common > 0) & (comps[one][:, None] != comps[two][None, :])
            x, y = np.nonzero(hit)
            x, y = one[x], two[y]
            tree = _forest(comps[x], comps[y], len(names))
            found = (ids[x[tree]], ids[y[tree]]) if len(tree) else found
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return compare


def open_links(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket but were never its hub.

    Buckets are cut into blocks of bounded classes and bytes; each pair of blocks is one group,
    so a large bucket spreads over tasks. All pairs of a group are compared in the task, which
    gives links that join its components as all links would: fewer of them than components.
    Of buckets with the same members one is compared.
    """
    rep = comps.select(F.col("id").alias("rep"), "component")
    rows = buckets.where("rep <> hub").join(rep, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(sets.select(F.col("id").alias("rep"), "n"), "rep")
    digest = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(20,0)")).alias(f"digest{i}") for i in range(2)]
    ends = [F.min("component").alias("c0"), F.max("component").alias("c1")]
    held = rows.groupBy("key").agg(F.count("*").alias("m"), *ends, *digest, F.sum(8 * F.col("n")).alias("bytes")).where("c0 <> c1")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("bytes") / BLOCK_BYTES)).cast("int")
    chosen = held.groupBy("m", "digest0", "digest1").agg(F.min("key").alias("key"), F.max(blocks).alias("blocks")).select("key", "blocks")
    placed = rows.select("key", "rep", "component").join(chosen, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "component", "block", *pair)
    full = dealt.join(sets.select(F.col("id").alias("rep"), "hashes"), "rep")
    return full.groupBy("key", "low", "high").applyInArrow(_block_links(percent), "a long, b long").distinct()


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of k-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``percent`` / 100 or more are linked; component_id is the smallest doc_id reachable. With
    fewer than k words the whole sequence is the one shingle; null, empty and blank texts have
    none and stay alone. Equal sets are one class from the start. Candidates share one of
    BANDS band keys: a bucket gives one edge from each class to its smallest, checked on the
    full sets. Classes of a bucket that are still in different components after that are
    compared too (:func:`open_links`), so a hub that is too unlike loses no link. Repeated rows
    share their class; rows with a null id keep a null component. Other columns are not read;
    empty tables give empty results.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = write_table(sketches(docs, k), "sketches", TEXT_ROWS)
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = write_table(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    member = classes.select(F.explode("bands").alias("key"), "rep")
    hubs = member.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = write_table(member.join(hubs, "key"), "buckets")
    pairs = write_table(buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ids = write_table(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = write_table(shingle_sets(texts_of(docs, ids, ids.count()), k), "sets", TEXT_ROWS)
    links = write_table(linked(pairs, sets, percent), "links", PAIR_ROWS)
    drop_tables(pairs, ids)
    comps = connected_components(links)
    more = write_table(open_links(buckets, comps, sets, percent), "links")
    if not more.isEmpty():
        comps = connected_components(links.unionAll(more))
    drop_tables(buckets, sets, links, more)
    final = classes.select("set_key", "rep").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("of_class"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(final, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("of_class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
