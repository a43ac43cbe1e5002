"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, write_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's neighbours (larger ones if ``large``, else smaller ones) on the
    smallest of them and itself."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
    if large:
        out = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = both.join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link; component is the smallest id reachable.

    Each pass is two joins on the node; hubs are reduced to their minimum before the shuffle
    and only the join fans out, which adaptive execution splits. Passes go on until the links
    are stars round their minimum, which takes about the logarithm of the longest chain.
    Null ids and loops are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = write_table(pairs, "edges")
    while True:
        chained = edges.select(F.col("u").alias("v")).distinct()
        if edges.join(chained, "v", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
        after = write_table(_stars(_stars(edges, True), False), "edges")
        drop_tables(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
