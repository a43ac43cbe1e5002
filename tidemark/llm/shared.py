"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own in local mode
    and an error on a cluster, whose machines share no temporary folder."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python workers get so many ``rows`` at a time; shuffle files go when their query ends."""
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEAN)}
    spark.conf.set(_CLEAN, "true")
    if rows:
        spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_table(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation of everything above. With
    ``batch_rows``, Python workers get so many rows at a time during this write: for wide rows.
    The shuffle files of the write go as soon as the table is there.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables made by :func:`write_table` once nothing reads them any more."""
    for table in tables:
        drop_path(table.sparkSession, table.table_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids up to this many are sent to all executors; more of them are joined by shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``; rows of a null id stay."""
    ids = write_table(ids.select(id_col).where(f"{id_col} IS NOT NULL").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(ids.hint("broadcast") if few else ids, id_col, "left_anti").select(docs.columns)
