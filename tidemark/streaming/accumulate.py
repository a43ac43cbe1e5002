"""Streaming forms of accumulation and persistence: what the batch operators give, as data comes.

The data that this engine is for comes as files; these are extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accumulate(stream: DataFrame, value: str, width: str, late: str, op: str = "sum") -> DataFrame:
    """(cell, bucket, value): tumbling windows of ``width`` on ``time`` with a watermark of ``late``;
    a window comes out when the watermark has passed it."""
    windows = stream.withWatermark("time", late).groupBy("cell", F.window("time", width).alias("w"))
    return windows.agg(getattr(F, op)(value).alias("value")).select("cell", F.col("w.start").alias("bucket"), "value")


def persistent(stream: DataFrame, value: str, limit: float, least: int) -> DataFrame:
    """(cell, time, value): samples in runs of at least ``least`` consecutive ones above ``limit``.

    State of a cell is the run so far: its length and, until it is long enough, its samples,
    fewer than ``least``. Samples of a cell must come in order of time across batches.
    """
    schema = "cell int, time timestamp, value double"
    state_schema = "n int, times array<long>, values array<double>"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, times, values = state.get if state.exists else (0, [], [])
        times, values = list(times), list(values)
        rows = pd.concat(list(batches)).sort_values("time")
        out = []
        for t, v in zip(rows["time"], rows["value"]):
            if not v > limit:
                n, times, values = 0, [], []
                continue
            n += 1
            if n > least:
                out.append((t, v))
                continue
            times.append(t.value // 1000)
            values.append(v)
            if n == least:
                out += [(pd.Timestamp(x, unit="us"), y) for x, y in zip(times, values)]
                times, values = [], []
        state.update((n, times, values))
        yield pd.DataFrame({"cell": [key[0]] * len(out), "time": pd.Series([x[0] for x in out], dtype="datetime64[ns]"), "value": pd.Series([x[1] for x in out], dtype=float)})

    rows = stream.select("cell", F.col("time").cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("cell").applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
