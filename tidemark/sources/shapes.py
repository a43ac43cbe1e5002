"""Polygons of shapefiles: one row a part of a shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: file code, and the types whose records begin like a polygon's.
_CODE, _POLYGONS = 9994, (5, 15, 25)
_CORNERS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))


def records(raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(shape, part, points) of the polygons in the bytes of a file; other shapes are left out."""
    if int.from_bytes(raw[:4], "big") != _CODE:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(raw):
        number, words = int.from_bytes(raw[at : at + 4], "big"), int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or int.from_bytes(body[:4], "little") not in _POLYGONS:
            continue
        parts, points = np.frombuffer(body, "<i4", 2, 36)
        starts = [*np.frombuffer(body, "<i4", parts, 44).tolist(), int(points)]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        for part, (a, b) in enumerate(zip(starts, starts[1:])):
            yield number, part, xy[a:b]


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, part, corners) of all polygons; a file is read by one task."""

    def parse(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, n, part, [{"lon": x, "lat": y} for x, y in xy.tolist()]) for n, part, xy in records(raw.as_buffer().to_pybytes())]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), _CORNERS))], ["path", "number", "part", "corners"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, number int, part int, corners array<struct<lon: double, lat: double>>")
