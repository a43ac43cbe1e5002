"""A Spark data source for NetCDF classic files: one row a time and cell of the variables.

    spark.dataSource.register(NetCDF3)
    spark.read.format("netcdf3").option("variables", "u,v").load("/data/a.nc")

Only the classic and 64-bit-offset layouts; paths are local to the executors or mounted there.
"""

from __future__ import annotations

import glob
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The types of the classic format.
_TYPES = {1: ("i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
#: Times that a partition reads.
TIMES = 64
TIME_NAMES = ("time", "Time", "xtime", "initial_time0_hours", "valid_time", "day")


class Header:
    """Dimensions, attributes and variables of a classic file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.f, magic = f, f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2):
                raise ValueError(f"{path} is no NetCDF classic file")
            self.wide = magic[3] == 2
            self.records = self._int()
            self.dims = [(self._name(), self._int()) for _ in range(self._count())]
            self.attributes = self._attributes()
            self.variables = {}
            for _ in range(self._count()):
                name = self._name()
                dims = [self._int() for _ in range(self._int())]
                attributes = self._attributes()
                kind, size = self._int(), self._int()
                begin = struct.unpack(">q", f.read(8))[0] if self.wide else self._int()
                self.variables[name] = {"dims": dims, "attributes": attributes, "type": kind, "size": size, "begin": begin}
            del self.f
        self.record_size = sum(v["size"] for v in self.variables.values() if self.is_record(v))
        if self.records < 0:
            self.records = (os.path.getsize(path) - min((v["begin"] for v in self.variables.values() if self.is_record(v)), default=0)) // max(self.record_size, 1)

    def _int(self) -> int:
        return struct.unpack(">i", self.f.read(4))[0]

    def _count(self) -> int:
        self._int()
        return self._int()

    def _name(self) -> str:
        n = self._int()
        return self.f.read(n + -n % 4)[:n].decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._count()):
            name, kind, n = self._name(), self._int(), self._int()
            code, width = _TYPES[kind]
            raw = self.f.read(n * width + -(n * width) % 4)[: n * width]
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, code).tolist()
        return out

    def is_record(self, variable: dict) -> bool:
        return bool(variable["dims"]) and self.dims[variable["dims"][0]][1] == 0

    def shape(self, variable: dict) -> list[int]:
        return [self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in variable["dims"]]

    def read(self, path: str, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """Slices [first, first + count) of the first dimension, unpacked, missing as NaN."""
        v = self.variables[name]
        shape, (code, width) = self.shape(v), _TYPES[v["type"]]
        one = int(np.prod(shape[1:], dtype=np.int64)) if shape else 1
        count = (shape[0] if shape else 1) - first if count is None else count
        stride = self.record_size if self.is_record(v) else one * width
        with open(path, "rb") as f:
            parts = []
            for k in range(first, first + count):
                f.seek(v["begin"] + k * stride)
                parts.append(np.frombuffer(f.read(one * width), code))
        data = np.concatenate(parts) if parts else np.zeros(0, code)
        if v["type"] == 2:
            return data.reshape([count, *shape[1:]])
        a, data = v["attributes"], data.astype(float)
        fill = a.get("_FillValue", a.get("missing_value"))
        if fill:
            data[data == fill[0]] = np.nan
        return (data * a.get("scale_factor", [1.0])[0] + a.get("add_offset", [0.0])[0]).reshape([count, *shape[1:]])


class Slice(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class NetCDF3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        return sorted(glob.glob(path)) if any(c in path for c in "*?[") else path.split(";")

    def _names(self) -> list[str]:
        return [x.strip() for x in self.options["variables"].split(",")]

    def schema(self) -> str:
        return "path string, t int, time double, cell int, " + ", ".join(f"`{n}` double" for n in self._names())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._paths(), self._names())


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            head = Header(path)
            n = head.shape(head.variables[self.names[0]])[0]
            out += [Slice(path, k, min(TIMES, n - k)) for k in range(0, n, TIMES)]
        return out

    def read(self, partition: Slice):
        head = Header(partition.path)
        time = next((n for n in TIME_NAMES if n in head.variables), None)
        for k in range(partition.first, partition.first + partition.count):
            columns = [head.read(partition.path, n, k, 1).reshape(-1) for n in self.names]
            n = len(columns[0])
            moment = float(head.read(partition.path, time, k, 1).reshape(-1)[0]) if time else None
            arrays = [pa.array([partition.path] * n), pa.array(np.full(n, k, np.int32)), pa.array([moment] * n, pa.float64()), pa.array(np.arange(n, dtype=np.int32))]
            arrays += [pa.array(c, mask=np.isnan(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "t", "time", "cell", *self.names])


# Names under which files hold latitudes and longitudes, the likeliest first.
LATITUDES = ("lat", "latitude", "LAT", "latitude0", "Latitude", "XLAT")
LONGITUDES = ("lon", "longitude", "LON", "longitude0", "Longitude", "XLONG")


def axis_names(names: list[str], latitude: str | None = None, longitude: str | None = None) -> tuple[str, str]:
    """The names of the latitude and the longitude among those of a file's variables or a
    DataFrame's columns: the given ones, else the first that is known."""
    found = []
    for given, known in ((latitude, LATITUDES), (longitude, LONGITUDES)):
        hit = next((n for n in ((given,) if given else known) if n in names), None)
        if hit is None:
            raise ValueError(f"none of {[given] if given else list(known)} is among {sorted(names)}")
        found.append(hit)
    return found[0], found[1]
