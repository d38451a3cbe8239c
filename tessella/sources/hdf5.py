"""HDF5 as a Spark data source: compressed rows in, compressed rows out, and a listing.

``spark.read.format("hdf5_matrix")`` plans one task for a range of rows of about
``entries`` entries: it reads the row pointers in slices to find the ranges, and a task
reads only its hyperslabs of the index and value datasets. Ranges of ``row`` in filters
are pushed down to the row pointers. Writing sends every task's rows to a file of its own,
which appears under its name only when the whole job commits.

A file (or a folder of ``*.h5``) has a group with ``indptr``, ``indices`` and ``data``, and
``rows`` where it holds only some rows. HDF5 needs seekable files, so paths are mounted
folders that all executors share. Needs h5py; without it, using the source raises
RuntimeError.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..model import Matrix

_SCHEMA = "row long, col long, v double"
_ARROW = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("v", pa.float64())])
#: Row pointers read at once, and items of a stored chunk.
_SLICE, _CHUNK = 1 << 20, 1 << 16


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py") from e
    return h5py


def _files(path: str) -> list[str]:
    return sorted(glob.glob(f"{path}/*.h5")) if os.path.isdir(path) else [path]


@dataclass
class _Rows(InputPartition):
    file: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.group, self.entries = options["path"], options.get("group", "matrix"), int(options.get("entries", 1 << 20))
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        """Ranges of row narrow the plan; Spark checks every filter again, which keeps this simple and exact."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.high = min(self.high, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            yield f

    def _span(self, g) -> tuple[int, int]:
        """The stored rows (by place) that the pushed range can hold."""
        n = g["indptr"].shape[0] - 1
        if "rows" not in g:
            return min(max(self.low, 0), n), min(max(self.high, 0), n)

        def place(value: int) -> int:  # bisection, an item a step
            lo, hi = 0, n
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if int(g["rows"][mid : mid + 1][0]) < value else (lo, mid)
            return lo

        return (place(self.low) if self.low > 0 else 0), (place(self.high) if self.high < (1 << 63) - 1 else n)

    def partitions(self):
        out = []
        for file in _files(self.path):
            with _h5py().File(file, "r") as f:
                g = f[self.group]
                low, high = self._span(g)
                start, first = low, None
                for i in range(low, high, _SLICE):
                    ptr = g["indptr"][i : min(i + _SLICE, high) + 1]
                    first = int(ptr[0]) if first is None else first
                    while int(ptr[-1]) - first >= self.entries:
                        end = i + max(1, int(np.searchsorted(ptr, first + self.entries, "right")) - 1)
                        end = max(end, start + 1)
                        out.append(_Rows(file, start, end))
                        start, first = end, int(ptr[end - i])
                if start < high:
                    out.append(_Rows(file, start, high))
        return out or [_Rows("", 0, 0)]

    def read(self, partition):
        if partition.low >= partition.high:
            return
        with _h5py().File(partition.file, "r") as f:
            g = f[self.group]
            ptr = np.asarray(g["indptr"][partition.low : partition.high + 1]).astype(np.int64)
            rows = np.asarray(g["rows"][partition.low : partition.high]).astype(np.int64) if "rows" in g else np.arange(partition.low, partition.high)
            # A row may be longer than a step: entries are read in steps, wherever rows end.
            for i in range(int(ptr[0]), int(ptr[-1]), self.entries):
                j = min(i + self.entries, int(ptr[-1]))
                at = np.searchsorted(ptr, np.arange(i, j), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(np.asarray(g["indices"][i:j]).astype(np.int64)), pa.array(np.asarray(g["data"][i:j]).astype(np.float64))], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.group, self.overwrite = options["path"], options.get("group", "matrix"), overwrite

    def write(self, iterator):
        """Rows must come in order, as ``write_hdf5`` sends them."""
        h5py, name = _h5py(), uuid.uuid4().hex
        os.makedirs(self.path, exist_ok=True)
        temporary, final = f"{self.path}/.{name}.tmp", f"{self.path}/part-{name}.h5"
        ids, sizes, total = [], [], 0
        with h5py.File(temporary, "w") as f:
            g = f.create_group(self.group)
            make = lambda n, kind: g.create_dataset(n, shape=(0,), maxshape=(None,), dtype=kind, chunks=(_CHUNK,))
            cols, vals = make("indices", "int64"), make("data", "float64")
            for batch in iterator:
                row = batch.column("row").to_numpy()
                if not len(row):
                    continue
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                n = np.diff(np.append(head, len(row)))
                if ids and ids[-1][-1] == row[0]:  # the last batch's row goes on
                    sizes[-1][-1] += n[0]
                    head, n = head[1:], n[1:]
                if len(head):
                    ids.append(row[head])
                    sizes.append(n)
                for d, c in ((cols, "col"), (vals, "v")):
                    d.resize((total + len(row),))
                    d[total : total + len(row)] = batch.column(c).to_numpy()
                total += len(row)
            rows = np.concatenate([np.zeros(0, np.int64), *ids])
            for d, x in ((make("rows", "int64"), rows), (make("indptr", "int64"), np.concatenate([[0], *sizes]).cumsum())):
                d.resize((len(x),))
                d[0 : len(x)] = x
            f.attrs["format"] = "compressed rows"
        return _Written(temporary, final)

    def commit(self, messages):
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)
        for file in old:
            os.remove(file)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class Hdf5Matrix(DataSource):
    @classmethod
    def name(cls):
        return "hdf5_matrix"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format and the listing (``hdf5_objects(path)`` in SQL) known; filters are pushed to Python sources."""
    _h5py()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5Matrix)
    spark.udtf.register("hdf5_objects", hdf5_objects())


def read_hdf5(spark: SparkSession, path: str, group: str = "matrix", entries: int = 1 << 20) -> DataFrame:
    """``row, col, v`` of a file or a folder of them."""
    register(spark)
    return spark.read.format("hdf5_matrix").option("path", path).option("group", group).option("entries", entries).load()


def write_hdf5(a: Matrix, path: str, group: str = "matrix", mode: str = "append") -> None:
    """A file for each range of rows; nothing shows unless all are written."""
    register(a.entries.sparkSession)
    e = a.entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))
    e.repartitionByRange("row").sortWithinPartitions("row", "col").write.format("hdf5_matrix").option("path", path).option("group", group).mode(mode).save()


def hdf5_objects():
    """A table function of a file's path: ``object, kind, shape, dtype, attributes`` (JSON) of its root,
    groups and datasets. Joined laterally with a table of paths, files are listed in parallel."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="object string, kind string, shape array<long>, dtype string, attributes string")
    class Objects:
        def eval(self, path: str):
            if path is None:
                return
            found = []

            def see(name, x):
                shape = [int(n) for n in x.shape] if hasattr(x, "shape") else None
                found.append((name, "group" if shape is None else "dataset", shape, None if shape is None else str(x.dtype), json.dumps({k: v.item() if hasattr(v, "item") else str(v) for k, v in sorted(x.attrs.items())})))

            with _h5py().File(path, "r") as f:
                see("/", f)
                f.visititems(see)
            yield from found

    return Objects
