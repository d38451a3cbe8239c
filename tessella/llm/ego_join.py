"""Embedding near-dedup by an epsilon grid order join.

Cosine c between unit vectors is a distance of sqrt(2 - 2c) = eps. Unit vectors
are projected on their leading principal dimensions, which never lengthens a
distance, and sorted in epsilon grid order: by the cells of side eps, dimension
after dimension. Runs of the order are blocks with bounding boxes. Only pairs of
blocks whose boxes come within eps are joined; inside, both sequences are halved
recursively, intervals provably apart are skipped, and small intervals are
compared by a matrix product in double precision.

Equal vectors are one class with a count. A block pair returns, for each of its
classes, the number of vectors linked and one link to a smaller member of its
component there: rows stay linear where links are quadratic.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, not even with their copies; vectors of other
lengths link with nothing of this length; a repeated row is a vector of its own;
extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stage import cut, store

BLOCK, LEADING, CELL_DIMS, SMALL = 2048, 8, 3, 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a list column whose lists all have ``dim`` finite values."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal(unit: DataFrame, dim: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, leading principal directions) from one aggregate of dim rows a task."""

    def run(batches):
        total = np.zeros((dim + 1, dim))
        n = 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("embedding"), dim)
                total[:dim] += x.T @ x
                total[dim] += x.sum(0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([n] * (dim + 1), pa.int64()), *map(pa.array, total.T)], names=["i", "n", *(f"c{j}" for j in range(dim))])

    sums = unit.select("embedding").mapInArrow(run, "i int, n long, " + ", ".join(f"c{j} double" for j in range(dim)))
    rows = sums.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(dim))).orderBy("i").collect()
    n, m = max(rows[0]["n"], 1), np.array([r[2:] for r in rows])
    mean = m[dim] / n
    _, vectors = np.linalg.eigh(m[:dim] / n - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, :leading]


def _cells(dim: int, mean, axes, eps: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                y = (_matrix(b.column("embedding"), dim) - mean) @ axes
                cells = np.floor(y / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("m"), b.column("embedding"), *map(pa.array, cells.T)], names=["key", "m", "embedding", *(f"g{j}" for j in range(axes.shape[1]))])

    return run


def _blocks(dim: int, mean, axes, size: int):
    """Runs of a sorted partition: keys, counts, vectors, and the box of their projections."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), itertools.count(), []

        def out(t: pa.Table):
            raw = t["embedding"].combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            y = (_matrix(raw, dim) - mean) @ axes
            row = {"block": (part << 32) + next(number), "keys": t["key"].to_numpy().tobytes(), "counts": t["m"].to_numpy().tobytes(), "vectors": raw.flatten().to_numpy(zero_copy_only=False).tobytes(), "lo": y.min(0).tolist(), "hi": y.max(0).tolist()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= size:
                t = pa.Table.from_batches(held)
                for i in range(0, t.num_rows - size + 1, size):
                    yield out(t.slice(i, size))
                rest = t.slice(t.num_rows - t.num_rows % size)
                held = rest.to_batches()
        if held and sum(h.num_rows for h in held):
            yield out(pa.Table.from_batches(held))

    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
    return run


def _apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the boxes of two runs of projections are farther apart than eps."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > eps * eps * (1 + 1e-9)


def _join(x, y, px, py, i, j, same: bool, eps: float, cosine: float, found: list) -> None:
    """Links between rows of x from i and of y from j, by halving."""
    if _apart(px, py, eps):
        return
    if max(len(x), len(y)) <= SMALL:
        a, b = np.nonzero(x @ y.T >= cosine)
        if same and i == j:
            a, b = a[a < b], b[a < b]
        found.append((a + i, b + j))
        return
    if same and i == j:
        h = len(x) // 2
        _join(x[:h], x[:h], px[:h], px[:h], i, i, True, eps, cosine, found)
        _join(x[h:], x[h:], px[h:], px[h:], i + h, i + h, True, eps, cosine, found)
        _join(x[:h], x[h:], px[:h], px[h:], i, i + h, False, eps, cosine, found)
    elif len(x) >= len(y):
        h = len(x) // 2
        _join(x[:h], y, px[:h], py, i, j, same, eps, cosine, found)
        _join(x[h:], y, px[h:], py, i + h, j, same, eps, cosine, found)
    else:
        h = len(y) // 2
        _join(x, y[:h], px, py[:h], i, j, same, eps, cosine, found)
        _join(x, y[h:], px, py[h:], i, j + h, same, eps, cosine, found)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of every vertex's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(dim: int, kind, mean, axes, eps: float, cosine: float):
    """For each class of a block pair: vectors linked and a link inside its local component."""

    def run(batches):
        for batch in batches:
            cell = lambda n, i, t: np.frombuffer(batch.column(n)[i].as_buffer(), t)  # noqa: E731, B023
            unit = lambda n, i: _unit(cell(n, i, kind).reshape(-1, dim))
            for i in range(batch.num_rows):
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                ka, ca, x = cell("ka", i, np.int64), cell("ca", i, np.int64), unit("va", i)
                kb, cb, y = (ka, ca, x) if same else (cell("kb", i, np.int64), cell("cb", i, np.int64), unit("vb", i))
                found: list = []
                _join(x, y, (x - mean) @ axes, (y - mean) @ axes, 0, 0, same, eps, cosine, found)
                a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found, strict=True) if found else ((), ())))
                shift = 0 if same else len(x)
                keys, counts = (ka, ca) if same else (np.concatenate([ka, kb]), np.concatenate([ca, cb]))
                b = b + shift
                degree = (np.bincount(a, counts[b], minlength=len(keys)) + np.bincount(b, counts[a], minlength=len(keys))).astype(np.int64)
                at = np.flatnonzero(degree)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(degree[at]), pa.array(keys[local_labels(len(keys), a, b)][at])], names=["key", "degree", "link"])

    return run


def _near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks whose boxes are within eps, found by the leading cells they touch."""
    side = lambda c, j, more: F.floor(c[j] / eps).cast("int") + more

    def touched(df: DataFrame, more: int) -> DataFrame:
        for j in range(CELL_DIMS):
            df = df.withColumn(f"k{j}", F.explode(F.sequence(side(F.col("lo"), j, -more), side(F.col("hi"), j, more))))
        return df

    keys = [f"k{j}" for j in range(CELL_DIMS)]
    box = blocks.select("block", "lo", "hi")
    left = touched(box.select(F.col("block").alias("a"), "lo", "hi"), 0).select("a", F.col("lo").alias("la"), F.col("hi").alias("ha"), *keys)
    right = touched(box.select(F.col("block").alias("b"), "lo", "hi"), 1).select("b", F.col("lo").alias("lb"), F.col("hi").alias("hb"), *keys)
    gap = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9)
    return left.join(right, keys).where("a <= b").where(near).select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    eps = float(np.sqrt(2 - 2 * cosine))
    e = F.col(vector_col)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    # Equal vectors are one class, told apart by the vectors themselves; keys only number them.
    classes = cut(v.where("fine").groupBy("embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first")))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()))
    spark, found = v.sparkSession, None
    for (dim,) in classes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        mine = classes.where(F.size("embedding") == dim)
        leading = min(LEADING, dim)
        mean, axes = _principal(mine, dim, leading)
        axes = np.pad(axes, ((0, 0), (0, max(0, CELL_DIMS - leading))))
        width = axes.shape[1]
        grid = [f"g{j}" for j in range(width)]
        width_of = np.float32 if "float" in classes.schema["embedding"].dataType.simpleString() else np.float64
        kind = classes.schema["embedding"].dataType.simpleString()
        cells = mine.select("key", "m", "embedding").mapInArrow(_cells(dim, mean, axes, eps), f"key long, m long, embedding {kind}, " + ", ".join(f"{g} int" for g in grid))
        ordered = cells.repartitionByRange(*grid, "key").sortWithinPartitions(*grid, "key").select("key", "m", "embedding")
        blocks = cut(ordered.mapInArrow(_blocks(dim, mean, axes, block), "block long, keys binary, counts binary, vectors binary, lo array<double>, hi array<double>"))
        pairs = cut(_near_blocks(blocks, eps))
        side = lambda s: blocks.select(F.col("block").alias(s), F.col("keys").alias("k" + s), F.col("counts").alias("c" + s), F.col("vectors").alias("v" + s))  # noqa: E731, B023
        joined = pairs.repartition("a", "b").join(side("a"), "a").join(side("b"), "b")
        links = joined.mapInArrow(_links(dim, width_of, mean, axes, eps, cosine), "key long, degree long, link long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "key long, degree long, link long")
    found = cut(found)
    root = components(found, "key", "link").select(F.col("id").alias("key"), F.col("component").alias("root"))
    degrees = found.groupBy("key").agg(F.sum("degree").alias("degree"))
    c = cut(classes.select("key", "m", "first").join(degrees, "key", "left").join(root, "key", "left").withColumn("root", F.coalesce("root", "key")))
    c = c.join(store(c.groupBy("root").agg(F.min("first").alias("component_id"))), "root")  # a hot root's rows can be split
    c = c.select("key", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = v.select("vec_id", "embedding").join(classes.select("key", "embedding").join(c, "key").drop("key"), "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
