"""Exact nearest rows by matrix products over pairs of row blocks.

Rows (sparse: their columns and values) are told apart by their distances to a
few pivots: they are sorted by the nearest pivot and the distance to it, and packed
into blocks of ``BLOCK``. A block knows the range of its rows' distances to every
pivot, and each row how far its k nearest can be at most, by those in its own block.
By the triangle inequality two rows are never nearer than their distances to any
pivot differ, so block pairs, and rows of a block, that are too far apart are
skipped. What is left comes from one matrix product a pair, in single precision with
a bound on its error; what could be among the k nearest is measured again by itself.
(Manhattan: from sums of whole steps between values rounded to steps, or for many
columns from a product of values cut into cells, whose squared differences over the
width of a cell are never above the differences.) A task holds some asking blocks and meets the
giving ones one by one, so only the k nearest of a row leave it. The work is quadratic
in rows that are as far from each other as from anything; memory is that of the k
nearest of a task's blocks, and a block travels once for each task.

Rows may ask, give or both, so one search serves the rows of one table, those of
another, or both at once.

Metrics: ``euclidean``, ``manhattan``, ``cosine`` and ``correlation`` (one less the
cosine, of the rows or of the rows less their means; a row without a direction has
distance 1 to all). The last two are pruned by their chords, which are Euclidean.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Matrix

BLOCK, _STEP = 4096, 512
#: Nearest rows that a block and a task may hold, cells of a column, and columns and cells of a filter.
_BLOCK_HELD, _TASK_HELD, _CELLS, _FILTER = 1 << 21, 1 << 23, 8, 1024
#: Up to so many columns Manhattan distances are counted in steps of the widest column's range, some
#: columns at a time (their steps must fit 16 bits); rows at a time; what counts as out of reach.
_STEP_COLUMNS, _STEPS, _STEP_CHUNK, _STEP_ROWS, _BEYOND = 128, 511, 64, 64, 1 << 30
#: Pivots beside the origin, and the most entries that one may have (they travel to all tasks).
PIVOTS, _PIVOT_ENTRIES = 16, 100_000
METRICS = ("euclidean", "manhattan", "cosine", "correlation")
_KINDS = {"ids": np.int64, "sizes": np.int32, "cols": np.int64, "vals": np.float64, "grps": np.int64, "shift": np.float64, "ask": np.uint8, "give": np.uint8, "far": np.float64, "kth": np.float64}
_RANGES = ("ask_lo", "ask_hi", "lo", "hi")
_BLOCKS = f"block long, reach double, {', '.join(f'{c} array<double>' for c in _RANGES)}, {', '.join(f'{c} binary' for c in _KINDS)}"
_MEASURED = "row long, cols array<long>, vals array<double>, grp long, shift double, ask boolean, give boolean, home int, near double, far array<double>"


def rows_of(a: Matrix, groups: DataFrame | None = None) -> DataFrame:
    """``row, cols, vals, grp`` of every row of the domain (``grp`` 0 without ``groups``)."""
    e = a.entries.groupBy("row").agg(F.collect_list(F.struct("col", F.col("v").cast("double").alias("v"))).alias("e"))
    d = a.over_rows(e).select("row", F.coalesce("e.col", F.array().cast("array<long>")).alias("cols"), F.coalesce("e.v", F.array().cast("array<double>")).alias("vals"))
    return d.join(groups.select("row", F.col("grp").cast("long")), "row") if groups is not None else d.withColumn("grp", F.lit(0).cast("long"))


def rows_of_vectors(vectors: DataFrame) -> DataFrame:
    """``row, cols, vals, grp`` of dense ``id, x``."""
    return vectors.select(F.col("id").alias("row"), F.sequence(F.lit(0).cast("long"), F.size("x").cast("long") - 1).alias("cols"), F.transform("x", lambda v: v.cast("double")).alias("vals"), F.lit(0).cast("long").alias("grp"))


class _Block:
    def __init__(self, ids, sizes, cols, vals, grps, shift, ask=None, give=None, far=None, kth=None):
        self.ids, self.sizes, self.cols, self.vals, self.grps, self.shift = ids, sizes, cols, vals, grps, shift
        n = len(ids)
        self.ask, self.give = (np.ones(n, np.uint8) if x is None else x for x in (ask, give))
        self.far = np.zeros((n, 0)) if far is None else far.reshape(n, -1)
        self.kth = np.full(n, np.inf) if kth is None else kth
        self.row = np.repeat(np.arange(n), sizes)
        self.norm = np.bincount(self.row, vals * vals, minlength=n)
        self.columns = self.key = self.key_of = self.x = self.y = self.cells = self.phi = self.phi_at = self.grid = None

    @classmethod
    def read(cls, batch, i: int) -> _Block:
        cell = {c: batch.column(c)[i].as_buffer() for c in _KINDS}
        got = {c: np.frombuffer(cell[c], k) for c, k in _KINDS.items() if c not in ("cols", "vals")}
        width = lambda c: cell[c].size // max(1, int(got["sizes"].sum())) or 8
        cols, vals = (np.frombuffer(cell[c], f"{kind}{width(c)}").astype(_KINDS[c]) for c, kind in (("cols", "u"), ("vals", "f")))
        return cls(got["ids"], got["sizes"], cols, vals, *(got[c] for c in list(_KINDS)[4:]))

    def cell(self, c: str) -> bytes:
        """The bytes of a field; columns in as few as they need, values in single precision if that is exact."""
        x = np.ascontiguousarray(getattr(self, c)).astype(_KINDS[c])
        if c == "vals" and (np.abs(x) < 1e38).all() and (x.astype(np.float32) == x).all():
            return x.astype(np.float32).tobytes()
        return (x.astype(np.min_scalar_type(x.max(initial=0))) if c == "cols" and x.min(initial=0) >= 0 else x).tobytes()

    @classmethod
    def of(cls, t: pa.Table) -> _Block:
        cell = lambda c, kind: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        one = lambda c, kind: t[c].to_numpy().astype(kind)
        sizes = t["cols"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        far = cell("far", np.float64) if "far" in t.column_names else None
        return cls(one("row", np.int64), sizes, cell("cols", np.int64), cell("vals", np.float64), one("grp", np.int64), one("shift", np.float64), one("ask", np.uint8), one("give", np.uint8), far)

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """The block's values in the given (sorted) columns."""
        out = np.zeros((len(self.ids), len(columns)))
        if len(self.cols) == out.size and (self.cols.reshape(out.shape) == columns).all():
            return self.vals.reshape(out.shape)
        if len(columns):
            at = np.minimum(np.searchsorted(columns, self.cols), len(columns) - 1)
            ok = columns[at] == self.cols
            out[self.row[ok], at[ok]] = self.vals[ok]
        return out


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower ends, widths) of cells that cover the values of each column."""
    n = max(1, min(_CELLS, _FILTER // max(1, x.shape[1])))
    lo, hi = x.min(0, initial=0.0), x.max(0, initial=0.0)
    ends = lo + (hi - lo) * (np.arange(n + 1) / n)[:, None]
    ends[-1] = hi
    return ends[:-1], np.diff(ends, axis=0)


def _places(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix; of a flat one it is many times faster."""
    return np.divmod(np.flatnonzero(m), max(1, m.shape[1]))


class _Pair:
    """Distances between the rows of two blocks."""

    def __init__(self, a: _Block, b: _Block, metric: str):
        self.a, self.b, self.metric = a, b, metric
        if a.columns is None:
            a.columns = np.unique(a.cols)
            a.key = a.columns.tobytes()
            a.x = a.dense(a.columns)
        self.x = a.x
        if b.key_of != a.key:  # blocks of one width ask one after the other
            b.key_of, b.y = a.key, b.dense(a.columns)
        self.y = b.y
        if metric == "euclidean":
            self.beyond = np.maximum(b.norm - (self.y * self.y).sum(1), 0.0)
            self.beyond[self.beyond < 1e-12 * b.norm] = 0.0
        elif metric == "manhattan":
            self.beyond = np.maximum(np.bincount(b.row, np.abs(b.vals), minlength=len(b.ids)) - np.abs(self.y).sum(1), 0.0)

    def count(self, mine: np.ndarray) -> bool:
        """Prepares ``steps``; False where the other filter is the one to take."""
        a, y, width = self.a, self.y[mine], self.x.shape[1]
        if self.metric != "manhattan" or not 0 < width <= _STEP_COLUMNS:
            return False
        if a.grid is None:
            lo, hi = self.x.min(0, initial=0.0), self.x.max(0, initial=0.0)
            step = (hi - lo).max() / _STEPS
            if not 0 < step < np.inf:
                return False
            a.grid = lo, hi, step, np.ascontiguousarray(np.rint((self.x - lo) / step).astype(np.int16).T)
        lo, hi, self.step, self.left = a.grid
        z = np.clip(y, lo, hi)
        out = np.abs(y - z).sum(1) + self.beyond[mine]
        self.start = np.nan_to_num(np.minimum(np.floor(out / self.step * (1 - 1e-12)), _BEYOND), nan=_BEYOND).astype(np.int32)
        self.right = np.ascontiguousarray(np.rint((np.nan_to_num(z) - lo) / self.step).astype(np.int16).T)
        return True

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """Distances in whole steps, off by a step a column (and one) at most; ``_BEYOND`` and more: farther still."""
        total = np.empty((len(rows), len(self.start)), np.int32)
        for i in range(0, len(rows), _STEP_ROWS):
            x = self.left[:, rows[i : i + _STEP_ROWS]]
            part = total[i : i + _STEP_ROWS]
            part[:] = self.start
            gap, sums = np.empty(part.shape, np.int16), np.empty(part.shape, np.int16)
            for lo in range(0, len(x), _STEP_CHUNK):
                sums[:] = 0
                for j in range(lo, min(lo + _STEP_CHUNK, len(x))):
                    np.subtract(x[j, :, None], self.right[j], out=gap)
                    np.abs(gap, out=gap)
                    np.add(sums, gap, out=sums)
                part += sums
        return total

    def within(self, steps: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Pairs that are not farther than the bound; where there is none, that may be among the k nearest."""
        slack, open_ = self.left.shape[0] + 2, ~np.isfinite(bound)
        limit = np.minimum(np.where(open_, 0.0, bound) / self.step * (1 + 1e-9) + slack, 2.0 * _BEYOND)
        if open_.any() and steps.shape[1] > k:
            last = np.partition(steps[open_], k - 1, axis=1)[:, k - 1].astype(float)
            limit[open_] = np.where(last < _BEYOND, last + 2 * slack, 2.0 * _BEYOND)
        else:
            limit[open_] = 2.0 * _BEYOND
        return steps <= np.minimum(limit, np.iinfo(np.int32).max).astype(np.int32)[:, None]

    def filter(self, mine: np.ndarray) -> None:
        """Rows whose products order the pairs: the greater, the nearer (Manhattan: the nearer they may be)."""
        a, b, y = self.a, self.b, self.y[mine]
        if self.metric == "manhattan":
            if a.cells is None:
                a.cells = _cells(self.x)
                a.phi = self._spread(self.x)
            phi, z, at = a.phi, np.clip(y, a.cells[0][0], a.cells[0][-1] + a.cells[1][-1]), a.phi_at
            out = np.abs(y - z).sum(1) + self.beyond[mine]
            z = self._spread(z)
            level, far = at, (z * z).sum(1) + out
        elif self.metric == "euclidean":
            phi, z, level, far = self.x, y, a.norm, b.norm[mine]
        else:
            phi, z, level, far = np.column_stack([self.x, -a.shift]), np.column_stack([y, b.shift[mine]]), None, None
        if far is not None:
            phi, z = np.column_stack([phi, np.ones(len(phi))]), np.column_stack([z, -far / 2])
        self.level = level
        size, other = np.sqrt((phi * phi).sum(1)), np.sqrt((z * z).sum(1)).max(initial=0.0)
        single = phi.shape[1] <= 4 * _FILTER and max(size.max(initial=0.0), other) < 1e15
        self.slack = (phi.shape[1] + 16) * (2.4e-7 if single else 1e-15) * size * other + 1e-30
        kind = np.float32 if single else np.float64
        self.left, self.right = phi.astype(kind), np.ascontiguousarray(z.astype(kind).T)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        """What a value fills of each cell of its column, over the root of the cell's width."""
        lo, width = self.a.cells
        root = np.divide(1.0, np.sqrt(width), out=np.zeros_like(width), where=width > 0)
        out = np.concatenate([np.clip(x - lo[i], 0.0, width[i]) * root[i] for i in range(len(lo))], 1)
        if self.a.phi_at is None:
            self.a.phi_at = (out * out).sum(1)
        return out

    def least(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The product of a pair that is not farther than the bound, at the least."""
        if self.metric == "euclidean":
            v = (self.level[rows] - bound * bound) / 2
        elif self.metric == "manhattan":
            v = (self.level[rows] - bound) / 2
        else:
            v = 1 - bound
        size = np.where(np.isfinite(bound), np.abs(v) + (0 if self.level is None else np.abs(self.level[rows])), 0.0)
        return v - self.slack[rows] - 1e-6 * size * (self.left.dtype == np.float32) - 1e-12 * size

    def differences(self, rows: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Manhattan distances of all these pairs."""
        x, z = self.x[rows], self.y[mine]
        d = np.empty((len(rows), len(mine)))
        step = max(1, (1 << 22) // max(1, z.size))
        for i in range(0, len(rows), step):
            d[i : i + step] = np.abs(x[i : i + step, None] - z[None]).sum(2)
        return d + self.beyond[mine]

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for lo in range(0, len(r), 1 << 12):
            s = slice(lo, lo + (1 << 12))
            x, y = self.x[r[s]], self.y[c[s]]
            if self.metric == "euclidean":
                out[s] = np.sqrt(((x - y) ** 2).sum(1) + self.beyond[c[s]])
            elif self.metric == "manhattan":
                out[s] = np.abs(x - y).sum(1) + self.beyond[c[s]]
            else:
                out[s] = np.clip(np.round(1 - ((x * y).sum(1) - self.a.shift[r[s]] * self.b.shift[c[s]]), 12), 0, 2)
        return out


def _chord(metric: str, d):
    """The distance in which the triangle inequality holds."""
    return np.sqrt(2 * d) if metric in ("cosine", "correlation") else d


class _Best:
    """The k nearest so far of each of a block's rows; ``kth``: how far the last of them is."""

    def __init__(self, n: int, k: int, kth: np.ndarray):
        self.n, self.k, self.kth = n, k, kth.copy()
        self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def add(self, r: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.held.append((r.astype(np.int32), ids, dist))
        self.waiting += len(r)
        if self.waiting >= max(1 << 14, len(self.held[0][0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, ids, distances, ranks), by row and rank."""
        r, ids, dist = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, dist, r))
        r, ids, dist = r[order], ids[order], dist[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(self.n))[r]
        keep = place < self.k
        last = place == self.k - 1
        self.kth[r[last]] = np.minimum(self.kth[r[last]], dist[last])
        self.held, self.waiting = [(r[keep], ids[keep], dist[keep])], 0
        return (*self.held[0], place[keep] + 1)


def _drop(steps: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
    """Puts the pairs of a row with itself out of reach."""
    steps[own[:, None] == ids] = np.iinfo(np.int32).max


def _products(a: _Block, pair: _Pair, part: np.ndarray, mine: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, meet: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest, by products."""
    open_ = ~np.isfinite(bound)
    if pair.metric == "manhattan" and open_.any() and len(ids) > k:
        d = pair.differences(part[open_], mine)
        if meet:
            d[a.ids[part[open_], None] == ids] = np.inf
        bound[open_] = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
    near = pair.left[part] @ pair.right
    least = pair.least(part, bound)
    if pair.metric != "manhattan" and open_.any() and len(ids) > k:
        d = near[open_]
        if meet:
            d[a.ids[part[open_], None] == ids] = -np.inf
        least[open_] = np.partition(d, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * pair.slack[part[open_]]
    return _places(near >= np.nextafter(least.astype(near.dtype), near.dtype.type(-np.inf))[:, None])


def nearest(a: _Block, b: _Block, k: int, apart: bool, metric: str, best: dict[int, _Best], asking: np.ndarray | None = None) -> None:
    """Adds to ``best`` of each group of b's giving rows those that may be among the k nearest of the
    asking rows of a; ``apart``: rows with one id are the same."""
    rows = np.flatnonzero(a.ask) if asking is None else asking
    pair = _Pair(a, b, metric)
    meet = apart and np.isin(a.ids, b.ids).any()
    for g in np.unique(b.grps[b.give > 0]):
        mine = np.flatnonzero((b.grps == g) & (b.give > 0))
        ids = b.ids[mine]
        if g not in best:
            best[g] = _Best(len(a.ids), k, a.kth)
        counts = pair.count(mine)
        if not counts:
            pair.filter(mine)
        for i in range(0, len(rows), _STEP):
            part = rows[i : i + _STEP]
            bound = best[g].kth[part]
            if counts:
                steps = pair.steps(part)
                if meet:
                    _drop(steps, a.ids[part], ids)
                r, c = _places(pair.within(steps, bound, k))
            else:
                r, c = _products(a, pair, part, mine, ids, bound, k, meet)
            if meet:
                other = a.ids[part[r]] != ids[c]
                r, c = r[other], c[other]
            dist = pair.exact(part[r], mine[c])
            ok = dist <= bound[r]
            best[g].add(part[r[ok]], ids[c[ok]], dist[ok])


def _measure(pivots: list[tuple[list, list, float]], metric: str):
    """Adds the distances to the pivots (and, for metrics of differences, to the origin)."""
    base = metric in ("euclidean", "manhattan")
    every = [([], [], 0.0), *pivots] if base else pivots
    blocks = [_Block(np.zeros(1, np.int64), np.array([len(c)], np.int32), np.array(c, np.int64), np.array(v, np.float64), np.zeros(1, np.int64), np.array([s])) for c, v, s in every]

    def run(batches):
        for batch in batches:
            b = _Block.of(pa.Table.from_batches([batch]))
            n = np.arange(len(b.ids))
            # The pivot's columns are few, so its side is the dense one.
            far = np.stack([_chord(metric, _Pair(p, b, metric).exact(np.zeros(len(n), np.int64), n)) for p in blocks], 1) if blocks else np.zeros((len(n), 0))
            home = far.argmin(1) if blocks else np.zeros(len(n), np.int64)
            more = [pa.array(home.astype(np.int32)), pa.array(far[n, home] if blocks else np.zeros(len(n))), pa.array(list(far), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "home", "near", "far"])

    return run


def _pack(k: int, apart: bool, size: int, metric: str, n_groups: int):
    """Runs of sorted rows as blocks. A row's ``kth`` is how far its k nearest can be: the k-th in its own
    block, of every group, where all groups have as many there; else infinite. ``reach``: its largest."""
    schema = pa.schema([("block", pa.int64()), ("reach", pa.float64()), *((c, pa.list_(pa.float64())) for c in _RANGES), *((c, pa.binary()) for c in _KINDS)])

    def run(batches):
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)

        def block(t: pa.Table):
            b = _Block.of(t)
            found, last = np.zeros(len(b.ids), np.int64), np.zeros(len(b.ids))
            best: dict[int, _Best] = {}
            nearest(b, b, k, apart, metric, best)
            for own in best.values():
                r, _, d, _ = own.settle()
                found += np.bincount(r, minlength=len(found))
                np.maximum.at(last, r, d)
            b.kth = np.where(found == k * n_groups, last, np.inf)
            asks, gives = b.ask > 0, b.give > 0
            row = {"block": next(number), "reach": float(_chord(metric, b.kth[asks].max(initial=0.0)))}
            for mine, names in ((asks, _RANGES[:2]), (gives, _RANGES[2:])):
                f = b.far[mine]
                row |= dict(zip(names, (f.min(0, initial=np.inf).tolist(), f.max(0, initial=-np.inf).tolist()), strict=True))
            row |= {c: b.cell(c) for c in _KINDS}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= size:
                t = pa.Table.from_batches(held)
                for i in range(0, t.num_rows - size + 1, size):
                    yield block(t.slice(i, size))
                held = t.slice(t.num_rows - t.num_rows % size).to_batches()
        if sum(h.num_rows for h in held):
            yield block(pa.Table.from_batches(held))

    return run


def _search(k: int, apart: bool, metric: str):
    """Asking blocks (``wants`` is null) come first and are held; giving ones meet those that want them."""

    def run(batches):
        asks: dict[int, tuple[_Block, dict[int, _Best]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                wants, number = batch.column("wants")[i].as_py(), batch.column("block")[i].as_py()
                block = _Block.read(batch, i)
                if wants is None:
                    asks[number] = block, {}
                    continue
                gives = block.give > 0
                lo, hi = block.far[gives].min(0, initial=np.inf), block.far[gives].max(0, initial=-np.inf)
                for w in wants:
                    a, best = asks[w]
                    asking = np.flatnonzero(a.ask)
                    gap = np.maximum(lo - a.far[asking], a.far[asking] - hi).max(1, initial=0.0)
                    asking = asking[gap - 1e-6 * (1 + np.abs(hi).max(initial=0.0)) <= _chord(metric, a.kth[asking])]
                    if len(asking):
                        nearest(a, block, k, apart, metric, best, asking)
        while asks:
            a, best = asks.popitem()[1]
            while best:
                g, own = best.popitem()
                r, ids, dist, rank = own.settle()
                for lo in range(0, len(r), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[r[s]]), pa.array(ids[s]), pa.array(dist[s]), pa.array(rank[s].astype(np.int32)), pa.array(np.full(len(r[s]), g))], names=["row", "nbr", "dist", "rank", "grp"])

    return run


def _directions(rows: DataFrame, metric: str, n_cols: int | None) -> DataFrame:
    """Rows of length one (less their means, which stay apart as ``shift``, so nothing gets dense)."""
    n = F.lit(float(n_cols)) if n_cols else F.size("vals").cast("double")
    total = lambda f: F.aggregate("vals", F.lit(0.0), lambda s, v: s + f(v))
    r = rows.withColumn("_s", total(lambda v: v * v)).withColumn("_m", total(lambda v: v) / n if metric == "correlation" else F.lit(0.0))
    left = F.col("_s") - n * F.col("_m") * F.col("_m")
    scale = F.when(left > 1e-12 * F.col("_s"), 1 / F.sqrt(left)).otherwise(F.lit(0.0))
    r = r.withColumn("_k", F.coalesce(scale, F.lit(0.0)))
    return r.withColumn("vals", F.transform("vals", lambda v: v * F.col("_k"))).withColumn("shift", F.coalesce(F.sqrt(n) * F.col("_m") * F.col("_k"), F.lit(0.0)))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``a, b``: the blocks whose asking and giving rows may be near enough. One row for a block of some
    thousand rows: pairs of blocks are the work itself."""
    x = blocks.select(F.col("block").alias("a"), "ask_lo", "ask_hi", "reach")
    y = blocks.select(F.col("block").alias("b"), "lo", "hi")
    gap = lambda p, q: F.array_max(F.zip_with(p, q, lambda u, v: u - v))
    apart = F.coalesce(F.greatest(gap("lo", "ask_hi"), gap("ask_lo", "hi")), F.lit(0.0))
    slack = 1e-6 * (1 + F.coalesce(F.array_max(F.transform("hi", F.abs)), F.lit(0.0)))
    return x.join(y, apart - slack <= F.col("reach")).select("a", "b")


def row_blocks(a: DataFrame, b: DataFrame | None, k: int, grouped: bool = False, size: int = BLOCK, metric: str = "euclidean", both: bool = False, n_cols: int | None = None, n_pivots: int = PIVOTS) -> DataFrame:
    """The blocks of the rows of ``a``, which ask, and of those that give: of ``b``, of ``a`` or of both."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    side = lambda r, ask, give: r.select("row", "cols", "vals", "grp", F.lit(0.0).alias("shift"), F.lit(ask).alias("ask"), F.lit(give).alias("give"))
    rows = side(a, True, b is None or both)
    rows = rows if b is None else rows.unionByName(side(b, False, True))
    if metric in ("cosine", "correlation"):
        rows = _directions(rows, metric, n_cols).select("row", "cols", "vals", "grp", "shift", "ask", "give")
    rows = cut(rows)
    some = rows.where(F.size("cols").between(1, _PIVOT_ENTRIES)).orderBy(F.xxhash64("row", "ask"), "row").limit(n_pivots)
    pivots = [(r["cols"], r["vals"], r["shift"]) for r in some.select("cols", "vals", "shift").collect()]
    n_groups = rows.where("give").select("grp").distinct().count() if grouped else 1
    far = rows.mapInArrow(_measure(pivots, metric), _MEASURED)
    sorted_ = far.repartitionByRange("home", "near", "row").sortWithinPartitions("home", "near", "row").drop("home", "near")
    return cut(sorted_.mapInArrow(_pack(k, b is None or both, size, metric, n_groups), _BLOCKS))


def block_knn(a: DataFrame, b: DataFrame | None, k: int, grouped: bool = False, size: int = BLOCK, metric: str = "euclidean", both: bool = False, n_cols: int | None = None) -> DataFrame:
    """``row, nbr, dist, rank`` (and ``grp``): the k nearest rows of ``b`` (of each of its groups) for
    every row of ``a``; without ``b``, of the other rows of ``a``; with ``both``, of ``b`` and the other
    rows of ``a``, whose ids must differ from those of ``b``. ``n_cols``: columns of sparse rows."""
    blocks = row_blocks(a, b, k, grouped, min(size, max(256, _BLOCK_HELD // k)), metric, both, n_cols)
    found = meetings(blocks, k).mapInArrow(_search(k, b is None or both, metric), "row long, nbr long, dist double, rank int, grp long")
    return found.select("row", "nbr", "dist", "rank", *(["grp"] if grouped else []))


def meetings(blocks: DataFrame, k: int) -> DataFrame:
    """The asking blocks of every task, then the giving ones that any of them wants (``wants``)."""
    asks = F.lit(F.exists("ask_lo", lambda v: v < float("inf")) | (F.size("ask_lo") == 0))
    sizes = blocks.where(asks).select("block", (F.length("ids") / 8).alias("n"))
    total = sizes.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    tasks = max(1, min(total["blocks"], max(2 * blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(total["n"] * k / _TASK_HELD))))
    # One row for a block of some thousand rows, dealt by size.
    dealt = sizes.select("block", ((F.row_number().over(Window.orderBy(F.desc("n"), "block")) - 1) % tasks).alias("task"))
    cells = lambda d, wants: d.select("task", "block", wants.alias("wants"), *_KINDS)
    own = cells(blocks.join(dealt, "block"), F.lit(None).cast("array<long>"))
    want = block_pairs(blocks).join(dealt.withColumnRenamed("block", "a"), "a").groupBy("task", F.col("b").alias("block")).agg(F.array_sort(F.collect_list("a")).alias("wants"))
    met = cells(blocks.join(want, "block"), F.col("wants"))
    return own.unionByName(met).repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions(F.col("wants").isNotNull(), "block")
