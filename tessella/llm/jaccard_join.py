"""Exact n-gram Jaccard self-join and its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles (a pair of
sets of n and m shingles is misjudged with a chance of n*m / 2**64).

1. Equal sets are one class by two fingerprints of 64 bits; only a representative goes on.
2. A pair at similarity t shares at least t*n tokens of either set. So of the
   lowest half of a set's tokens (p of n), at least p - (n - t*n) must occur in
   another set, and then so many are among that set's lowest half and one more:
   those are published. A packed exchange of 32 bits a token drops the sets
   where they do not. What is left are near copies and little else.
3. For those, token frequencies are counted exactly; tokens are ordered rarest
   first, and the first n - t*n + 1 of each set (less those that no other set
   has) are its prefix: similar sets share a prefix token.
4. Tiles are (prefix token, size band); a set stands in the tiles of its band
   and the one below, and sets of a similar pair meet in one of them. First
   every tile's most central set (that with the most common tokens) is compared
   with the others, and the links are contracted to components. Then all pairs
   of a tile in different components are compared, less those that the token's
   places in both sets rule out. A group of thousands of near copies is so contracted
   by a linear number of comparisons; no pair that could join two components is
   left out.
5. A pair is compared by hashed bitmaps as wide as its band needs: bits that one
   has alone bound the overlap from above. Survivors are settled by intersecting
   the sorted arrays.

Defined results: a text of fewer than ``k`` words is one shingle, of none an
empty set that links with nothing; null text is empty; rows with the same
doc_id are compared like others; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .packed import bucket_bits, cuts, homes, low32, pack, repeated_bits, row_key
from .stage import cut, store
from .text import chunks, measure, mix, prefix, scan, span_hash, word_hashes

_HOME_BYTES = 3 << 20


def least_overlap(n, percent: int):
    """Tokens that a set of n must share with any set at this similarity."""
    return (percent * n + 99) // 100


class _Sets:
    """Shingle sets of a home's documents: ``keys[bounds[i]:bounds[i + 1]]`` sorted, distinct."""

    def __init__(self, t: pa.Table, k: int):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, buf, offsets in chunks(t["text"]):
            w = scan(buf, offsets, lower=True)
            hashes.append(word_hashes(w))
            counts.append(w.counts)
        counts = np.concatenate(counts)
        ends = np.cumsum(counts)
        n = np.where(counts >= k, counts - (k - 1), np.minimum(counts, 1))
        doc = np.repeat(np.arange(len(n)), n)
        first = np.arange(n.sum()) + np.repeat((ends - counts) - (np.cumsum(n) - n), n)
        keys = span_hash(prefix(np.concatenate(hashes)), first, np.minimum(first + k, ends[doc]))
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.zeros(0, bool)
        self.keys, self.doc = keys[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(n))
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])
        self.print_a, self.print_b = self._fingerprint(11), self._fingerprint(13)

    def _fingerprint(self, seed: int) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.keys, seed))])
        return mix((total[self.bounds[1:]] - total[self.bounds[:-1]]) + self.n.astype(np.uint64), seed + 1).view(np.int64)

    def keep(self, marks: pa.Table) -> None:
        """Keeps one row for each class of the marks, under the class's id."""
        cells = [x for x in marks["ids"].to_pylist() if x]
        wanted = {(c["print_a"], c["print_b"]): c["set_id"] for x in cells for c in x}
        found = [(i, c) for i, p in enumerate(zip(self.print_a.tolist(), self.print_b.tolist(), strict=True)) if (c := wanted.pop(p, None)) is not None]
        rows = np.array([i for i, _ in found], np.int64)
        stay = np.isin(self.doc, rows)
        self.keys, self.n, self.set_id = self.keys[stay], self.n[rows], np.array([c for _, c in found], np.int64)
        self.doc, self.bounds = np.repeat(np.arange(len(rows)), self.n), np.concatenate([[0], np.cumsum(self.n)])

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, their sets, whether tested) of the lower half of each set and one more, that is only published."""
        place, half = np.arange(len(self.keys)) - self.bounds[self.doc], (self.n[self.doc] + 1) // 2
        at = place <= half
        keys, doc, tested = self.keys[at], self.doc[at], (place < half)[at]
        order = np.argsort(keys, kind="stable")
        return keys[order], doc[order], tested[order]


def _profile(k: int):
    def run(t: pa.Table) -> pa.Table:
        s = _Sets(t, k)
        return pa.table({"home": t["home"], "key": t["key"], "doc_id": t["doc_id"], "n": pa.array(s.n.astype(np.int64)), "print_a": pa.array(s.print_a), "print_b": pa.array(s.print_b)})

    return run


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and their counts."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _send_probes(k: int, bits: int):
    def run(t: pa.Table, marks: pa.Table) -> pa.Table:
        rows, home = [], None
        if t.num_rows and marks.num_rows:
            s, home = _Sets(t, k), t["home"][0].as_py()
            s.keep(marks)
            keys = _distinct(s.probes()[0])[0]
            buckets, at = cuts(keys, bits)
            low = low32(keys, bits)
            rows = [(int(b), pack(np.sort(low[i:j]))) for b, i, j in zip(buckets, at[:-1], at[1:], strict=True)]
        return pa.table({"home": pa.array([home] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _candidates(k: int, bits: int, percent: int):
    """The sets of which enough probes occur in another set."""

    def run(t: pa.Table, marks: pa.Table) -> pa.Table:
        out = {"home": [], "set_id": [], "n": [], "tokens": []}
        if t.num_rows and marks.num_rows:
            s = _Sets(t, k)
            s.keep(marks)
            keys, doc, tested = s.probes()
            distinct, count = _distinct(keys)
            got = {b: x for b, x in zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist(), strict=True) if x is not None}
            hit = count > 1
            buckets, at = cuts(distinct, bits)
            for b, i, j in zip(buckets, at[:-1], at[1:], strict=True):
                if cell := got.get(int(b)):
                    hit[i:j] |= np.unpackbits(np.frombuffer(cell, np.uint8), count=j - i).astype(bool)
            shared = np.bincount(doc, np.repeat(hit, count) & tested, minlength=len(s.n))
            for i in np.flatnonzero((s.n > 0) & (shared >= (s.n + 1) // 2 - (s.n - least_overlap(s.n, percent)))):
                for name, x in (("home", t["home"][0].as_py()), ("set_id", int(s.set_id[i])), ("n", int(s.n[i])), ("tokens", pack(s.keys[s.bounds[i] : s.bounds[i + 1]]))):
                    out[name].append(x)
        return pa.table([pa.array(out["home"], pa.int64()), pa.array(out["set_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["tokens"], pa.binary())], names=list(out))

    return run


def _tokens(t: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist())])


def _send_tokens(bits: int):
    def run(t: pa.Table) -> pa.Table:
        keys, count = _distinct(np.sort(_tokens(t)))
        buckets, at = cuts(keys, bits)
        rows = list(zip(at[:-1], at[1:], strict=True))
        return pa.table(
            {
                "home": pa.array([t["home"][0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(buckets, pa.int64()),
                "keys": pa.array([pack(keys[i:j]) for i, j in rows], pa.binary()), "counts": pa.array([pack(count[i:j].astype(np.uint32)) for i, j in rows], pa.binary()),
            }
        )

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    cells = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t["counts"].to_pylist()])
    _, which = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(which, counts)[which].astype(np.uint32)
    parts = np.split(total, np.cumsum([len(c) for c in cells])[:-1])
    return pa.table({"home": t["home"], "bucket": t["bucket"], "counts": pa.array([pack(x) for x in parts], pa.binary())})


def _prefixes(bits: int, percent: int):
    """Prefix tokens, rarest first, without those that no other set has."""

    def run(t: pa.Table, counts: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if t.num_rows:
            n = t["n"].to_numpy()
            every, set_ids = _tokens(t), t["set_id"].to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            order = np.argsort(every, kind="stable")
            keys, local = _distinct(every[order])
            got = dict(zip(counts["bucket"].to_pylist(), counts["counts"].to_pylist(), strict=True))
            buckets, _ = cuts(keys, bits)
            total = np.concatenate([np.frombuffer(got[int(b)], np.uint32) for b in buckets])
            df = np.empty(len(every), np.int64)
            df[order] = np.repeat(total, local)
            live = np.bincount(doc, df > 1, minlength=len(n)) >= least_overlap(n, percent)
            rank = np.lexsort((every, df, doc))
            place = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n)
            take = rank[(place <= (n - least_overlap(n, percent))[doc[rank]]) & live[doc[rank]]]
            take = take[df[take] > 1]
            where = np.empty(len(every), np.int64)
            where[rank] = place
            weight = np.bincount(doc, df, minlength=len(n)) / n  # a middle set has the most common tokens
            out = [every[take].view(np.int64), set_ids[doc[take]], n[doc[take]], where[take], (1024 * weight).astype(np.int64)[doc[take]]]
        return pa.table(dict(zip(("token", "set_id", "n", "place", "weight"), map(pa.array, out), strict=True)))

    return run


def _bitmap(batches):
    """A bitmap of 4 bits a token, a power of two wide, for every set."""
    for b in batches:
        cells = []
        for x in b.column("tokens").to_pylist():
            keys = np.frombuffer(x, np.uint64)
            width = max(64, 1 << int(4 * len(keys) - 1).bit_length())
            bits = np.zeros(width, bool)
            bits[(keys & np.uint64(width - 1)).astype(np.int64)] = True
            cells.append(pack(np.packbits(bits, bitorder="little")))
        yield pa.RecordBatch.from_arrays([b.column("set_id"), b.column("n"), pa.array(cells, pa.binary())], names=["set_id", "n", "bitmap"])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _bounded(percent: int):
    """Pairs whose bitmaps allow the overlap that the similarity needs."""

    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                x, y = _fold(x, size), _fold(y, size)
                most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
                keep.append((100 + percent) * most >= percent * (n + m))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _exact(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                s = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((s[1:] == s[:-1]).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _settle(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that reach the similarity."""
    left = bitmaps.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    right = bitmaps.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    pairs = pairs.join(left, "a").join(right, "b").mapInArrow(_bounded(percent), "a long, b long")
    left, right = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_exact(percent), "a long, b long")


def _tiles(rows: DataFrame) -> DataFrame:
    """Each row in the tile of its size band (a factor of 4/3) and in the one below."""
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    return rows.withColumn("tile", F.explode(F.array(band, band - 1)))


def _contracted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Prefix rows of the tokens that still stand in several components."""
    rows = rows.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return rows.join(mixed, "token")


def _stars(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of every tile's most central set with the sets of other components."""
    pivot = F.max(F.struct("weight", "set_id", "n", "component")).alias("p")
    pivots = tiles.groupBy("token", "tile").agg(pivot, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "tile", "p")
    near = "100 * least(n, p.n) >= %d * greatest(n, p.n)" % percent
    stars = tiles.join(pivots, ["token", "tile"]).where("component <> p.component").where(near)
    return stars.select(F.greatest("set_id", "p.set_id").alias("a"), F.least("set_id", "p.set_id").alias("b")).distinct()


def _pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """All pairs of a tile in different components that the places of the token allow: at the
    first token that a pair shares, what follows in the shorter rest bounds the overlap."""
    other = tiles.select("token", "tile", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("other"), F.col("place").alias("pb"))
    most = "(%d) * least(n - place, nb - pb) >= %d * (n + nb)" % (100 + percent, percent)
    return tiles.join(other, ["token", "tile"]).where("set_id > b and component <> other").where(most).select(F.col("set_id").alias("a"), "b")


def _linked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, n_homes: int | None) -> DataFrame:
    """``doc_id, key, n, component, component_id`` of every row; ``component`` is null for empty sets
    and ``component_id``, the smallest doc_id, also where a component has none."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    n = n_homes or measure(docs, text_col, _HOME_BYTES)
    bits = bucket_bits(n * _HOME_BYTES // 12)
    base = homes(docs, n, id_col, text_col)
    by_home = base.groupBy("home")

    profile = cut(by_home.applyInArrow(_profile(k), "home long, key long, doc_id long, n long, print_a long, print_b long"))
    classes = profile.where("n > 0").groupBy("print_a", "print_b").agg(F.min("doc_id").alias("first"), F.min("home").alias("home"))
    # Of different sets with one first fingerprint, all but one are named by both.
    again = F.row_number().over(Window.partitionBy("print_a").orderBy("print_b")) > 1
    classes = cut(classes.withColumn("set_id", F.when(again, F.xxhash64("print_a", "print_b")).otherwise(F.col("print_a"))))
    marks = classes.groupBy("home").agg(F.collect_list(F.struct("print_a", "print_b", "set_id")).alias("ids"))  # of a home of bounded size

    flags = repeated_bits(by_home.cogroup(marks.groupBy("home")).applyInArrow(_send_probes(k, bits), "home long, bucket long, keys binary"))
    both = flags.withColumn("ids", F.lit(None).cast(marks.schema["ids"].dataType)).unionByName(marks.select("home", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "ids"))
    sets = cut(by_home.cogroup(both.groupBy("home")).applyInArrow(_candidates(k, bits, percent), "home long, set_id long, n long, tokens binary"))

    of_home = sets.groupBy("home")
    counts = of_home.applyInArrow(_send_tokens(bits), "home long, bucket long, keys binary, counts binary").groupBy("bucket").applyInArrow(_frequencies, "home long, bucket long, counts binary")
    rows = cut(of_home.cogroup(counts.groupBy("home")).applyInArrow(_prefixes(bits, percent), "token long, set_id long, n long, place long, weight long"))
    bitmaps = sets.mapInArrow(_bitmap, "set_id long, n long, bitmap binary")

    links = cut(_settle(_stars(_tiles(rows.withColumn("component", F.col("set_id"))), percent), sets, bitmaps, percent))
    found = components(links)
    pairs = _pairs(cut(_tiles(_contracted(rows, found))), percent)
    more = cut(_settle(pairs.distinct(), sets, bitmaps, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    classes = cut(classes.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").select("print_a", "print_b", "first", F.coalesce("component", "set_id").alias("component")))
    root = store(classes.groupBy("component").agg(F.min("first").alias("component_id")))
    of_class = classes.join(root, "component").select("print_a", "print_b", "component", "component_id")
    return profile.join(of_class, ["print_a", "print_b"], "left")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", n_homes: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of the documents whose shingle sets have a
    Jaccard similarity of at least ``percent`` / 100 (at least 75: a band spans a factor of 4/3)."""
    out = _linked(docs, k, percent, id_col, text_col, n_homes)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", n_homes: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component one row, with the smallest id
    (null last). Rows that repeat in id and text are one; rows without words all stay."""
    rows = cut(_linked(docs, k, percent, id_col, text_col, n_homes).select("doc_id", "key", "component"))
    linked = rows.where("component is not null").groupBy("component")
    kept = linked.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")).select("m.doc_id", "m.key")
    kept = store(kept.unionByName(rows.where("component is null").select("doc_id", "key").distinct()))
    several = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c"), F.max("component").alias("component")).where("c > 1 and component is not null")
    # A struct holds the columns, so that their names cannot clash with those of the join.
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"), row_key(id_col, text_col).alias("row_key"))
    out = d.join(kept, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("key")), "left_semi")
    if not several.isEmpty():
        wordless = out.where(~F.coalesce(F.col("row." + text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
        out = out.where(F.col("row." + text_col).rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["row_id", "row_key"]).unionByName(wordless)
    return out.select("row.*")
