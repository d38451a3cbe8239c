"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are its source's target words over the source's
words. The whole part is certain; the fractional parts are rounded together.
Two documents of a source are paired: words move from one to the other, in a
random direction with the odds that keep both expectations, until one of the
fractions is 0 or 1. The pair's expected words stay the same, so a whole
source's do, up to the last document, whose fraction is drawn alone: a source's
taken words miss its target by less than one document's size.

Rows that repeat in source, id and text are one group: paired among themselves,
all of them but one become integral, and only that one goes on. Pairs of others
are formed by folding blocks of some hundred documents, largest first, so that
large ones are settled while small ones are left; a block leaves one fraction,
which joins those of other blocks at the next level of a reduction tree until a
source has one. A source of any share is many blocks, and a group of copies of
any size is one item. All random numbers are hashes of the document and the seed.

Only DataFrame functions; no Python runs on the executors, and no window spans
more than a range of sources.

Defined results: null text has size 0 and takes nothing; a null source is a
source, last in order; sources without words have target 0; an empty table gives
an empty one; repeated rows are documents of their own, and which of them are
taken once more is arbitrary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import cut, store

#: Documents folded by one task at a time, and rows of one group that one row unfolds to.
BLOCK, UNFOLD = 200, 1000


def n_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place (from 0) by code point, null last: ranges of sources are sorted
    and counted apart, and the counts before a range (one row each) are added up."""
    last = F.col("source").isNull()
    parts = store(sources.repartitionByRange(last, "source").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    shift = parts.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = F.row_number().over(Window.partitionBy("range").orderBy(last, "source"))
    return parts.withColumn("here", here).join(F.broadcast(shift.select("range", "shift")), "range").withColumn("place", F.col("shift") + F.col("here") - 1).drop("range", "shift", "here")


def targets(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, source_size, n_docs``.

    Target = min(cap * size, weight * level) with the level at which the targets
    sum to ``share`` of all sizes. Sources that reach their cap at a level keep it, and what is
    above is shared again by weight, until no other reaches it: an aggregate a turn.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = cut(_ranked(sources).withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size")))
    size = float(s.agg(F.sum("source_size")).first()[0] or 0)
    total, level, full = min(share, cap) * size, 0.0, -1
    while True:
        over = F.col("cap") <= F.col("w") * level
        row = s.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        if row[0] == full or not row[2]:
            level = level if row[2] else float("inf")
            break
        full, level = row[0], (total - (row[1] or 0.0)) / row[2]
    return s.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def _uniform(*cols):
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


_KEY = ("id", "more", "size")
_ITEM = "struct<order:bigint,id:bigint,more:bigint,size:bigint,p:double,u:double>"
_DONE = "array<struct<id:bigint,more:bigint,size:bigint,k:int>>"


def _fold(items):
    """Pairs the open item with the next, again and again: (last open item, decided items)."""
    none = F.array().cast(_DONE)

    def step(acc, x):
        o = acc["open"]
        up_o, up_x = (1 - o["p"]) * o["size"], (1 - x["p"]) * x["size"]  # words to the next whole copy
        down_o, down_x = o["p"] * o["size"], x["p"] * x["size"]
        forth, back = F.least(up_o, down_x), F.least(down_o, up_x)
        gain = x["u"] * (forth + back) < back  # o gains words from x
        o_ends = (gain & (up_o <= down_x)) | (~gain & (down_o <= up_x))
        p = F.when(o_ends, x["p"] + F.when(gain, -forth).otherwise(back) / x["size"]).otherwise(o["p"] + F.when(gain, forth).otherwise(-back) / o["size"])
        field = lambda n, a=x, b=o: F.when(o_ends, a[n]).otherwise(b[n]).alias(n)
        rest = F.struct(field("order"), *(field(n) for n in _KEY), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), field("u"))
        ended = F.struct(*(field(n, o, x) for n in _KEY), (o_ends == gain).cast("int").alias("k"))
        new = F.when(o.isNull(), x).otherwise(rest)
        return F.struct(new.cast(_ITEM).alias("open"), F.when(o.isNull(), none).otherwise(F.concat(acc["done"], F.array(ended))).cast(_DONE).alias("done"))

    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), none.alias("done"))
    return F.aggregate(items, start, step)


def _decide(groups: DataFrame, weights, share: float, cap: float, seed: int, block: int) -> DataFrame:
    """``source, id, more, size, m, source_size, target, whole, up``: of the ``m`` rows of a group,
    ``up`` are taken ``whole`` + 1 times and the others ``whole`` times."""
    goal = targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_docs")), list(weights), share, cap)
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(per_doc + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), per_doc - F.col("whole")))
    goal = goal.withColumn("p", F.when(F.col("p") < 1e-12, 0.0).otherwise(F.col("p")))
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    keyed = goal.withColumnRenamed("source", "s")
    same = lambda a: F.col(a).eqNullSafe(F.col("s"))

    # A source has one row: a small table is broadcast by its known size, else AQE splits hot sources.
    items = groups.join(keyed, same("source"), "left").drop("s")
    once = F.col("m") * F.col("p")
    alone = F.floor(once + 1e-9)  # rows of a group that become 1 by pairs among themselves
    items = items.withColumn("up", F.when(F.col("size") > 0, alone).otherwise(F.lit(0)).cast("long")).withColumn("left", F.when((F.col("size") > 0) & (once - alone > 1e-9), once - alone).otherwise(0.0))
    level, blocks, decided = 0, F.ceil(F.col("n_docs") / block), []
    rest = items.where("left > 0").select("source", "n_docs", *_KEY, F.col("left").alias("p"))
    while True:
        h = F.xxhash64(*_KEY, F.lit(seed), F.lit(level))
        item = F.struct((-F.col("size")).alias("order"), *_KEY, "p", _uniform(*_KEY, F.lit(seed), F.lit(level + 1000)).alias("u")).cast(_ITEM)
        folded = rest.groupBy("source", "n_docs", F.pmod(h, blocks).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = cut(folded.select("source", "n_docs", _fold(F.col("items")).alias("f")))
        decided.append(folded.select("source", F.explode("f.done").alias("x")).select("source", *(f"x.{n}" for n in _KEY), "x.k"))
        rest = folded.select("source", "n_docs", *(f"f.open.{n}" for n in (*_KEY, "p")))
        sure = (F.col("p") < 1e-9) | (F.col("p") > 1 - 1e-9)
        if most <= block ** (level + 1):
            break
        decided.append(rest.where(sure).select("source", *_KEY, F.round("p").cast("int").alias("k")))
        rest = rest.where(~sure)
        level, blocks = level + 1, F.ceil(F.col("n_docs") / block ** (level + 2))
    last = _uniform(*_KEY, F.lit(seed), F.lit(-1)) < F.col("p")
    decided.append(rest.select("source", *_KEY, F.when(sure, F.round("p").cast("int")).otherwise(last.cast("int")).alias("k")))

    ones = decided[0].where("k = 1")
    for x in decided[1:]:
        ones = ones.unionByName(x.where("k = 1"))
    ones = ones.select(*(F.col(n).alias(f"one_{n}") for n in ("source", *_KEY)), "k")
    on = [F.col(n).eqNullSafe(F.col(f"one_{n}")) for n in ("source", "id")] + [F.col(n) == F.col(f"one_{n}") for n in ("more", "size")]
    out = items.join(ones, on[0] & on[1] & on[2] & on[3], "left")
    return out.select("source", *_KEY, "m", "source_size", "target", "whole", (F.col("up") + F.coalesce("k", F.lit(0))).alias("up"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    """``source, id, more, size`` of a row: rows that agree in id, source and text are a group."""
    text = F.col(text_col)
    return [F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("more"), n_words(text).alias("size")]


def _unfolded(rows: DataFrame, count: str, many: bool) -> DataFrame:
    """Every row ``count`` times, numbered from 1 as ``n``. Where ``many`` are possible, a row is
    first unfolded to runs, which are dealt out."""
    each = lambda first, last: F.explode(F.sequence(first, F.least(last, F.col(count)))).alias("n")
    if not many:
        return rows.select("*", each(F.lit(1).cast("long"), F.col(count)))
    runs = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / UNFOLD))).alias("run")).repartition("source", *_KEY, "run")
    return runs.select("*", each(F.col("run") * UNFOLD + 1, (F.col("run") + 1) * UNFOLD)).drop("run")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document."""
    d = docs.select(*_keyed(docs, id_col, text_col, source_col))
    groups = cut(d.groupBy("source", *_KEY).agg(F.count(F.lit(1)).alias("m")))
    out = _decide(groups, weights, share, cap, seed, block)
    out = _unfolded(out, "m", not groups.where(F.col("m") > UNFOLD).isEmpty())
    copies = F.col("whole") + (F.col("n") <= F.col("up")).cast("int")
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Of rows that agree in id, source and
    text, one stands for all."""
    # A struct holds the columns, so that their names cannot clash with those of the mix.
    rows = docs.select(F.struct("*").alias("row"), *_keyed(docs, id_col, text_col, source_col))
    groups = cut(rows.groupBy("source", *_KEY).agg(F.count(F.lit(1)).alias("m")))
    out = _decide(groups, weights, share, cap, seed, block)
    out = out.select(*(F.col(n).alias(f"taken_{n}") for n in ("source", *_KEY)), (F.col("whole") * F.col("m") + F.col("up")).alias("copies")).where("copies > 0")
    on = F.col("more") == F.col("taken_more")
    for n in ("source", "id", "size"):
        on = on & F.col(n).eqNullSafe(F.col(f"taken_{n}"))
    out = rows.join(out, on).select("row", "source", *_KEY, "copies")
    if not groups.where("m > 1").isEmpty():
        out = out.dropDuplicates(["source", *_KEY])
    return _unfolded(out, "copies", not groups.where(F.col("m") > UNFOLD // 4).isEmpty()).select("row.*")
