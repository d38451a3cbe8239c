"""Phrase collocations from a weighted De Bruijn graph.

Nodes are phrases of n-1 words, an edge is a phrase of n words between its
prefix and its suffix and weighs as often as it occurs. Only edges are counted
as they stand. The count of a node is what flows out of it, plus the pieces
that end with it; the count of a shorter phrase is the flow of the phrases that
it starts, plus the pieces that end with it. Edges of equal weight that follow
each other through nodes which nothing else enters or leaves compact to paths.

Most edges are far below the least count. Homes (groups of documents of a
bounded size) first send hashes of their phrases with counts to buckets; a
phrase whose hash stays below the least count in the whole corpus cannot reach
it. Light edges are then not exchanged as text: a home adds what they take from
a node to that node's correction, beside the piece ends, so that flows stay
exact. A collision makes a light phrase pass for a heavy one, which costs a row
and changes no count, since what is counted is the text itself.

Scores are quotients of decimals of 38 digits: exact while 10**6 * a**2 has no
more, that is for counts below 10**15.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows count as often as they stand; extra columns are ignored; an empty
table gives no rows. Wholly equal rows (id and text) belong to one home.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import bucket_bits, cuts, homes, low32, narrow, pack, wide
from .stage import cut
from .text import chunks, measure, mix, scan, word_hashes

_HOME_BYTES = 6 << 20
_BREAKS, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_GAPS = _IS_BREAK.copy()
_GAPS[list(_BLANK)] = True
#: Salts of the first of two rankings, so that no task ranks a whole language.
_SALTS = 64
#: An exact quotient; too large a product is an error, not a wrong score.
SCORE = "CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"


class _Home:
    """The words of a home's documents, and of each length the phrases that start at a word."""

    def __init__(self, t: pa.Table, n: int):
        lang = pc.fill_null(t["lang"].combine_chunks().cast(pa.string()), "und").dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        of_row = np.asarray(lang.indices).astype(np.int64)
        words, hashes, piece, langs, size, base = [], [], [], [], 0, 0
        for rows, buf, offsets in chunks(t["text"]):
            w = scan(buf, offsets, lower=True, gaps=_GAPS)
            owner = w.owner()
            words.append(pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, *self._packed(w)]))
            hashes.append(word_hashes(w))
            piece.append(np.cumsum(_IS_BREAK[buf])[w.starts] + owner + base if len(w.starts) else np.zeros(0, np.int64))
            base += len(buf) + len(offsets)
            langs.append(of_row[rows][owner])
            size += len(w.starts)
        coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
        self.words, self.word_ids = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        self.hashes, self.piece, self.lang = join(hashes, np.uint64), join(piece, np.int64), join(langs, np.int64)
        # The number of words from each word to the end of its piece, itself included.
        ends = np.flatnonzero(np.append(self.piece[1:] != self.piece[:-1], True)) + 1 if size else np.zeros(0, np.int64)
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(size)
        name = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.keys, key = {}, mix(self.hashes ^ name[self.lang], 12)
        for k in range(1, n + 1):
            at = np.flatnonzero(self.left >= k)
            if k > 1:
                key = np.where(self.left >= k, mix(key ^ mix(np.roll(self.hashes, 1 - k), 13), 14 + k), key)
            self.keys[k] = (at, key[at])

    @staticmethod
    def _packed(w) -> list:
        size = w.ends - w.starts
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw = w.buf[np.repeat(w.starts - bounds[:-1], size) + np.arange(bounds[-1])]
        return [pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that start at the words ``at``."""
        parts = [self.words.take(pa.array(self.word_ids[at + i])) for i in range(k)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]

    def unlike(self, at: np.ndarray, which: np.ndarray, first: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        """Groups of equal hashes whose phrases or languages differ; looks at the places ``among``."""
        a, b = at[among], at[first[which[among]]]
        differ = self.lang[a] != self.lang[b]
        for i in range(k):
            differ |= self.word_ids[a + i] != self.word_ids[b + i]
        return np.unique(which[among[differ]])


def _send(n: int, bits: int, at_least: int):
    """Hashes of a home's distinct phrases of every length, with their counts up to ``at_least``."""

    def run(t: pa.Table) -> pa.Table:
        h, home, rows = _Home(t, n), t["home"][0].as_py(), []
        for k in range(1, n + 1):
            keys, count = np.unique(h.keys[k][1], return_counts=True)
            low, count = low32(keys, bits), np.minimum(count, at_least)
            buckets, at = cuts(keys, bits)
            rows += [(home, k, int(b), pack(low[i:j]), narrow(count[i:j])) for b, i, j in zip(buckets, at[:-1], at[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["home", "k", "bucket", "keys", "counts"])

    return run


def _heavy(at_least: int):
    """A bit for every key that a home has sent: do all homes together have it often enough?"""

    def run(t: pa.Table) -> pa.Table:
        cells, counts = ([f(x) for x in t[c].to_pylist()] for f, c in ((lambda x: np.frombuffer(x, np.uint32), "keys"), (wide, "counts")))
        _, which = np.unique(np.concatenate(cells), return_inverse=True)
        hit = np.bincount(which, np.concatenate(counts))[which] >= at_least
        bits = [pack(np.packbits(x)) for x in np.split(hit, np.cumsum([len(c) for c in cells])[:-1])]
        return pa.table({"home": t["home"], "k": t["k"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


_FLOWS = "lang string, k int, phrase string, flow long"


def _flows(n: int, bits: int):
    """Rows ``lang, k, phrase, flow``: heavy edges (k = n) with their count here, and of every other
    heavy phrase the correction: what light phrases take from it and what ends with its piece. With
    k = 0, all words of a language."""

    def run(t: pa.Table, cells: pa.Table) -> pa.Table:
        h, out = _Home(t, n), []
        got = {(k, b): x for k, b, x in zip(*(cells[c].to_pylist() for c in ("k", "bucket", "bits")), strict=True)}
        deeper = np.zeros(len(h.hashes), bool)  # where a heavy phrase of one word more starts
        for k in range(n, 0, -1):
            at, key = h.keys[k]
            keys, first, which = np.unique(key, return_index=True, return_inverse=True)
            hit, (buckets, edge) = np.zeros(len(keys), bool), cuts(keys, bits)
            for i, b in enumerate(buckets):
                m = edge[i + 1] - edge[i]
                hit[edge[i] : edge[i + 1]] = np.unpackbits(np.frombuffer(got[k, int(b)], np.uint8), count=m).astype(bool)
            heavy = hit[which]
            if k == n:
                flow = np.bincount(which, minlength=len(keys))
            else:
                ends = np.bincount(which, h.left[at] == k, len(keys)).astype(np.int64)
                light = np.bincount(which, (h.left[at] > k) & ~deeper[at], len(keys)).astype(np.int64)
                flow = ends + light
            send = np.flatnonzero(hit & (flow > 0))
            if len(send):
                odd = h.unlike(at, which, first, np.flatnonzero(heavy), k)
                if len(odd):  # one hash, several phrases: each occurrence goes for itself
                    send = send[~np.isin(send, odd)]
                    one = np.flatnonzero(np.isin(which, odd))
                    one = one if k == n else one[(h.left[at[one]] == k) | ~deeper[at[one]]]
                    out.append((h.lang[at[one]], k, h.phrases(at[one], k), np.ones(len(one), np.int64)))
                out.append((h.lang[at[first[send]]], k, h.phrases(at[first[send]], k), flow[send]))
            deeper = np.zeros(len(h.hashes), bool)
            deeper[at[heavy]] = True
        total = np.bincount(h.lang, minlength=len(h.langs))
        out.append((np.arange(len(h.langs)), 0, pa.array([b""] * len(h.langs), pa.large_binary()), total))
        names = pa.array(h.langs, pa.string())
        return pa.concat_tables(
            pa.table({"lang": names.take(pa.array(lang)), "k": pa.array(np.full(len(flow), k, np.int32)), "phrase": text.cast(pa.large_string()).cast(pa.string()), "flow": pa.array(flow.astype(np.int64))})
            for lang, k, text, flow in out
        )

    return run


def phrase_counts(docs: DataFrame, n: int = 3, at_least: int = 10, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n_homes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``lang, k, phrase, a`` of all phrases of up to ``n`` words that occur ``at_least`` times;
    ``lang, n``, all words of a language)."""
    m = n_homes or measure(docs, text_col, _HOME_BYTES)
    bits = bucket_bits(m * _HOME_BYTES // 6)
    base = homes(docs.select(id_col, text_col, F.col(lang_col).cast("string").alias("lang")), m, id_col, text_col, more=("lang",)).groupBy("home")
    sent = base.applyInArrow(_send(n, bits, at_least), "home long, k int, bucket long, keys binary, counts binary")
    flags = sent.groupBy("k", "bucket").applyInArrow(_heavy(at_least), "home long, k int, bucket long, bits binary")
    found = base.cogroup(flags.groupBy("home")).applyInArrow(_flows(n, bits), _FLOWS)
    flow = cut(found.groupBy("lang", "k", "phrase").agg(F.sum("flow").alias("flow")))
    level = flow.where(F.col("k") == n).select("lang", "phrase", "flow")
    counts = [level.select("lang", F.lit(n).alias("k"), "phrase", F.col("flow").alias("a"))]
    for k in range(n - 1, 0, -1):
        # A shorter phrase: the flow of those that it starts, and its corrections.
        through = level.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "flow")
        level = flow.where(F.col("k") == k).select("lang", "phrase", "flow").unionByName(through).groupBy("lang", "phrase").agg(F.sum("flow").alias("flow"))
        counts.append(level.select("lang", F.lit(k).alias("k"), "phrase", F.col("flow").alias("a")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return cut(out.where(F.col("a") >= at_least)), flow.where("k = 0").select("lang", F.col("flow").alias("n"))


def paths(counts: DataFrame, n: int = 3) -> DataFrame:
    """``lang, words, a``: the heavy edges, compacted. An edge goes on to the next where the node
    between them has the weight of both: then nothing else enters or leaves it, and no piece starts or
    ends there. A path lies inside a piece, so it is no longer than one; every round of pointer
    jumping doubles how far an edge looks back."""
    tail = F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    edges = counts.where(F.col("k") == n).select("lang", "phrase", "a", F.substring_index("phrase", " ", n - 1).alias("node"), tail.alias("next"))
    nodes = counts.where(F.col("k") == n - 1).select("lang", F.col("phrase").alias("node"), "a")
    into = edges.select("lang", F.col("next").alias("node"), "a", F.col("phrase").alias("back"))
    unary = into.join(nodes, ["lang", "node", "a"])
    linked = edges.join(unary, ["lang", "node", "a"], "left").select("lang", "phrase", "a", F.coalesce("back", "phrase").alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("far"))
    linked = cut(linked)
    before = linked.agg(F.sum("far")).first()[0] or 0
    while before:
        seen = linked.select("lang", F.col("phrase").alias("head"), F.col("head").alias("head2"), F.col("far").alias("far2"))
        moved = linked.where("far > 0").join(seen, ["lang", "head"]).select("lang", "phrase", "a", F.col("head2").alias("head"), (F.col("far") + F.col("far2")).alias("far"))
        now = moved.agg(F.sum("far")).first()[0] or 0
        if now == before:
            break
        linked, before = cut(linked.where("far = 0").unionByName(moved)), now
    parts = linked.groupBy("lang", "head").agg(F.first("a").alias("a"), F.sort_array(F.collect_list(F.struct("far", F.substring_index("phrase", " ", -1).alias("w")))).alias("steps"))
    words = F.concat(F.split("head", " "), F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: s["w"]))
    return parts.select("lang", words.alias("words"), "a")


def _inside(words, k: int):
    """All runs of ``k`` words of an array, joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))


def collocations(docs: DataFrame, n: int = 3, at_least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n_homes: int | None = None) -> DataFrame:
    """``lang, rank, phrase, k, a, l, r, n, score``: of each language the ``top`` phrases of 2 to
    ``n`` words with a count a of ``at_least``, by floor(10**6 a**2 / (l r)), where l and r are the
    counts of the parts at the cut where this is least. Left out is a phrase that lies inside a
    longer one with ``percent`` percent of its count or more."""
    counts, totals = phrase_counts(docs, n, at_least, text_col, lang_col, id_col, n_homes)
    # A phrase inside a path has a phrase of n words around it with the path's weight.
    around = [paths(counts, n).select("lang", F.explode(_inside("words", k)).alias("phrase"), F.col("a").alias("longer")) for k in range(2, n)]
    for j in range(3, n):
        grams = counts.where(F.col("k") == j).select("lang", F.split("phrase", " ").alias("words"), "a")
        around += [grams.select("lang", F.explode(_inside("words", k)).alias("phrase"), F.col("a").alias("longer")) for k in range(2, j)]
    kept = counts.where("k >= 2")
    if around:
        every = around[0]
        for x in around[1:]:
            every = every.unionByName(x)
        most = every.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = kept.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    part = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts_ = kept.select("lang", "phrase", "k", "a", part.alias("at")).withColumn("left", F.expr("substring_index(phrase, ' ', at)")).withColumn("right", F.expr("substring_index(phrase, ' ', at - k)"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts_.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("b")).select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("k").cast("long").alias("k"), "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
