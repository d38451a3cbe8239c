"""Scoring by a Brown class-based bigram model.

Every word of the training documents has a class. The ``core`` most frequent
words are exchanged between classes one by one while that raises the likelihood
of the class bigrams. All other words are exchanged in distributed rounds: a scan
counts, for every word, the classes before and after it, and the word moves to
the class in which these are likeliest under the class bigrams, all words of a
round at once. The vocabulary and these counts are distributed tables of any
size; nothing is clustered by spelling.

A token's probability given the class d before it is

    lam * P(class | d) * (c + 0.5) / (N(class) + 0.5 * (V(class) + 1)) + (1 - lam) * base

with base = (c + 0.5) / (N + 0.5 * (V + 1)). Every class keeps the mass of half
a count for unknown words; these are one event, whose probability is the sum
over classes. Known words and that event sum to one for any d. After an unknown
word, P(class) is that of any place. Perplexity is 10 ** (-score / n_tokens).

Plan. Scans of the texts: word counts, bigrams of the core, contexts of words
(one a round, and one for the words beyond the head), scores. The ``head`` most
frequent words travel to the tasks with counts and classes as arrays (a fixed
bound of some 20 MB); tokens beyond them, a few percent, and those that follow
them are joined with the full table by word. Contexts travel packed in buckets
of the word's hash, at most two entries a class for a word and chunk.

Words are identified by 64-bit hashes: among V distinct words, two coincide
with a chance of V**2 / 2**65.

Defined results: null and empty texts have the end token alone; documents with
a null id are training documents and keep a row each; repeated rows count
again; an empty training set leaves V = N = 0 and all words unknown; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bucket_bits, pack
from .stage import cut, store
from .text import Words, chunks, mix, scan, word_hashes

N_CLASSES, CORE, HEAD, ROUNDS, LAM = 64, 1024, 1 << 20, 2, 0.95
#: The hash that stands for the end token.
END = np.uint64(0x5EEDE4D)
_FLUSH = 1 << 20
#: Words whose contexts lie in one row of the context table, and bytes of text in a step that counts them.
_SLICE, _CHUNK = 8192, 3 << 20


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, token -> distinct, token bounds of the texts)."""
    w: Words = scan(buf, offsets, lower=True)
    distinct, which = np.unique(np.insert(word_hashes(w), w.bounds[1:], END), return_inverse=True)
    return distinct, which, w.bounds + np.arange(len(w.bounds))


def _count(batches):
    """``word, c`` of the tasks' tokens, summed up to a fixed number of words."""

    def merged(parts):
        words, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, which = np.unique(words, return_inverse=True)
        return distinct, np.bincount(which, c).astype(np.int64)

    batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], names=["word", "c"])
    parts, held = [], 0
    for batch in batches:
        for _, buf, offsets in chunks(batch.column("text")):
            distinct, which, _ = _tokens(buf, offsets)
            parts.append((distinct, np.bincount(which, minlength=len(distinct))))
            held += len(distinct)
            if held > _FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > _FLUSH // 2:
                    yield batch_of(parts[0])
                    parts, held = [], 0
    if parts:
        yield batch_of(merged(parts))


def _find(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 for words that it lacks."""
    if not len(table):
        return np.full(len(words), -1)
    i = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[i] == words, i, -1)


def _bigrams(core: np.ndarray):
    """``pair, c``: counts of neighbours that are both in the core."""
    size, end = len(core), int(_find(np.array([END]), core)[0])

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, buf, offsets in chunks(batch.column("text")):
                distinct, which, bounds = _tokens(buf, offsets)
                unit = _find(distinct, core)[which]
                before = np.concatenate([[end], unit[:-1]])
                before[bounds[:-1]] = end
                both = (unit >= 0) & (before >= 0)
                total += np.bincount(before[both] * size + unit[both], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "c"])

    return run


def exchange(bigrams: np.ndarray, n_classes: int = N_CLASSES, rounds: int = 8) -> np.ndarray:
    """The class of every unit. The most frequent units open the classes, the others enter in order
    of frequency where the likelihood of the class bigrams among those present is highest; then
    units move one by one until none gains."""
    size = len(bigrams)
    freq = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-freq, kind="stable")
    cls = np.full(size, -1)
    f = lambda x: x * np.log(np.maximum(x, 1))
    b = bigrams.astype(float)
    opened = 0
    right, left, m = np.zeros((size, n_classes)), np.zeros((size, n_classes)), np.zeros((n_classes, n_classes))
    for _ in range(rounds + 1):
        moved = 0
        for w in order:
            if not freq[w]:
                cls[w] = 0
                continue
            a, s = cls[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            if a >= 0:
                r[a] -= s
                l[a] -= s
                m[a] -= r
                m[:, a] -= l
                m[a, a] -= s
            fm = f(m)
            rows, cols = f(m + r) - fm, f(m + l[:, None]) - fm
            diag = np.diagonal(m)
            gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols) + f(diag + r + l + s) - f(diag)
            out, into = m.sum(1) + l, m.sum(0) + r  # with the bigrams of w, wherever it goes
            gain -= f(out + r.sum() + s) - f(out) + f(into + l.sum() + s) - f(into)
            k = int(np.argmax(gain))
            if a < 0 and opened < n_classes:
                k, opened = opened, opened + 1
            if a >= 0 and gain[k] <= gain[a] + 1e-9:
                k = a
            m[k] += r
            m[:, k] += l
            m[k, k] += s
            if k != a:
                cls[w] = k
                if a >= 0:
                    right[:, a] -= b[:, w]
                    left[:, a] -= b[w]
                right[:, k] += b[:, w]
                left[:, k] += b[w]
                moved += 1
        if not moved:
            break
    return cls


class Vocabulary:
    """The head words (sorted hashes) with counts and classes (-1: none yet), and which are the core."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_classes: int, core: int):
        self.words, self.counts, self.n_classes = words, counts, n_classes
        self.cls, self.fixed = np.full(len(words), -1, np.int16), np.zeros(len(words), bool)
        self.fixed[np.lexsort((words, -counts))[:core]] = True

    @property
    def core(self) -> np.ndarray:
        return self.words[self.fixed]

    @property
    def end(self) -> int:
        """The class of the end token; 0 where there are no words at all."""
        i = int(_find(np.array([END]), self.words)[0])
        return max(int(self.cls[i]), 0) if i >= 0 else 0


_CONTEXTS = "bucket long, words binary, sizes binary, slots binary, counts binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXTS.split(", ")]


def _context_batch(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([pack(r[i]) for r in rows], pa.binary()) for i in range(1, 5))], names=_CONTEXT_NAMES)


def _packed(bucket: int, words: np.ndarray, entries: np.ndarray, counts: np.ndarray, slots: int) -> tuple:
    """A row from entries ``word number * slots + slot``, in order."""
    sizes = np.bincount(entries // slots, minlength=len(words))
    return bucket, words, sizes.astype(np.uint16), (entries % slots).astype(np.uint8), counts.astype(np.uint32)


def _contexts(shared, bits: int, tail: bool):
    """Classes before (slot j) and after (slot n_classes + j) the words of the head that are not in
    the core, or, with ``tail``, of the words beyond the head. A bucket below 0 has class bigrams."""

    def run(batches):
        from pyspark import TaskContext

        v: Vocabulary = shared.value
        k, end = v.n_classes, v.end
        slots, bigrams = 2 * k, np.zeros(k * k, np.int64)
        for batch in batches:
            for _, buf, offsets in chunks(batch.column("text"), _CHUNK):
                distinct, which, bounds = _tokens(buf, offsets)
                if not len(which):
                    continue
                i = _find(distinct, v.words)
                cls = np.where(i >= 0, v.cls[i], -1).astype(np.int64) if len(v.words) else np.full(len(distinct), -1)
                wanted = i < 0 if tail else (i >= 0) & ~v.fixed[i] if len(v.words) else np.zeros(len(distinct), bool)
                c = cls[which]
                before, after = np.concatenate([[end], c[:-1]]), np.concatenate([c[1:], [-1]])
                before[bounds[:-1]] = end
                after[bounds[1:] - 1] = -1
                both = (before >= 0) & (c >= 0)
                bigrams += np.bincount(before[both] * k + c[both], minlength=k * k)
                number = np.cumsum(wanted) - 1
                words, mine = distinct[wanted], wanted[which]
                x = number[which]
                a, b = mine & (before >= 0), mine & (after >= 0)
                key = np.concatenate([x[a] * slots + before[a], x[b] * slots + k + after[b]])
                rows, step = [], max(1, (1 << 22) // slots)
                bucket = (words >> np.uint64(64 - bits)).astype(np.int64)
                for lo in range(0, len(words), step):
                    part = key[(key >= lo * slots) & (key < (lo + step) * slots)] - lo * slots
                    n = np.bincount(part)
                    entry = np.flatnonzero(n)
                    of = bucket[lo + entry // slots]
                    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                    for p, q in zip(at, np.append(at[1:], len(of)), strict=True):
                        e = entry[p:q]
                        first = int(e[0] // slots)
                        rows.append(_packed(int(of[p]), words[lo + first : lo + int(e[-1] // slots) + 1], e - first * slots, n[e], slots))
                if rows:
                    yield from _context_batch(rows).to_batches()
        none = np.zeros(0, np.uint8)
        yield from _context_batch([(-1 - TaskContext.get().partitionId() % 256, none, none, none, bigrams)]).to_batches()

    return run


def _entries(words: list, sizes: list, slots: list, counts: list, n_slots: int):
    """(distinct words, entries, counts) of packed rows put together, in order of entry."""
    word = np.concatenate([np.frombuffer(x, np.uint64) for x in words])
    size = np.concatenate([np.frombuffer(x, np.uint16) for x in sizes]).astype(np.int64)
    distinct, which = np.unique(word, return_inverse=True)
    key = np.repeat(which, size) * n_slots + np.concatenate([np.frombuffer(x, np.uint8) for x in slots])
    entry, back = np.unique(key, return_inverse=True)
    return distinct, entry, np.bincount(back, np.concatenate([np.frombuffer(x, np.uint32) for x in counts])).astype(np.int64)


def _sum_contexts(n_slots: int):
    """A bucket's contexts summed up, in rows of some thousand words."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        cells = [t[n].to_pylist() for n in _CONTEXT_NAMES[1:]]
        if bucket < 0:
            none = np.zeros(0, np.uint8)
            return _context_batch([(bucket, none, none, none, np.sum([np.frombuffer(x, np.int64) for x in cells[3]], axis=0))])
        words, entry, count = _entries(*cells, n_slots)
        bounds = np.searchsorted(entry, np.arange(0, len(words) + _SLICE, _SLICE) * n_slots)
        return _context_batch([_packed(bucket, words[i * _SLICE : (i + 1) * _SLICE], entry[p:q] - i * _SLICE * n_slots, count[p:q], n_slots) for i, (p, q) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if q > p])

    return run


def best_classes(before: np.ndarray, after: np.ndarray, bigrams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For every word (a row of counts of the classes before and after it) the class that raises the
    likelihood of the class bigrams most, to first order; words without contexts are spread by hash."""
    k = len(bigrams)
    m = bigrams + 0.5
    into, out = np.log(m / m.sum(0)), np.log(m / m.sum(1, keepdims=True))
    gain = before @ into + after @ out.T
    bare = before.sum(1) + after.sum(1) == 0
    return np.where(bare, (words % np.uint64(k)).astype(np.int64), np.argmax(gain, axis=1))


def _assign(bigrams: np.ndarray, tail: bool):
    """``word, cls``, and with ``tail`` rows ``pair, c`` of the bigrams that the words add."""
    k = len(bigrams)

    def run(batches):
        more = np.zeros((k, k), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                words, entry, count = _entries(*([b.column(n)[i].as_py()] for n in _CONTEXT_NAMES[1:]), 2 * k)
                table = np.bincount(entry, count, minlength=len(words) * 2 * k).reshape(len(words), 2 * k)
                cls = best_classes(table[:, :k], table[:, k:], bigrams, words)
                one = np.zeros((len(words), k))
                one[np.arange(len(words)), cls] = 1
                more += (table[:, :k].T @ one + one.T @ table[:, k:]).astype(np.int64)
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(cls.astype(np.int16)), none, none], names=["word", "cls", "pair", "c"])
        if tail:
            at = np.flatnonzero(more)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.int16()), pa.array(at), pa.array(more.ravel()[at])], names=["word", "cls", "pair", "c"])

    return run


_ASSIGNED = "word long, cls short, pair long, c long"


def _matrix(rows: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy().astype(np.int64)] = rows["c"].to_numpy()
    return out.reshape(size, size)


class ClassModel:
    """The fitted tables; of fixed size, for the full vocabulary stays distributed."""

    def __init__(self, vocabulary: Vocabulary, follow: np.ndarray, class_n: np.ndarray, class_v: np.ndarray, n: int, v: int, lam: float):
        self.vocabulary, self.n, self.v, self.lam = vocabulary, n, v, lam
        follow = np.concatenate([follow, follow.sum(0, keepdims=True)]).astype(float)  # the last: after an unknown word
        self.follow = (follow + 0.5) / (follow.sum(1, keepdims=True) + 0.5 * follow.shape[1])
        self.class_total = class_n + 0.5 * (class_v + 1)
        self.base_total = n + 0.5 * (v + 1)
        self.unknown = lam * (self.follow @ (0.5 / self.class_total)) + (1 - lam) * 0.5 / self.base_total

    def known(self, before: np.ndarray, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probabilities of known words with count c and class cls after classes before."""
        return self.lam * self.follow[before, cls] * (c + 0.5) / self.class_total[cls] + (1 - self.lam) * (c + 0.5) / self.base_total


def train(docs: DataFrame, n_classes: int = N_CLASSES, lam: float = LAM, head: int = HEAD, core: int = CORE, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """(model, vocabulary ``word, c, cls``) from all the given documents' ``text``; up to 128 classes."""
    if not 1 <= n_classes <= 128:
        raise ValueError("n_classes must be 1 to 128")
    docs = docs.select("text")
    counts = cut(docs.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    band = F.floor(F.log2("c") * 16).cast("int")
    bands = sorted(((r["band"], r["words"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    kept, least = 0, 1 << 30
    for b, words in bands:  # at most 16 bands a power of two
        if kept + words > head:
            break
        kept, least = kept + words, b
    table = counts.where(band >= least).toArrow().sort_by("word")
    words, c = table["word"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(words, kind="stable")
    v = Vocabulary(words[order], c[order], n_classes, core)
    n, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    found = docs.mapInArrow(_bigrams(v.core), "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    v.cls[v.fixed] = exchange(_matrix(found, len(v.core)), n_classes)

    bits, slots, spark = bucket_bits(n // 2), 2 * n_classes, docs.sparkSession
    for step in range(rounds + 1):
        tail = step == rounds
        shared = spark.sparkContext.broadcast(v)  # at most ``head`` words
        contexts = store(docs.mapInArrow(_contexts(shared, bits, tail), _CONTEXTS).groupBy("bucket").applyInArrow(_sum_contexts(slots), _CONTEXTS))
        sums = contexts.where("bucket < 0").select("counts").toArrow()["counts"].to_pylist()  # at most 256 matrices
        bigrams = np.sum([np.frombuffer(x, np.int64) for x in sums], axis=0).reshape(n_classes, n_classes) if sums else np.zeros((n_classes, n_classes), np.int64)
        moved = contexts.where("bucket >= 0").mapInArrow(_assign(bigrams, tail), _ASSIGNED)
        if tail:
            moved = store(moved)
            follow = bigrams + _matrix(moved.where("word is null").groupBy("pair").agg(F.sum("c").alias("c")).toArrow(), n_classes)
            break
        moved = moved.select("word", "cls").toArrow()  # words of the head
        v.cls[_find(moved["word"].to_numpy().view(np.uint64), v.words)] = moved["cls"].to_numpy()

    # Words beyond the head that stand among such words only are spread by hash, as in ``best_classes``.
    ours = spark.createDataFrame(pa.table({"word": v.words.view(np.int64), "head": np.where(v.cls < 0, (v.words % np.uint64(n_classes)).astype(np.int16), v.cls)}))
    v.cls = np.where(v.cls < 0, (v.words % np.uint64(n_classes)).astype(np.int16), v.cls)
    low = F.pmod(F.conv(F.hex("word"), 16, 10).cast("decimal(20,0)"), F.lit(n_classes)).cast("short")
    full = counts.join(ours, "word", "left").join(moved.where("word is not null").select("word", "cls"), "word", "left")
    full = cut(full.select("word", "c", F.coalesce("head", "cls", low).alias("cls")))
    per_class = full.groupBy("cls").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).toArrow()
    class_n, class_v, at = np.zeros(n_classes), np.zeros(n_classes), per_class["cls"].to_numpy().astype(int)
    class_n[at], class_v[at] = per_class["n"].to_numpy(), per_class["v"].to_numpy()
    return ClassModel(v, follow, class_n, class_v, int(n), int(size), lam), full


_PART = "word long, prior long, row long, held_out boolean, doc_id long, n_tokens long, n_known long, base double, score double, c long, cls int, ctx int"
_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _score(shared):
    """A row for every document with what the head words give, and one for each token that is not
    in the head or follows such a token. ``c`` is null and ``ctx`` -1 where the table has to tell."""

    def run(batches):
        m: ClassModel = shared.value
        v = m.vocabulary
        end = v.end
        for batch in batches:
            ids, held, number = batch.column("doc_id"), batch.column("held_out"), batch.column("row").to_numpy()
            for rows, buf, offsets in chunks(batch.column("text")):
                distinct, which, bounds = _tokens(buf, offsets)
                i = _find(distinct, v.words)
                c = np.where(i >= 0, v.counts[i], 0) if len(v.words) else np.zeros(len(distinct), np.int64)
                k = np.where(i >= 0, v.cls[i], -1).astype(np.int64) if len(v.words) else np.full(len(distinct), -1)
                c, k, token = c[which], k[which], distinct[which]
                before, prior = np.concatenate([[end], k[:-1]]), np.concatenate([[END], token[:-1]])
                before[bounds[:-1]], prior[bounds[:-1]] = end, END
                sure = (k >= 0) & (before >= 0)
                known = k >= 0
                base = np.where(known, np.log10((c + 0.5) / m.base_total), 0)
                score = np.where(sure, np.log10(m.known(before, k, c)), 0)
                n = len(bounds) - 1
                add = lambda x: np.add.reduceat(x, bounds[:-1]) if n else x[:0]
                doc = np.arange(rows.start, rows.stop)
                key = pa.array(mix(number[doc].astype(np.uint64), 3).view(np.int64))  # spreads these rows
                none = lambda t, n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [key, key, pa.array(number[doc]), held.slice(rows.start, n), ids.slice(rows.start, n), pa.array(np.diff(bounds)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(score)), none(pa.int64(), n), none(pa.int32(), n), none(pa.int32(), n)],
                    names=_NAMES,
                )
                rest = np.flatnonzero(~sure)
                if len(rest):
                    r, owner = len(rest), np.searchsorted(bounds, rest, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token[rest].view(np.int64)), pa.array(prior[rest].view(np.int64)), pa.array(number[doc][owner]), none(pa.bool_(), r), *(none(pa.int64(), r) for _ in range(3)), none(pa.float64(), r), none(pa.float64(), r), pa.array(c[rest], mask=k[rest] < 0), pa.array(k[rest].astype(np.int32)), pa.array(before[rest].astype(np.int32))],
                        names=_NAMES,
                    )

    return run


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame) -> DataFrame:
    """Scores of ``docs`` (``doc_id, held_out, text``) under a trained model."""
    spark, size = docs.sparkSession, model.follow.shape[1]
    shared = spark.sparkContext.broadcast(model)  # arrays of at most ``head`` words
    parts = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(_score(shared), _PART)
    tail = F.col("ctx").isNotNull()
    parts = parts.join(vocabulary.select(F.col("word").alias("prior"), F.col("cls").alias("prior_cls")), "prior", "left")
    parts = parts.withColumn("ctx", F.when(F.col("ctx") >= 0, F.col("ctx")).otherwise(F.when(tail, F.coalesce(F.col("prior_cls").cast("int"), F.lit(size)))))
    parts = parts.join(vocabulary.select("word", F.col("c").alias("word_c"), F.col("cls").alias("word_cls")), "word", "left")
    here = F.col("c").isNotNull()  # the head has told
    parts = parts.withColumn("cls", F.when(here, F.col("cls")).otherwise(F.coalesce(F.col("word_cls").cast("int"), F.lit(-1)))).withColumn("seen", here).withColumn("c", F.coalesce("c", "word_c", F.lit(0)))
    # What follows a class: one row for each pair of classes, and -1 for unknown words.
    table = [(d, k, float(model.follow[d, k] / model.class_total[k])) for d in range(size + 1) for k in range(size)] + [(d, -1, float(model.unknown[d])) for d in range(size + 1)]
    parts = parts.join(F.broadcast(spark.createDataFrame(table, "ctx int, cls int, p double")), ["ctx", "cls"], "left")
    c, known = F.col("c") + 0.5, F.col("cls") >= 0
    prob = F.when(known, model.lam * F.col("p") * c + (1 - model.lam) * c / model.base_total).otherwise(F.col("p"))
    # The document's own row has counted the head words; where only the word before was beyond the head, the score alone is missing.
    out = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(tail, (known & ~F.col("seen")).cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(tail, F.when(F.col("seen"), 0.0).otherwise(F.log10(c / model.base_total))).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(tail, F.log10(prob)).otherwise(F.col("score"))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held: int = 1, **options) -> DataFrame:
    """Trains on the documents whose crc32(id as text) mod ``parts`` is not ``held`` and scores all."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False)))
    model, vocabulary = train(d.where(~F.col("held_out")), **options)
    out = score(d, model, vocabulary)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
