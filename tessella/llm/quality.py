"""Quality classification by co-training a text view and a metadata view.

The text view has the distinct words of a document without punctuation (hashed)
and shape figures in quantile bins; the metadata view has language, source, both
together and the size class. Both are logistic models, fitted on a bounded sample
of labelled documents. In each round, either view labels all other documents of
the table of which it is confident; the feature counts of what it took for good
and for bad, over the whole table, give the other view's evidence: the mean
log-odds of a document's features, in quantile bins, is one more feature there,
whose weight the labelled sample decides. Words that no labelled document has
count through it. At the end both views are calibrated on labelled documents set
aside, and a small logistic model combines them.

Plan. One scan of the texts writes each document's features (some 300 two-byte
indices); rounds and scores read these. A round is one pass without a shuffle but
for the sums, two counts for each of the fixed number of features.

Bound, as a parameter: ``n_labelled`` rows of features reach the driver, whatever
the size of the corpus. Nothing else is sampled.

Defined results: null text is empty, null metadata a value of its own; of
several labels of a doc_id the worst holds, of several rows of a labelled doc_id
the one with the smallest features is fitted; without labels of both kinds every
score is 0.5 and all documents are kept; rows are independent of each other;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import store
from .text import NOT_ALNUM, chunks, scan, word_hashes

BUCKETS, META, N_META = 1 << 16, 1 << 12, 4
N_LABELLED, ROUNDS, CONFIDENT = 12_000, 3, 0.97
_N_SHAPES, _N_BINS = 10, 8


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


_KIND = np.zeros(256, np.int8)
for _c in range(256):
    _KIND[_c] = 1 if 48 <= _c < 58 else 2 if 65 <= _c < 91 else 3 if _c in b"\t\n\x0b\x0c\r " else 4 if _c < 128 and not chr(_c).isalnum() else 5 if _c >= 128 else 0


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of distinct words and a matrix of shape figures."""
    w = scan(buf, offsets, lower=True, gaps=NOT_ALNUM)
    bucket = (word_hashes(w) % np.uint64(BUCKETS)).astype(np.int64)
    pairs = np.unique(w.owner() * BUCKETS + bucket)
    doc, bucket = pairs // BUCKETS, pairs % BUCKETS
    size = np.maximum(np.diff(offsets), 1)
    kind = _KIND[buf]
    n_words, distinct = np.maximum(w.counts, 1), np.bincount(doc, minlength=len(size))
    twice = np.concatenate([(kind[1:] == 4) & (kind[:-1] == 4), [False]]) if len(buf) else np.zeros(0, bool)
    shapes = np.stack(
        [_per_doc(kind == k, offsets) / size for k in (1, 2, 4, 5)]
        + [_per_doc(buf == ord("|"), offsets) / size, _per_doc(twice, offsets) / size, _per_doc(buf == 10, offsets) / size, size / n_words, distinct / n_words, np.log2(n_words)],
        axis=1,
    )
    return doc, bucket, shapes


_FEATURES = "doc_id long, meta binary, words binary, shapes binary"


def _extract(batches):
    """Feature rows."""
    for b in batches:
        for rows, buf, offsets in chunks(b.column("text")):
            doc, bucket, shapes = _features(buf, offsets)
            cells = np.split(bucket.astype(np.uint16), np.searchsorted(doc, np.arange(1, len(offsets) - 1)))
            part = lambda n: b.column(n).slice(rows.start, rows.stop - rows.start)  # noqa: E731, B023
            meta = np.array(part("meta").to_pylist(), np.int16).reshape(-1, N_META)
            yield pa.RecordBatch.from_arrays([part("doc_id"), *(pa.array([x.tobytes() for x in col], pa.binary()) for col in (meta, cells, shapes.astype(np.float32)))], names=["doc_id", "meta", "words", "shapes"])


def _read(b: pa.RecordBatch | pa.Table):
    """(text index, bucket, shapes, meta) of feature rows."""
    words = [np.frombuffer(x, np.uint16) for x in b.column("words").to_pylist()]
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    shapes = np.frombuffer(b"".join(b.column("shapes").to_pylist()), np.float32).reshape(-1, _N_SHAPES).astype(float)
    meta = np.frombuffer(b"".join(b.column("meta").to_pylist()), np.int16).reshape(-1, N_META).astype(np.int64)
    return doc, np.concatenate([np.zeros(0, np.int64), *words]).astype(np.int64), shapes, meta


class Logistic:
    """A logistic model over rows of distinct feature indices, fitted by Adam over all rows."""

    def __init__(self, size: int, l2: float = 3e-4, steps: int = 200):
        self.w, self.b, self.l2, self.steps = np.zeros(size), 0.0, l2, steps

    def logit(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.w[col], minlength=n) + self.b

    def fit(self, row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.w, self.b = np.zeros(len(self.w)), 0.0
        total = max(weight.sum(), 1e-9)
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, self.steps + 1):
            p = 1 / (1 + np.exp(-np.clip(self.logit(row, col, len(y)), -30, 30)))
            e = (p - y) * weight / total
            g = np.append(np.bincount(col, e[row], minlength=len(self.w)) + self.l2 * self.w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]
        return self


def platt(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, offset) by Newton steps; the slope is never negative."""
    a = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (a - [1, 0]))
    return np.array([max(a[0], 0.0), a[1]])


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log-odds of bad for every feature, from its documents (good, bad) and all of either kind."""
    if not docs.all():
        return np.zeros(len(counts))
    share = (counts + 1) / (docs + 2)
    return np.log(share[:, 1] / share[:, 0])


class Model:
    """Weights of both views, what the other view told each, their calibration and the combination."""

    def __init__(self, shape_edges: np.ndarray):
        self.shape_edges = shape_edges
        self.odds = [np.zeros(BUCKETS), np.zeros(META)]
        self.odds_edges = [np.zeros(_N_BINS - 1), np.zeros(_N_BINS - 1)]
        self.views = [Logistic(BUCKETS + (_N_SHAPES + 1) * _N_BINS), Logistic(META + _N_BINS, l2=1e-2)]
        self.cal = [np.array([1.0, 0.0])] * 2
        self.mix = np.array([1.0, 0.5, 0.0])

    def evidence(self, doc, bucket, n: int, meta) -> list[np.ndarray]:
        """The mean log-odds of every document's features, by view."""
        words = np.bincount(doc, self.odds[0][bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return [words, self.odds[1][meta].mean(axis=1)]

    def columns(self, doc, bucket, shapes, meta, seen=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document, feature index) pairs of both views; ``seen`` drops words that are not fitted."""
        n = len(shapes)
        told = [np.searchsorted(e, x, "right") for e, x in zip(self.odds_edges, self.evidence(doc, bucket, n, meta), strict=True)]
        bins = np.stack([*(np.searchsorted(e, x, "right") for e, x in zip(self.shape_edges, shapes.T, strict=True)), told[0]], axis=1)
        bins = bins + BUCKETS + _N_BINS * np.arange(_N_SHAPES + 1)
        if seen is not None:
            doc, bucket = doc[seen], bucket[seen]
        every = np.arange(n)
        text = np.concatenate([doc, np.repeat(every, _N_SHAPES + 1)]), np.concatenate([bucket, bins.ravel()])
        return [text, (np.concatenate([np.repeat(every, N_META), every]), np.concatenate([meta.ravel(), META + told[1]]))]

    def logits(self, doc, bucket, shapes, meta) -> list[np.ndarray]:
        """Calibrated log-odds of bad by either view."""
        return [c[0] * v.logit(r, k, len(shapes)) + c[1] for v, c, (r, k) in zip(self.views, self.cal, self.columns(doc, bucket, shapes, meta), strict=True)]

    def score(self, doc, bucket, shapes, meta):
        """(text view, metadata view, combined) log-odds of bad."""
        a, b = self.logits(doc, bucket, shapes, meta)
        return a, b, self.mix[0] * a + self.mix[1] * b + self.mix[2]


def _meta():
    """Hashed indices of the metadata view."""
    at = lambda *c: F.pmod(F.xxhash64(*c), F.lit(META)).cast("int")
    size = F.coalesce(F.floor(F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(1.0))) * 2), F.lit(-1)).cast("int")
    return F.array(at(F.lit(1), "lang"), at(F.lit(2), "source"), at(F.lit(3), "lang", "source"), at(F.lit(4), size)).alias("meta")


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, meta, words, shapes`` of every row, as a table."""
    return store(docs.select(F.col("doc_id").cast("long"), "text", _meta()).mapInArrow(_extract, _FEATURES))


def _told(shared):
    """``view, feature, bad, c``: documents with a feature that the other view is confident of; the
    feature -1 counts the documents."""

    def run(batches):
        model: Model = shared.value
        counts, docs = [np.zeros((BUCKETS, 2), np.int64), np.zeros((META, 2), np.int64)], np.zeros((2, 2), np.int64)
        for b in batches:
            doc, bucket, shapes, meta = _read(b)
            p = [_p(z) for z in model.logits(doc, bucket, shapes, meta)]
            pairs = [(doc, bucket), (np.repeat(np.arange(len(meta)), N_META), meta.ravel())]
            for view, (row, col) in enumerate(pairs):
                other = p[1 - view]
                for bad, sure in ((0, other < 1 - CONFIDENT), (1, other > CONFIDENT)):
                    counts[view][:, bad] += np.bincount(col[sure[row]], minlength=len(counts[view]))
                    docs[view, bad] += sure.sum()
        for view in range(2):
            at, bad = np.nonzero(counts[view])
            feature, bad = np.append(at, [-1, -1]), np.append(bad, [0, 1])
            c = np.append(counts[view][at, bad[:-2]], docs[view])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), view, np.int32)), pa.array(feature.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(c)], names=["view", "feature", "bad", "c"])

    return run


def told(pool: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either view: counts (feature x good, bad) and documents (good, bad) of the other view's
    confident labels over all of ``pool``."""
    shared = pool.sparkSession.sparkContext.broadcast(model)  # of fixed size
    t = pool.mapInArrow(_told(shared), "view int, feature int, bad int, c long").groupBy("view", "feature", "bad").agg(F.sum("c").alias("c")).toArrow()
    view, feature, bad, c = (t[n].to_numpy() for n in ("view", "feature", "bad", "c"))
    out = []
    for v, size in enumerate((BUCKETS, META)):
        counts, docs = np.zeros((size, 2)), np.zeros(2)
        mine = (view == v) & (feature >= 0)
        counts[feature[mine], bad[mine]] = c[mine]
        mine = (view == v) & (feature < 0)
        docs[bad[mine]] = c[mine]
        out.append((counts, docs))
    return out


def fit(rows: DataFrame, labels: DataFrame, n_labelled: int = N_LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The co-trained model from feature rows and ``doc_id, quality, toxic`` labels."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    few = store(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_labelled))
    sample = rows.join(F.broadcast(few), "doc_id")  # of n_labelled rows at most
    sample = sample.groupBy("doc_id").agg(F.max("bad").alias("bad"), F.min(F.struct("words", "shapes", "meta")).alias("f")).select("doc_id", "bad", "f.*")
    t = sample.toArrow().sort_by("doc_id")
    y = t["bad"].to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return None
    doc, bucket, shapes, meta = _read(t)
    model = Model(np.quantile(shapes, np.linspace(0, 1, _N_BINS + 1)[1:-1], axis=0).T)
    # Words that few labelled documents have would only repeat single labels.
    seen = np.bincount(bucket, minlength=BUCKETS)[bucket] >= max(5, 0.002 * len(y))
    aside = np.zeros(len(y), bool)
    for kind in (0, 1):  # a quarter of either kind
        aside[np.random.default_rng(kind).permutation(np.flatnonzero(y == kind))[::4]] = True
    goal, weight = y.astype(float), (~aside).astype(float)
    pool = rows.join(F.broadcast(few), "doc_id", "left_anti")
    for step in range(rounds + 1):
        for i, (view, (row, col)) in enumerate(zip(model.views, model.columns(doc, bucket, shapes, meta, seen), strict=True)):
            z = view.fit(row, col, goal, weight).logit(row, col, len(y))
            model.cal[i] = platt(z[aside], goal[aside])
        if step < rounds:
            model.odds = [log_odds(*x) for x in told(pool, model)]
            model.odds_edges = [np.quantile(e, np.linspace(0, 1, _N_BINS + 1)[1:-1]) for e in model.evidence(doc, bucket, len(y), meta)]
    x = np.stack([*model.logits(doc, bucket, shapes, meta), np.ones(len(y))], axis=1)[aside]
    mix, prior = model.mix, model.mix
    for _ in range(30):
        p = _p(x @ mix)
        mix = mix - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - goal[aside]) + 0.1 * (mix - prior))
    model.mix = mix
    return model


def _probabilities(model: Model | None, n: int, threshold: float, *features) -> list[pa.Array]:
    """Probabilities of being good by text, metadata and both, and what to keep."""
    z = model.score(*features) if model else [np.zeros(n)] * 3
    p = [_p(-x) for x in z]
    return [*map(pa.array, p), pa.array(p[2] >= threshold if model else np.ones(n, bool))]


_SCORES = "text_score double, meta_score double, score double, keep boolean"
_SCORE_NAMES = [x.split()[0] for x in _SCORES.split(", ")]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep``: probabilities of being good, of either view
    and combined, for every document."""
    rows = features(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, **options))  # of fixed size

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_probabilities(shared.value, b.num_rows, threshold, *_read(b))], names=["doc_id", *_SCORE_NAMES])

    return rows.mapInArrow(run, f"doc_id long, {_SCORES}")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The columns ``doc_id, text, lang, source, n_chars`` of the documents that are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(features(docs), labels, **options))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches):
        for b in batches:
            meta = np.array(b.column("meta").to_pylist(), np.int64).reshape(b.num_rows, N_META)
            for rows, buf, offsets in chunks(b.column("text")):
                doc, bucket, shapes = _features(buf, offsets)
                keep = _probabilities(shared.value, len(shapes), threshold, doc, bucket, shapes.astype(np.float32).astype(float), meta[rows])[3]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(rows.start, len(shapes)).filter(keep) for c in columns], names=columns)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*columns, _meta()).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))
