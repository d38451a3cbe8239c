"""Substring dedup by compacting a De Bruijn graph of token k-mers.

Every window of ``k`` consecutive words is an edge between its (k-1)-word
prefix and suffix. An edge's *source* is its first occurrence in the document
with the smallest id. Where the edges of a document follow each other and
their sources do too, the path does not branch against the source document and
is compacted to one span; a branch is where the source jumps. A home sends each
distinct path ``(source row, start, edges)`` of its spans once to the home of
the source, which reads the words at these coordinates again and confirms the
paths whose digest agrees.

Identity. Edges are resolved by two independent hashes, 80 bits together, and a
confirmed span agrees in a digest of 64 bits more, which is made word by word
from other word hashes than the edges' first. Removing a word whose window has
no earlier occurrence takes a collision in all of them.

Plan. Documents are dealt to homes (groups of about 3 MB of text) once; that
exchange serves every later step. (1) A filter of 32 bits an edge finds the
edges that another home has too. (2) Only those, and edges repeated inside
their home, are resolved to their sources. (3) Paths are joined with their
sources and confirmed, packed by pairs of homes. All steps send an edge or a
path once for a home, so a passage or document found in a third of all rows
costs an entry per home, and no group of copies meets in one task.

Bytes. Step 1 moves 4 bytes for each distinct edge of a home; 30 GB are some
10,000 homes and 4,000 buckets, so a cell has about 100 of them. Buckets stop at
2**24: beyond some 10 TB cells get thin and rows' overhead outweighs the 4 bytes.

Defined results: null or empty text and texts under k words lose nothing; a
repetition inside one document (or under one repeated doc_id) is kept; a null
doc_id counts as the largest id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import bucket_bits, cuts, homes, low32, narrow, pack, repeated_bits, wide
from .text import chunks, measure, prefix, scan, span_digests, span_hash, word_hashes

_LAST = np.iinfo(np.int64).max
_HOME_BYTES = 3 << 20


def _by_id(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row order by doc_id and row key, doc_ids in that order): the same in every step."""
    ids = t["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((t["key"].to_numpy(), ids))
    return order, ids[order]


class _Home:
    """The words of a home's documents, in order of doc_id, and their edges."""

    def __init__(self, t: pa.Table, k: int):
        order, self.ids = _by_id(t)
        self.k, self.scans = k, [scan(buf, offsets) for _, buf, offsets in chunks(t["text"].take(pa.array(order)))]
        self.counts = np.concatenate([np.zeros(0, np.int64), *(w.counts for w in self.scans)])
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        n = np.maximum(self.counts - (k - 1), 0)
        self.doc = np.repeat(np.arange(len(n)), n)  # of each edge
        self.first = np.arange(n.sum()) + np.repeat(self.bounds[:-1] - (np.cumsum(n) - n), n)
        self.pos = self.first - self.bounds[self.doc]
        self.keys = span_hash(prefix(self._hashes(0)), self.first, self.first + k)

    def _hashes(self, lane: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(word_hashes(w, lane) for w in self.scans)])

    @cached_property
    def second(self) -> np.ndarray:
        """The words' independent hashes."""
        return self._hashes(1)

    def checks(self, edges: np.ndarray) -> np.ndarray:
        """Second hashes of the given edges."""
        return span_hash(prefix(self.second), self.first[edges], self.first[edges] + self.k, seed=7)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct edges; their first occurrence; the number of each edge among them."""
        order = np.argsort(self.keys, kind="stable")
        s = self.keys[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        return s[new], order[new], number


def _flags(cells: pa.Table, distinct: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits, put back in the order of the home's sorted distinct edges."""
    got = dict(zip(cells["bucket"].to_pylist(), cells["bits"].to_pylist(), strict=True))
    hit = np.zeros(len(distinct), bool)
    buckets, at = cuts(distinct, bits)
    for i, b in enumerate(buckets):
        if cell := got.get(int(b)):
            hit[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(cell, np.uint8), count=at[i + 1] - at[i]).astype(bool)
    return hit


def _send_filter(k: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        h = _Home(t, k)
        keys = h.distinct()[0]
        buckets, at = cuts(keys, bits)
        low = low32(keys, bits)
        cells = [pack(np.sort(low[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        home = t["home"][0].as_py()
        return pa.table({"home": pa.array([home] * len(cells), pa.int64()), "bucket": pa.array(buckets, pa.int64()), "keys": pa.array(cells, pa.binary())})

    return run


#: Columns of binary cells and what they hold; None: narrow integers.
_EDGES = (("keys", np.uint64), ("checks", np.uint16), ("docs", None), ("rows", None), ("pos", None))
_SENT = "home long, bucket long, " + ", ".join(f"{n} binary" for n, _ in _EDGES)


def _table(rows: list[tuple], longs: tuple[str, ...], cells) -> pa.Table:
    """Rows of ``longs`` and arrays, which become binary cells; a null cell for None."""
    n = len(longs)
    cell = lambda x, kind: None if x is None else narrow(x) if kind is None else pack(x.astype(kind))
    return pa.table(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(n)] + [pa.array([cell(r[n + i], kind) for r in rows], pa.binary()) for i, (_, kind) in enumerate(cells)],
        names=[*longs, *(c for c, _ in cells)],
    )


def _send_edges(k: int, bits: int):
    """Edges that another home may have, each once with its first document here and position."""

    def run(t: pa.Table, cells: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if t.num_rows:
            h = _Home(t, k)
            keys, at, _ = h.distinct()
            hit = _flags(cells, keys, bits)
            keys, at = keys[hit], at[hit]
            buckets, cut = cuts(keys, bits)
            doc, home = h.doc[at], t["home"][0].as_py()
            parts = (keys, h.checks(at) >> np.uint64(48), h.ids[doc], doc, h.pos[at])
            rows = [(home, int(b), *(x[i:j] for x in parts)) for b, i, j in zip(buckets, cut[:-1], cut[1:], strict=True)]
        return _table(rows, ("home", "bucket"), _EDGES)

    return run


_FOUND = (("keys", np.uint64), ("docs", None), ("homes", None), ("rows", None), ("pos", None))
_SOURCES = "home long, " + ", ".join(f"{n} binary" for n, _ in _FOUND)


def _joined(t: pa.Table, columns) -> list[np.ndarray]:
    read = lambda x, kind: wide(x) if kind is None else np.frombuffer(x, kind)
    return [np.concatenate([np.zeros(0, kind or np.int64), *(read(x, kind) for x in t[n].to_pylist())]) for n, kind in columns]


def _resolve(t: pa.Table) -> pa.Table:
    """For every home: the edges of this bucket whose source lies in another home's document."""
    keys, checks, docs, rows, pos = _joined(t, _EDGES)
    ends = np.cumsum([len(x) // 8 for x in t["keys"].to_pylist()])
    home = np.repeat(t["home"].to_numpy(), np.diff(ends, prepend=0))
    order = np.lexsort((pos, rows, home, docs, checks, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])])
    best = np.empty(len(keys), np.int64)
    best[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    other = docs[best] != docs
    out = []
    for name, i, j in zip(t["home"].to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
        at = np.flatnonzero(other[i:j]) + i
        if len(at):
            src = best[at]
            out.append((name, keys[at], docs[src], home[src], rows[src], pos[src]))
    return _table(out, ("home",), _FOUND)


#: What goes between homes after compaction: paths to be confirmed at their sources, a home's own
#: spans with the number of their path (to itself), and confirmations.
_MAIL = "dest long, kind int, other long, a binary, b binary, c binary, d binary"
_PATHS, _SPANS, _CONFIRMED = range(3)
_NUMBERS = tuple((c, None) for c in "abcd")


def _mail(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("dest", "kind", "other"), _NUMBERS).cast(_MAIL_TYPE)


_MAIL_TYPE = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("other", pa.int64()), *((c, pa.binary()) for c in "abcd")])


def _compact(k: int):
    """Compacts edges whose sources follow each other to spans; their distinct paths go to the homes
    of the sources."""

    def run(t: pa.Table, cells: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _mail([])
        h, home = _Home(t, k), t["home"][0].as_py()
        keys, at, number = h.distinct()
        src_doc, src_home, src_row, src_pos = h.ids[h.doc[at]].copy(), np.full(len(at), home), h.doc[at].copy(), h.pos[at].copy()
        if cells.num_rows:
            found, docs, homes_, rows, pos = _joined(cells, _FOUND)
            i = np.searchsorted(keys, found)
            src_doc[i], src_home[i], src_row[i], src_pos[i] = docs, homes_, rows, pos
        later = np.flatnonzero(src_doc[number] < h.ids[h.doc])
        e = number[later]
        d, p, sh, sr, sp = h.doc[later], h.pos[later], src_home[e], src_row[e], src_pos[e]
        cont = (d[1:] == d[:-1]) & (p[1:] == p[:-1] + 1) & (sh[1:] == sh[:-1]) & (sr[1:] == sr[:-1]) & (sp[1:] == sp[:-1] + 1)
        head = np.flatnonzero(np.concatenate([[True], ~cont])) if len(d) else np.zeros(0, np.int64)
        if not len(head):
            return _mail([])
        n = np.diff(np.append(head, len(d)))
        digest = span_digests(h.second, h.first[later[head]], n + k - 1)
        sh, sr, sp, d, p = sh[head], sr[head], sp[head], d[head], p[head]
        order = np.lexsort((digest, n, sp, sr, sh))
        same = lambda x: x[order][1:] == x[order][:-1]
        new = np.concatenate([[True], ~(same(sh) & same(sr) & same(sp) & same(n) & same(digest))])
        path = np.empty(len(order), np.int64)
        path[order] = np.cumsum(new) - 1
        one = order[new]  # a span of each path, by source home
        cut = np.concatenate([[0], np.flatnonzero(np.diff(sh[one])) + 1, [len(one)]])
        out, by_path = [], np.argsort(path, kind="stable")
        bound = np.searchsorted(path[by_path], cut)
        for i, j, x, y in zip(cut[:-1], cut[1:], bound[:-1], bound[1:], strict=True):
            to, s = int(sh[one[i]]), by_path[x:y]
            out.append((to, _PATHS, home, sr[one[i:j]], sp[one[i:j]], n[one[i:j]], digest[one[i:j]].view(np.int64)))
            out.append((home, _SPANS, to, d[s], p[s], n[s], path[s] - i))
        return _mail(out)

    return run


def _confirm(k: int):
    """Reads every path that other homes name once more from the text at its coordinates."""

    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        if not t.num_rows or not mail.num_rows:
            return _mail([])
        kind, home = mail["kind"].to_numpy(), t["home"][0].as_py()
        own, asked = mail.filter(pa.array(kind == _SPANS)), mail.filter(pa.array(kind == _PATHS))
        if not asked.num_rows:
            return own
        h = _Home(t, k)
        row, start, n, digest = _joined(asked, _NUMBERS)
        path, which = np.unique(np.stack([row, start, n]), axis=1, return_inverse=True)
        got = span_digests(h.second, h.bounds[path[0]] + path[1], path[2] + k - 1)
        ok = (got[which.ravel()] == digest.view(np.uint64)).astype(np.int64)
        ends = np.cumsum([len(wide(x)) for x in asked["a"].to_pylist()])
        out = [(to, _CONFIRMED, home, ok[i:j], None, None, None) for to, i, j in zip(asked["other"].to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        return pa.concat_tables([own.cast(_MAIL_TYPE), _mail(out)])

    return run


def _confirmed(mail: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, edges) of a home's confirmed spans."""
    kinds, others = mail["kind"].to_pylist(), mail["other"].to_pylist()
    ok = {o: wide(x) > 0 for kind, o, x in zip(kinds, others, mail["a"].to_pylist(), strict=True) if kind == _CONFIRMED}
    found = [(np.zeros(0, np.int64),) * 3]
    for kind, o, *cells in zip(kinds, others, *(mail[c].to_pylist() for c in "abcd"), strict=True):
        if kind == _SPANS and o in ok:
            row, start, edges, path = map(wide, cells)
            found.append(tuple(x[ok[o][path]] for x in (row, start, edges)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept string"


def _cut(k: int, digest: bool, more: tuple[str, ...]):
    """Removes the confirmed spans from the texts; ``kept`` is the rest or its SHA-256."""

    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        ids, order = t["doc_id"].combine_chunks(), _by_id(t)[0]
        texts = t["text"].take(pa.array(order))
        row, start, edges = _confirmed(mail)
        n_spans = np.bincount(row, minlength=len(order))
        words, removed, kept = [], [], []
        for rows, buf, offsets in chunks(texts):
            w = scan(buf, offsets)
            mine = (row >= rows.start) & (row < rows.stop)
            a = w.bounds[row[mine] - rows.start] + start[mine]
            depth = np.bincount(a, minlength=len(w.starts) + 1) - np.bincount(a + edges[mine] + k - 1, minlength=len(w.starts) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            words.append(w.counts)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
            data = buf.tobytes()
            for i in range(len(offsets) - 1):
                s = slice(w.bounds[i], w.bounds[i + 1])
                if not removed[-1][i]:
                    text = data[offsets[i] : offsets[i + 1]]
                else:  # runs of kept words, as they stand
                    stay = np.concatenate([[False], ~gone[s], [False]])
                    first, last = np.flatnonzero(stay[1:-1] & ~stay[:-2]), np.flatnonzero(stay[1:-1] & ~stay[2:])
                    text = b" ".join([data[x:y] for x, y in zip(w.starts[s][first].tolist(), w.ends[s][last].tolist(), strict=True)])
                kept.append(hashlib.sha256(b" ".join(text.split())).hexdigest() if digest else text.decode())
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        out = {"doc_id": ids.take(pa.array(order)), "n_words": cat(words), "n_removed": cat(removed), "n_spans": n_spans.astype(np.int64), "kept": pa.array(kept, pa.string())}
        return pa.table(out | {c: t[c].take(pa.array(order)) for c in more})

    return run


def repeated_spans(docs: DataFrame, k: int = 13, n_homes: int | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(homes, mail): spans are maximal runs of words of a document that follow, window by window,
    one run of a document with a smaller id; the mail to a home has its spans and which of their
    paths are confirmed."""
    n = n_homes or measure(docs, per_group=_HOME_BYTES)
    bits = bucket_bits(n * _HOME_BYTES // 6)
    base = homes(docs, n, more=more)
    by_home = base.groupBy("home")
    flags = repeated_bits(by_home.applyInArrow(_send_filter(k, bits), "home long, bucket long, keys binary"))
    sent = by_home.cogroup(flags.groupBy("home")).applyInArrow(_send_edges(k, bits), _SENT)
    sources = sent.groupBy("bucket").applyInArrow(_resolve, _SOURCES)
    mail = by_home.cogroup(sources.groupBy("home")).applyInArrow(_compact(k), _MAIL)
    return base, by_home.cogroup(mail.groupBy("dest")).applyInArrow(_confirm(k), _MAIL)


def remove_repeats(docs: DataFrame, k: int = 13, digest: bool = False, n_homes: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept`` and ``more`` columns as they are: the text less
    every word that a window of k words covers whose sequence also starts in a document with a
    smaller id. Runs of words that stay keep their white space and are joined by a space; with
    ``digest``, ``kept`` is the SHA-256 of the words that stay, joined by single spaces."""
    base, mail = repeated_spans(docs, k, n_homes, more)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([_RESULT, *(f"{c} {kinds[c]}" for c in more)])
    return base.groupBy("home").cogroup(mail.groupBy("dest")).applyInArrow(_cut(k, digest, more), schema)
