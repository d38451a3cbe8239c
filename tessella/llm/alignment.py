"""Alignment of two tokenizers' tokens over the bytes of every text.

Token ends that both tokenizers share cut a text into groups. What a byte range
holds is a *fragment*: the tokens up to its first shared end (open prefix), the
groups between shared ends (closed), and the tokens after its last one (open
suffix); a range without a shared end is open as a whole. Fragments of
neighbouring ranges compose associatively: the suffix of one and the prefix of
the next become a group. A text above ``chunk_bytes`` is cut at byte ranges,
wherever these fall, into rows that Spark deals to tasks; each keeps the tokens
that end in its range, and a tree of grouped reductions composes the fragments,
``FAN`` at a time, so its depth grows with the logarithm of the text.

Tokenizing a range needs no more text than to the next places where both
tokenizers must part, the spaces after other characters than white space. A
stretch of over a quarter of ``chunk_bytes`` without such a place is not cut.

Links are pairs of an A and a B token whose bytes overlap. Groups of documents
(some MB of text, stored once) send every distinct pair of ids with the number
of their documents that hold it; these are summed, the best count of each A id
is found, and the sums go back to the homes that asked. A pair, however
frequent, is one row for a home.

Defined results: null and empty texts, and texts whose joined token bytes are not
a space and the text (for B such with U+2581), have no tokens: zeros and an empty
``groups``. Rows are independent; each of repeated rows counts as a document.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import narrow, wide
from .piece_bpe import Coder, Model, _ranges
from .stage import cut, store
from .text import chunks

#: Fragments that one task composes.
FAN = 16
_CHUNK_BYTES = 1 << 16
_HOME_BYTES = 1 << 20
#: Stretches that are encoded at once.
_TOGETHER = 2048
#: Stretches and ids that a task keeps before it starts afresh.
_KEEP, _KEEP_IDS = 150_000, 2_000_000

#: Bytes after which a space parts the tokens of A: not ASCII white space or controls, nor what a white-space character beyond ASCII can end with.
_PARTS = np.ones(256, bool)
_PARTS[:0x21] = _PARTS[0x7F] = False
_PARTS[[*range(0x80, 0x8F), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def _byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for
    themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library; encodes each distinct stretch once and keeps it."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.encode_special_tokens = True
        of_char = _byte_of_char()
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        texts = [bytes(of_char[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._forget()

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts, each of which starts with a space or is empty."""
        starts = np.flatnonzero(parts(buf, offsets))
        bounds = np.append(starts, len(buf))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        row = self._known(coded.dictionary)[np.asarray(coded.indices).astype(np.int64)]
        n = self.sizes[row]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[_ranges(self.first[row], n)].astype(np.int64), total[np.searchsorted(starts, offsets)]

    def _known(self, texts: pa.Array) -> np.ndarray:
        """Where the ids of the distinct stretches are kept; encodes those that are new."""
        if len(self.seen) > _KEEP or len(self.flat) > _KEEP_IDS:
            self._forget()
        cells, base = texts.to_pylist(), len(self.seen)
        row = np.array([self.seen.setdefault(c, -1) for c in cells], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            flat, size = self._stretches(texts.take(pa.array(new)))
            row[new] = base + np.arange(len(new))
            self.seen.update((cells[i], r) for i, r in zip(new.tolist(), row[new].tolist(), strict=True))
            self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
            self.sizes, self.flat = np.append(self.sizes, size), np.append(self.flat, flat.astype(np.int32))
        return row

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.first, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of distinct stretches. Those that end as a stretch
        inside a text does are encoded many at once, since they part from what follows them."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        raw, off = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        apart = _PARTS[raw[off[1:] - 1]] if len(texts) else np.zeros(0, bool)
        order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
        n = int(apart.sum())
        bounds = [*range(0, n, _TOGETHER), *range(n, len(order) + 1)]
        cells = texts.take(pa.array(order)).to_pylist()
        lists = self.tokenizer.encode_batch_fast([b"".join(cells[i:j]).decode() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(x.ids, np.int64) for x in lists)])
        ends, total = np.cumsum(size[order]), np.cumsum(self.lengths[ids])
        bound = np.concatenate([[0], np.searchsorted(total, ends) + 1])
        first, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], many[order] = bound[:-1], np.diff(bound)
        return ids[_ranges(first, many)], many


def parts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a stretch starts: at texts, and at spaces where both tokenizers must part."""
    out = buf == 0x20
    out[1:] &= _PARTS[buf[:-1]]
    out[offsets[:-1][np.diff(offsets) > 0]] = True
    return out


@dataclass
class Tokens:
    """Tokens of both tokenizers in order, by id and by the byte at which each ends."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def between(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, m = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("a", "a_ends", "b", "b_ends")))

    def cell(self) -> bytes:
        return np.concatenate([[len(self.a), len(self.b)], self.a, self.a_ends, self.b, self.b_ends]).astype(np.int64).tobytes()

    @staticmethod
    def of(cell: bytes) -> Tokens:
        x = np.frombuffer(cell, np.int64)
        n, m = int(x[0]), int(x[1])
        return Tokens(*np.split(x[2:], [n, 2 * n, 2 * n + m]))


_NONE = Tokens(*(np.zeros(0, np.int64),) * 4)


class Tokenizers:
    """Both tokenizers in one task."""

    def __init__(self, config: str, model: Model):
        self.a, self.b = ByteLevel(config), Coder(model)

    def tokens(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens of the texts that their bytes give back, texts that they do not, offsets), all in
        bytes of the texts with a space before each that is not empty."""
        full = np.diff(offsets) > 0
        spaced = np.insert(buf, offsets[:-1][full], 0x20)
        off = offsets + np.concatenate([[0], np.cumsum(full)])
        (a, a_bounds), (b, b_bounds) = self.a.encode(spaced, off), self.b.encode(buf, offsets, end=False)
        bad = np.zeros(len(full), bool)
        out = []
        for ids, bounds, t in ((a, a_bounds, self.a), (b.astype(np.int64), b_bounds, self.b)):
            n = t.lengths[ids]
            total = np.concatenate([[0], np.cumsum(n)])
            doc_total = total[bounds]
            bad |= np.diff(doc_total) != np.diff(off)
            ends = total[1:] - np.repeat(doc_total[:-1] - off[:-1], np.diff(bounds))
            out.append((ids, ends, np.repeat(np.arange(len(full)), np.diff(bounds)), n, t))
        for ids, ends, doc, n, t in out:
            ok = ~bad[doc]
            place = _ranges((ends - n)[ok], n[ok])
            unequal = t.bytes[_ranges(t.starts[ids[ok]], n[ok])] != spaced[place]
            if unequal.any():
                bad[np.searchsorted(off, place[unequal], "right") - 1] = True
        (a, a_ends, a_doc, *_), (b, b_ends, b_doc, *_) = out
        x, y = ~bad[a_doc], ~bad[b_doc]
        return Tokens(a[x], a_ends[x], b[y], b_ends[y]), bad, off


class Merged:
    """The ends of both tokenizers' tokens in one order, A before B where they share one."""

    def __init__(self, t: Tokens):
        self.t, both = t, np.concatenate([t.a_ends, t.b_ends])
        order = np.argsort(both, kind="stable")
        s, of_a = both[order], order < len(t.a)
        again = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
        self.shared = s[again]
        # Of every place: shared ends before it; a token belongs to the group that its end closes or is in.
        group = np.cumsum(again) - again
        self.ga, self.gb = group[of_a], group[~of_a]
        new = np.flatnonzero(~again)
        self.ends, before = s[new], np.cumsum(of_a) - of_a
        self.i, self.j = before[new], new - before[new]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where A's and B's tokens stand when groups are written, A before B in each."""
        n = len(self.shared)
        a, b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (self.ga, self.gb))
        return np.arange(len(self.ga)) + b[self.ga], np.arange(len(self.gb)) + a[self.gb + 1]


class Aligner:
    """What is done with the tokens of both tokenizers, by their numbers of ids."""

    def __init__(self, n_a: int, n_b: int):
        self.size = n_b
        name = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.names = {"a,": name(n_a, ","), "a|": name(n_a, "|"), "b,": name(n_b, ","), "b;": name(n_b, ";")}

    def groups(self, t: Tokens, m: Merged) -> tuple[np.ndarray, np.ndarray]:
        """(the tokens written with what follows them, the byte where the group of each ends)."""
        out, end = np.empty(len(t.a) + len(t.b), dtype=object), np.empty(len(t.a) + len(t.b), np.int64)
        at_a, at_b = m.places()
        for ids, g, at, same, other in ((t.a, m.ga, at_a, "a,", "a|"), (t.b, m.gb, at_b, "b,", "b;")):
            last = np.append(g[1:] != g[:-1], True)[: len(g)]
            out[at] = np.where(last, self.names[other][ids], self.names[same][ids])
            end[at] = m.shared[g]
        return out, end

    def links(self, t: Tokens, m: Merged) -> np.ndarray:
        """The id pair of every two tokens that overlap, in the order of ``m.ends``: between two ends that
        follow each other there is one token of each."""
        return t.a[m.i] * self.size + t.b[m.j]

    def fragment(self, t: Tokens) -> Fragment:
        """Of consecutive tokens, from the byte after which they begin."""
        shared = Merged(t).shared
        if not len(shared):
            return Fragment(t, None)
        last = max(t.a_ends[-1], t.b_ends[-1])
        return Fragment(t.between(-1, shared[0]), self.closed(t.between(shared[0], shared[-1])), t.between(shared[-1], last))

    def closed(self, t: Tokens) -> Closed:
        m = Merged(t)
        keys, times = np.unique(self.links(t, m), return_counts=True)
        return Closed("".join(self.groups(t, m)[0]), len(t.a), len(t.b), len(m.shared), keys, times)


@dataclass
class Closed:
    """Whole groups: their text, counts and linked id pairs."""

    text: str
    n_a: int
    n_b: int
    n_groups: int
    keys: np.ndarray
    times: np.ndarray

    def __add__(self, other: Closed) -> Closed:
        keys, which = np.unique(np.concatenate([self.keys, other.keys]), return_inverse=True)
        times = np.bincount(which, np.concatenate([self.times, other.times]), len(keys)).astype(np.int64)
        return Closed(self.text + other.text, self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, keys, times)


@dataclass
class Fragment:
    """What a byte range holds; without ``closed`` it has no shared end and is all ``prefix``. The
    empty fragment is the unit, and ``compose`` is associative."""

    prefix: Tokens
    closed: Closed | None
    suffix: Tokens | None = None

    def compose(self, other: Fragment, aligner: Aligner) -> Fragment:
        if self.closed is None:
            return Fragment(self.prefix + other.prefix, other.closed, other.suffix)
        if other.closed is None:
            return Fragment(self.prefix, self.closed, self.suffix + other.prefix)
        middle = self.suffix + other.prefix
        inner = self.closed + aligner.closed(middle) if len(middle.a) else self.closed
        return Fragment(self.prefix, inner + other.closed, other.suffix)

    def whole(self, aligner: Aligner) -> Closed:
        """The groups of a complete text: its prefix begins at its first byte and it ends at a shared end."""
        if self.closed is None or len(self.suffix.a) or len(self.suffix.b):
            raise ValueError("the fragments do not make up a text")
        return aligner.closed(self.prefix) + self.closed


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs long"
_HOMES = f"home long, docs array<struct<{_DOCS.replace(' long', ': long').replace(' string', ': string')}>>, keys binary, times binary"
_DOC_TYPE = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _DOCS.split(", ")])


def _home(name: int, docs: list[dict], keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([name], pa.int64()), pa.array([docs], pa.list_(_DOC_TYPE)), pa.array([narrow(keys)], pa.binary()), pa.array([narrow(times)], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["home", "docs", "keys", "times"])


def _written(text: str, digest: bool) -> str:
    text = text.removesuffix(";")
    return hashlib.sha256(text.encode()).hexdigest() if digest and text else text


def _align(config: str, model: Model, digest: bool):
    """Homes of whole texts."""

    def run(batches):
        from pyspark import TaskContext

        both, name = Tokenizers(config, model), TaskContext.get().partitionId() << 32
        work = Aligner(len(both.a.lengths), model.size)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for rows, buf, offsets in chunks(batch.column("text"), _HOME_BYTES):
                t, bad, off = both.tokens(buf, offsets)
                m = Merged(t)
                written, at = work.groups(t, m)
                doc = np.searchsorted(off, m.ends - 1, "right") - 1
                each, times = np.unique((doc << 40) | work.links(t, m), return_counts=True)
                size = lambda x: np.diff(np.searchsorted(x, off, "right"))  # noqa: B023, E731
                bound = np.searchsorted(at, off, "right")
                counts = zip(ids[rows], size(t.a_ends), size(t.b_ends), size(m.shared), size(m.ends), np.bincount(each >> 40, minlength=len(bad)), bound[:-1], bound[1:], strict=True)
                docs = [
                    {"doc_id": i, "n_a": int(a), "n_b": int(b), "n_groups": int(g), "n_links": int(k), "groups": _written("".join(written[x:y]), digest), "n_pairs": int(p)}
                    for i, a, b, g, k, p, x, y in counts
                ]
                yield _home(name, docs, each & ((1 << 40) - 1), times)
                name += 1

    return run


_PIECES = "row long, doc_id long, chunk long, low long, high long, base long, piece binary"


def _pieces(size: int):
    """Byte ranges (low, high] of long texts, each with the text that tokenizing it takes."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = b" " + text.as_buffer().to_pybytes()
                buf = np.frombuffer(raw, np.uint8)
                start = np.append(np.flatnonzero(parts(buf, np.array([0, len(buf)]))), len(buf))
                at = np.arange(size, len(buf), size)
                inside = np.searchsorted(start, at, "right")
                long_ = start[inside] - start[inside - 1] > size // 4
                at = np.unique(np.concatenate([[0], np.where(long_, start[inside], at), [len(buf)]]))
                for k, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    first, last = int(np.searchsorted(start, low, "right")) - 1, int(np.searchsorted(start, high))
                    if start[last] - start[first] < 2:  # a space alone is not told from nothing
                        first -= 1
                    piece = raw[start[first] : start[last]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((row, i, k, low, high, int(start[first]), piece), kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])
                row += 1

    return run


_FRAGMENTS = "row long, doc_id long, chunk long, good boolean, prefix binary, suffix binary, groups string, counts array<long>, keys binary, times binary"
_FRAGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _sent(row: int, doc_id: int | None, chunk: int, f: Fragment | None) -> pa.RecordBatch:
    c = f.closed if f else None
    values = (row, doc_id, chunk, f is not None, f.prefix.cell() if f else None, c and f.suffix.cell(), c and c.text, c and [c.n_a, c.n_b, c.n_groups], c and narrow(c.keys), c and narrow(c.times))
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, _FRAGMENT_TYPES, strict=True)], [x.split()[0] for x in _FRAGMENTS.split(", ")])


def _received(r: dict) -> Fragment | None:
    if not r["good"]:
        return None
    if r["counts"] is None:
        return Fragment(Tokens.of(r["prefix"]), None)
    return Fragment(Tokens.of(r["prefix"]), Closed(r["groups"], *r["counts"], wide(r["keys"]), wide(r["times"])), Tokens.of(r["suffix"]))


def _fragments(config: str, model: Model):
    def run(batches):
        both = Tokenizers(config, model)
        work = Aligner(len(both.a.lengths), model.size)
        for batch in batches:
            for r in batch.to_pylist():
                buf = np.frombuffer(r["piece"], np.uint8)[1:]  # its space is put back by the tokenizers
                t, bad, _ = both.tokens(buf, np.array([0, len(buf)]))
                t = t.between(r["low"] - r["base"], r["high"] - r["base"])
                t.a_ends, t.b_ends = t.a_ends + r["base"], t.b_ends + r["base"]
                yield _sent(r["row"], r["doc_id"], r["chunk"], None if bad.any() else work.fragment(t))

    return run


def _composed(n_a: int, n_b: int):
    """Up to ``FAN`` neighbours of one text become one fragment; a range that is not good spoils them."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        found, work = [_received(r) for r in rows], Aligner(n_a, n_b)
        out = None if any(f is None for f in found) else reduce(lambda x, y: x.compose(y, work), found)
        return pa.Table.from_batches([_sent(rows[0]["row"], rows[0]["doc_id"], rows[0]["chunk"] // FAN, out)])

    return run


def _finished(n_a: int, n_b: int, digest: bool):
    """Homes of one long text each."""

    def run(batches):
        work = Aligner(n_a, n_b)
        for batch in batches:
            for r in batch.to_pylist():
                f = _received(r)
                c = f.whole(work) if f else Closed("", 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
                doc = {"doc_id": r["doc_id"], "n_a": c.n_a, "n_b": c.n_b, "n_groups": c.n_groups, "n_links": int(c.times.sum()), "groups": _written(c.text, digest), "n_pairs": len(c.keys)}
                yield _home(-1 - r["row"], [doc], c.keys, c.times)

    return run


def _distinct(batches):
    """Every id pair of a home and the number of its documents that hold it."""
    for batch in batches:
        for home, cell in zip(batch.column("home").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            pair, n = np.unique(wide(cell), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), home)), pa.array(pair), pa.array(n)], ["home", "pair", "docs"])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _summed(t: pa.Table, got: pa.Table) -> pa.Table:
    order = np.argsort(got["pair"].to_numpy())
    pair, n, best = (got[c].to_numpy()[order] for c in ("pair", "n", "best"))
    out: list[pa.Table] = []
    for docs, keys, times in zip(t["docs"].to_pylist(), t["keys"].to_pylist(), t["times"].to_pylist(), strict=True):
        at, times = np.searchsorted(pair, wide(keys)), wide(times)
        owner = np.repeat(np.arange(len(docs)), [d["n_pairs"] for d in docs])
        total = [np.zeros(len(docs), np.int64) for _ in range(2)]
        for x, v in zip(total, (best[at] * times, n[at] * times), strict=True):
            np.add.at(x, owner, v)
        cols = {c: pa.array([d[c] for d in docs], pa.string() if c == "groups" else pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
        out.append(pa.table(cols | {"n_best": pa.array(total[0]), "count_sum": pa.array(total[1])}).select([x.split()[0] for x in _RESULT.split(", ")]))
    return pa.concat_tables(out)


def align(docs: DataFrame, byte_level_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk_bytes: int = _CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: A is a byte-level BPE
    (tokenizers JSON) of a space and the text, B a sentencepiece BPE of the text, both without special
    tokens. ``groups`` lists the ids of each group, as ``a1,a2|b1;a3|b2,b3``; with ``digest``, its SHA-256.
    ``n_best`` counts the links whose pair is held by as many documents as any pair of its A id,
    ``count_sum`` sums over the links the documents that hold their pair."""
    with open(byte_level_path) as f:
        config = f.read()
    model = Model(model_path)
    sizes = len(ByteLevel(config).lengths), model.size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length = F.octet_length("text")
    homes = rows.where(length <= chunk_bytes).mapInArrow(_align(config, model, digest), _HOMES)
    longest = rows.agg(F.max(length)).first()[0] or 0
    if longest > chunk_bytes:
        parts_ = rows.where(length > chunk_bytes).mapInArrow(_pieces(chunk_bytes), _PIECES).repartition("row", "chunk")
        tree, n = parts_.mapInArrow(_fragments(config, model), _FRAGMENTS), -(-(longest + 1) // chunk_bytes)
        while n > 1:
            tree, n = tree.groupBy("row", F.floor(F.col("chunk") / FAN)).applyInArrow(_composed(*sizes), _FRAGMENTS), -(-n // FAN)
        homes = homes.unionByName(cut(tree).mapInArrow(_finished(*sizes, digest), _HOMES))
    homes = store(homes)
    pairs = homes.select("home", "keys").mapInArrow(_distinct, "home long, pair long, docs long")
    total = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / model.size))
    best = total.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("long"))
    answer = pairs.select("home", "pair").join(best, "pair").select("home", "pair", "n", "best")
    return homes.groupBy("home").cogroup(answer.groupBy("home")).applyInArrow(_summed, _RESULT)
