"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece holds a space mark after another character, so a text falls into
segments (a run of spaces and the characters up to the next space) that no
merge crosses. A chunk's distinct segments lie in one flat array of symbol
ids. Each round finds the smallest pair rank of every segment and merges its
occurrences in all segments at once, leftmost first where they overlap, drops
the merged symbols and retires the segments that have no pair left.

All occurrences may merge in one round where no pair with the new symbol ranks
before the pair that made it: then nothing can come between them in the order
of the reference library's queue. Other symbols merge at their leftmost
occurrence only, one a round, which is that order itself.

Segments are recognised by a hash; whatever is taken from an equal one, within
a chunk or kept from before, is compared byte by byte first.

Defined results: null and empty texts give the end id alone; characters
without a piece fall back to byte pieces; a model without byte pieces gives
the unknown id. Extra columns are ignored; rows are independent of each other.
A model that normalises texts, or puts no space first, is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, chunks, word_hashes

_NONE = np.int64(1 << 40)
_MARK = "▁"
#: Texts that a normalising model changes: compatibility forms, runs of spaces, spaces at the ends, no space first.
_PROBES = ("abc", "a  b", " a", "a ", "\uff41\uff22", "\u00bc", "e\u0301", "A\tb\nc")
#: Segments, and bytes of them, whose ids a worker keeps at most before it starts afresh.
_KEEP, _KEEP_BYTES = 400_000, 16 << 20


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Model:
    """Tables of a BPE model; small (by vocabulary), so it travels in the task's closure."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(sp.normalize(t) != _MARK + t.replace(" ", _MARK) for t in _PROBES):
            raise ValueError("only models that keep texts as they are and put a space first are supported")
        self.size, self.unk, self.end = sp.vocab_size(), sp.unk_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(self.size)]
        self.byte_ids = np.full(256, -1, np.int64)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(_MARK in p.lstrip(_MARK) for p in ids):
            raise ValueError("a piece has a space mark inside: segments cannot be encoded alone")
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.char_ids = {ord(p): i for p, i in ids.items() if len(p) == 1}
        span = self.size + 0x110000
        one = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else None)
        found = [(a * span + b, i) for p, i in ids.items() for k in range(1, len(p)) if (a := one(p[:k])) is not None and (b := one(p[k:])) is not None]
        found.sort()
        self.keys = np.array([k for k, _ in found], np.int64)
        self.made = np.array([i for _, i in found], np.int64)
        self.ranks = np.unique(-scores[self.made], return_inverse=True)[1].astype(np.int64)
        # The best rank among pairs with a symbol, to tell which merges may be made together.
        best = np.full(span, _NONE)
        for side in (self.keys // span, self.keys % span):
            np.minimum.at(best, side, self.ranks)
        self.together = best[self.made] >= self.ranks
        text = [b"" if sp.is_control(i) else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == self.unk else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.text, self.is_byte = text, np.isin(np.arange(self.size), self.byte_ids[self.byte_ids >= 0])
        self.span = span


class Coder:
    """Encodes and decodes whole chunks with one model; keeps the segments it has seen."""

    def __init__(self, model: Model):
        self.m = m = model
        self.of_char = m.size + np.arange(0x110000, dtype=np.int64)
        for c, i in m.char_ids.items():
            self.of_char[c] = i
        self.names = np.array([str(i) for i in range(m.size)], dtype=object)
        self.lengths = np.array([len(x) for x in m.text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(m.text), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.seen, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bound = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.raw, self.raw_bound = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the pair table) of symbol pairs."""
        key = a * self.m.span + b
        i = np.minimum(np.searchsorted(self.m.keys, key), len(self.m.keys) - 1)
        return np.where(self.m.keys[i] == key, self.m.ranks[i], _NONE), i

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final (symbols, segments), in order of segment."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, pair = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        i = np.flatnonzero(seg[1:] == seg[:-1])
        rank[i], pair[i] = self._rank(sym[i], sym[i + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            over = np.repeat(best == _NONE, size)
            if over.any():
                done.append((sym[over], seg[over]))
                sym, seg, rank, pair, best, size = sym[~over], seg[~over], rank[~over], pair[~over], best[best != _NONE], size[best != _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # The leftmost of a segment, all that may go together, and of overlapping ones every other.
            left = np.concatenate([[True], seg[hit][1:] != seg[hit][:-1]])
            alone = ~self.m.together[pair[hit]]
            if alone.any():
                single = np.zeros(len(head), bool)
                single[np.searchsorted(head, hit[alone], "right") - 1] = True
                hit = hit[left | ~single[np.searchsorted(head, hit, "right") - 1]]
            at = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) != 1]), at, 0))
            hit = hit[(at - start) % 2 == 0]
            sym[hit] = self.m.made[pair[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            new = np.cumsum(stay) - 1
            sym, seg, rank, pair, hit = sym[stay], seg[stay], rank[stay], pair[stay], new[hit]
            touched = np.zeros(len(sym), bool)
            touched[hit] = touched[hit[hit > 0] - 1] = True
            again = np.flatnonzero(touched)
            rank[again] = _NONE
            again = again[again + 1 < len(sym)]
            again = again[seg[again] == seg[again + 1]]
            rank[again], pair[again] = self._rank(sym[again], sym[again + 1])
        sym, seg = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*done, strict=True) if done else ((), ())))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _encoded(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the segments ``at``, one after the other."""
        size = w.ends[at] - w.starts[at]
        raw = w.buf[_ranges(w.starts[at], size)]
        seg_of_byte = np.repeat(np.arange(len(at)), size)
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        seg = seg_of_byte[(raw & 0xC0) != 0x80]
        if len(seg) != len(chars):
            raise ValueError("text is not UTF-8")
        chars[chars == 0x20] = ord(_MARK)
        sym, seg = self._merge(self.of_char[chars], seg)
        lost = sym >= self.m.size
        if lost.any():
            parts = [[int(x) for x in (self.m.byte_ids[list(chr(s - self.m.size).encode())] if self.m.byte_ids[0] >= 0 else [self.m.unk])] for s in sym[lost].tolist()]
            n = np.ones(len(sym), np.int64)
            n[lost] = [len(p) for p in parts]
            ids = np.repeat(sym, n)
            ids[np.repeat(lost, n)] = [x for p in parts for x in p]
            sym, seg = ids, np.repeat(seg, n)
        return sym.astype(np.int32), np.bincount(seg, minlength=len(at))

    def _learn(self, w: Words, at: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes the segments ``at`` and keeps them with their bytes."""
        ids, n = self._encoded(w, at)
        size = w.ends[at] - w.starts[at]
        base = len(self.bound) - 1
        self.flat, self.raw = np.concatenate([self.flat, ids]), np.concatenate([self.raw, w.buf[_ranges(w.starts[at], size)]])
        self.bound, self.raw_bound = np.append(self.bound, self.bound[-1] + np.cumsum(n)), np.append(self.raw_bound, self.raw_bound[-1] + np.cumsum(size))
        seen, row = np.concatenate([self.seen, hashes]), np.concatenate([self.row, base + np.arange(len(at))])
        order = np.argsort(seen, kind="stable")
        self.seen, self.row = seen[order], row[order]

    def _differ(self, w: Words, row: np.ndarray) -> np.ndarray:
        """The segments whose bytes are not those kept at ``row``, though their hashes agree."""
        size, kept = w.ends - w.starts, np.diff(self.raw_bound)[row]
        odd = np.flatnonzero(size != kept)
        # Segments follow each other without gaps, so the buffer itself is one side.
        place = np.repeat(np.where(size == kept, self.raw_bound[row], 0) - w.starts, np.where(size == kept, size, 0))
        mine = w.buf if not len(odd) else w.buf[_ranges(w.starts, np.where(size == kept, size, 0))]
        place += np.arange(len(w.buf)) if not len(odd) else _ranges(w.starts, np.where(size == kept, size, 0))
        unequal = np.flatnonzero(mine != self.raw[place])
        if not len(unequal):
            return odd
        return np.union1d(odd, np.repeat(np.arange(len(row)), np.where(size == kept, size, 0))[unequal])

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts."""
        full = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        space = buf == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][full]] = True
        starts = np.flatnonzero(first)
        w = Words(buf, offsets, starts, np.append(starts[1:], len(buf))[: len(starts)], np.searchsorted(starts, offsets))
        distinct, at, which = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        if len(self.seen) > _KEEP or len(self.raw) > _KEEP_BYTES:
            self._forget()
        i = np.searchsorted(self.seen, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.seen):
            new = self.seen[np.minimum(i, len(self.seen) - 1)] != distinct
        if new.any():
            self._learn(w, at[new], distinct[new])
        row = self.row[np.searchsorted(self.seen, distinct)][which] if len(which) else np.zeros(0, np.int64)
        start, n, flat = self.bound[row], np.diff(self.bound)[row], self.flat
        other = self._differ(w, row)
        if len(other):  # two segments with one hash: these are encoded for themselves
            ids, counts = self._encoded(w, other)
            start[other], n[other] = len(flat) + np.cumsum(counts) - counts, counts
            flat = np.concatenate([flat, ids])
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[_ranges(start, n)]
        bounds = total[w.bounds]
        if end:
            ids = np.insert(ids, bounds[1:], self.m.end)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 text of every id sequence."""
        n = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.bytes[np.repeat(self.starts[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        byte = np.concatenate([[0], np.cumsum(self.m.is_byte[ids])])
        texts = []
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            t = out[total[a] : total[b]]
            if byte[b] > byte[a]:
                try:
                    t.decode()
                except UnicodeDecodeError:
                    t = self._repair(ids[a:b])
            if t[:1] == b" ":
                first = ids[a + np.flatnonzero(n[a:b])[0]]
                if first != self.m.unk and not self.m.is_byte[first]:
                    t = t[1:]  # the space that encoding put first
            texts.append(t)
        return texts

    def _repair(self, ids: np.ndarray) -> bytes:
        """Byte pieces that are not UTF-8 give the replacement character, byte by byte."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode().encode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    i += 1
            run.clear()

        for x in ids.tolist():
            if self.m.is_byte[x]:
                run += self.m.text[x]
            else:
                flush()
                out.append(self.m.text[x])
        flush()
        return b"".join(out)


def _task(model: Model, id_col: str, text_col: str, digest: bool):
    def run(batches):
        coder = Coder(model)
        for batch in batches:
            for rows, buf, offsets in chunks(batch.column(text_col)):
                ids, bounds = coder.encode(buf, offsets)
                out = {id_col: batch.column(id_col).slice(rows.start, rows.stop - rows.start), "n_tokens": pa.array(np.diff(bounds))}
                if digest:
                    names, decoded = coder.names[ids], coder.decode(ids, bounds)
                    out["ids_sha256"] = pa.array([hashlib.sha256(" ".join(names[a:b]).encode()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string())
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id, n_tokens, ids`` of every whole text, with an end id. With ``digest``, instead of the
    ids their SHA-256 (decimal, joined by spaces) and that of the text decoded from them."""
    model = Model(model_path)
    kind = docs.schema[id_col].dataType.simpleString()
    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    return docs.select(id_col, text_col).mapInArrow(_task(model, id_col, text_col, digest), f"{id_col} {kind}, n_tokens long, {more}")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from arrays of ids; null ids give an empty text."""
    model = Model(model_path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Coder(model)
        for batch in batches:
            texts: list[str] = []
            lists = batch.column(ids_col).to_pylist()
            for i in range(0, len(lists), 256):
                part = [x or [] for x in lists[i : i + 256]]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
                texts += [t.decode() for t in coder.decode(np.array([y for x in part for y in x], np.int64), bounds)]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "text": pa.array(texts, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
