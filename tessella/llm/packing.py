"""Packing token ids into rows of a fixed length by best-fit decreasing.

Every text is encoded with an end id. Documents longer than a row are split
without loss into whole rows and a rest. Pieces are placed longest first, each
into the open row with the least room that still holds it; a segment tree over
the room left, 0 to ``length``, finds that row in log(length) steps. Rows are
packed in runs of bounded size inside a scan's partition (a shard), so tokens
are never shuffled and a hot source is as many runs as it fills.

A row is a line of the id matrix (unsigned 16- or 32-bit little endian, padded),
with cumulative segment lengths, the position at which each segment starts (0
where positions reset, more where a split document goes on), and the documents'
ids and rows in the shard, from which ``unpack`` restores every id sequence.

Defined results: null and empty texts are one end id; repeated rows are packed
again; a null id stays null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_bpe import Coder, Model
from .text import chunks

#: Tokens that one run of rows is packed from.
RUN_TOKENS = 1 << 21


class RoomTree:
    """Which amounts of room occur: a bit tree with a search for the least that suffices."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, int(length).bit_length())
        self.tree = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = True
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) with the least room of at least ``size``."""
        i, t = size + self.leaves, self.tree
        if not t[i]:
            while i > 1 and not (i & 1 == 0 and t[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if t[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            t[i] = False
            while i > 1:
                i >>= 1
                t[i] = t[2 * i] or t[2 * i + 1]
        return room, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers, by best-fit decreasing."""
    tree, rows = RoomTree(length), []
    for p in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[p])
        got = tree.take(size) if size < length else None
        if got is None:
            got = (length, len(rows))
            rows.append([])
        room, row = got
        rows[row].append(p)
        if room > size:
            tree.add(room - size, row)
    return rows


def _pack(model: Model, length: int, pad: int, id_col: str, run_tokens: int):
    kind = np.uint16 if model.size <= 1 << 16 else np.uint32

    def run(batches):
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), Coder(model)
        held: list[tuple] = []
        count = rows_before = docs_before = 0

        def flush():
            nonlocal rows_before, held, count
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            first_doc = docs_before - len(sizes)
            start = np.cumsum(sizes) - sizes
            n = np.maximum(1, -(-sizes // length))
            doc = np.repeat(np.arange(len(sizes)), n)
            offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * length
            piece = np.minimum(sizes[doc] - offset, length)
            rows = best_fit(piece, length)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                order = np.concatenate([np.array(r) for r in part])
                many = np.array([len(r) for r in part])
                size, ends = piece[order], np.cumsum(many)
                line = np.repeat(np.arange(len(part)), many)
                total = np.cumsum(size)
                base = np.concatenate([[0], total[ends - 1][:-1]])
                place = total - size - base[line] + line * length
                matrix = np.full(len(part) * length, pad, kind)
                to = np.repeat(place - (total - size), size) + np.arange(total[-1])
                matrix[to] = ids[np.repeat(start[doc[order]] + offset[order] - (total - size), size) + np.arange(total[-1])]
                bounds = np.concatenate([[0], ends])
                as_list = lambda x, t: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t))  # noqa: E731, B023
                cells = matrix.reshape(len(part), length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), shard, np.int64)), pa.array(rows_before + at + np.arange(len(part))), pa.array((total[ends - 1] - base).astype(np.int32)),
                        pa.array([c.tobytes() for c in cells], pa.binary()), as_list(total - base[line], pa.int32()), as_list(offset[order], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), doc_ids.take(pa.array(doc[order]))), as_list(first_doc + doc[order], pa.int64()),
                    ],
                    names=["shard", "row", "n_tokens", "ids", "segment_ends", "position_starts", "doc_ids", "doc_rows"],
                )
            rows_before += len(rows)
            held, count = [], 0

        for batch in batches:
            for rows, buf, offsets in chunks(batch.column("text")):
                ids, bounds = coder.encode(buf, offsets)
                held.append((batch.column(id_col).slice(rows.start, rows.stop - rows.start), ids, np.diff(bounds)))
                count += len(ids)
                docs_before += rows.stop - rows.start
                if count >= run_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, model_path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", pad: int | None = None, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """``shard, row, n_tokens, ids, segment_ends, position_starts, doc_ids, doc_rows``."""
    model = Model(model_path)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "shard long, row long, n_tokens int, ids binary, segment_ends array<int>, position_starts array<int>, doc_ids array<long>, doc_rows array<long>"
    return d.mapInArrow(_pack(model, length, model.unk if pad is None else pad, "doc_id", run_tokens), schema)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """``shard, doc_row, doc_id, ids`` (binary) of every document, from its pieces in order."""
    pieces = packed.select("shard", "ids", F.posexplode(F.arrays_zip("segment_ends", "position_starts", "doc_ids", "doc_rows")).alias("i", "s"), "segment_ends")
    start = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.get("segment_ends", F.col("i") - 1))
    cell = F.substring(F.col("ids"), start * width + 1, (F.col("s.segment_ends") - start) * width)
    pieces = pieces.select("shard", F.col("s.doc_rows").alias("doc_row"), F.col("s.doc_ids").alias("doc_id"), F.struct(F.col("s.position_starts").alias("at"), cell.alias("ids")).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("shard", "doc_row", "doc_id").agg(joined.alias("ids"))
