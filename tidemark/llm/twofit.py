"""Best-two-fit packing of whole documents into as few sequences as it can.

A sequence is filled greedily: the longest unpacked piece, then again and again the
longest that still fits. If room is left and the sequence holds more than one
piece, its smallest is put back for the two unpacked pieces that fill the room
and its place most tightly, where two such fill more.

Pieces of one length are interchangeable, so the choices depend only on how many
pieces of each length are left. ``plan`` makes them on these counts, at most
``size`` numbers that Spark adds up over all documents, and makes a sequence as
many times at once as the choices would come out the same: its sequences are those of
packing one by one (a test holds it to that), and its cost does not grow with the
documents. Tasks number their pieces of each length as they encode them; what
the tasks before have of a length is a running sum in Spark. A piece's number
among those of its length then tells its sequence and its place by a search in the
plan.

Documents longer than ``size`` are cut into pieces of ``size``; the first piece
holds the rest.

Defined cases: a null or empty text is one end token; a row without an id and a
repeated id are packed as often as they come; pieces of one length are taken in
the order of tasks and rows; an empty table gives no pieces; other
columns are ignored. Memory of a task: a slice of text with its ids (a longer text is a
slice by itself) and the remembered words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .packing import SLICE_BYTES, encoder

#: Ids that a task sends at once.
SENT = 4 << 20
#: Counts before a task, by task and length, that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Room for a piece's number among those of its length, in a search key.
NUMBERS = 44


def _pair(lengths: list[int], pool: dict[int, int], room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths a >= b with the greatest sum over ``least`` and up to ``room``; of equal sums that of the greatest a."""
    a = np.array([x for x in lengths if x < room and pool[x]], np.int64)
    if not len(a):
        return None
    twice = np.array([pool[x] > 1 for x in a.tolist()])
    k = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
    k = np.where((k == np.arange(len(a))) & ~twice, k - 1, k)
    total = np.where(k >= 0, a + a[k], 0)
    best = len(a) - 1 - int(total[::-1].argmax())
    return (int(a[best]), int(a[k[best]])) if total[best] > least else None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """How often each kind of sequence is made, and the pieces of each length in it, in the order of making."""
    left = {x: n for x, n in counts.items() if n > 0}
    lengths, made = sorted(left), []
    while lengths:
        used: dict[int, int] = {}
        room, k = size, len(lengths) - 1
        while k >= 0:
            x = lengths[k]
            n = min(left[x], room // x)
            used[x], room = n, room - n * x
            k = min(k, bisect_right(lengths, room)) - 1
        need, net = dict(used), dict(used)
        if room and sum(used.values()) > 1:
            smallest = min(used)
            pair = _pair(lengths, {x: left[x] - used.get(x, 0) for x in lengths}, room + smallest, smallest)
            if pair:
                net[smallest] -= 1
                for x in pair:
                    net[x], need[x] = net.get(x, 0) + 1, need.get(x, 0) + 1
        # as long as what the choices look at is still there, they come out the same
        times = 1 + min((left[x] - need[x]) // n for x, n in net.items() if n)
        net = {x: n for x, n in net.items() if n}
        made.append((times, net))
        for x, n in net.items():
            left[x] -= times * n
            if not left[x]:
                lengths.remove(x)
    return made


def places(made: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """The plan by length and first number: search keys, first numbers, pieces a sequence, first sequence, offset of the first piece."""
    rows, taken, sequence = [], {}, 0
    for times, net in made:
        offset = 0
        for x, n in net.items():
            first = taken.get(x, 0)
            rows.append(((x << NUMBERS) + first, first, n, sequence, offset))
            taken[x], offset = first + times * n, offset + n * x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table[:, k].copy() for k in range(5))


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian uint32), task, and the piece's number in its task among those of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(size + 1, np.int64)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            ids = encode(batch.column(1))
            n = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
            flat = np.full(int(n.sum()), end_id, "<u4")
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(n) - 1] = False
            flat[inner] = np.concatenate(ids)
            parts = -(-n // size)
            doc, piece = np.repeat(np.arange(len(n)), parts), common.ragged(np.zeros(len(n), np.int64), parts)
            first = (n - (parts - 1) * size)[doc]
            length = np.where(piece == 0, first, size)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=size + 1)
            ends = np.cumsum(length)
            cuts = [0, *(np.flatnonzero(np.diff(ends // SENT)) + 1).tolist(), len(length)]
            for a, b in zip(cuts, cuts[1:]):
                begin = ends[a] - length[a]
                offsets = np.concatenate([[0], ends[a:b] - begin]) * 4
                data = flat[begin : ends[b - 1]]
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                start = np.where(piece == 0, 0, first + (piece - 1) * size)[a:b]
                kept = (batch.column(0).take(pa.array(doc[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(start), pa.array(length[a:b], pa.int32()), binary, pa.array(np.full(b - a, task), pa.int32()), pa.array(rank[a:b]))
                yield pa.RecordBatch.from_arrays(list(kept), names=["doc_id", "piece", "start", "length", "ids", "task", "rank"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length int, ids binary, task int, rank long")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset."""
    cut = common.scratch(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    each = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    key = F.shiftleft(F.col("task").cast("long"), 32) + F.col("length")
    counted = common.scratch(each.select(key.alias("key"), "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``size`` numbers
    keys, firsts, uses, sequences, offsets = places(plan({r.length: r.n for r in totals}, size))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy().astype(np.int64), number.to_numpy()
        k = np.searchsorted(keys, (length << NUMBERS) + number, "right") - 1
        sequence, slot = np.divmod(number - firsts[k], uses[k])
        return pd.DataFrame({"sequence_id": sequences[k] + sequence, "offset": offsets[k] + slot * length})

    marked = cut.withColumn("key", key).join(common.with_broadcast_if_small(counted.select("key", "before"), BROADCAST_ROWS), "key")
    marked = marked.withColumn("placed", placed("length", F.col("before") + F.col("rank")))
    return marked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "placed.sequence_id", "placed.offset")
