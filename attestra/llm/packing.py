"""Packing by minimum bin slack: windows are filled by bitset subset sums over the lengths that remain.

Documents are cut into full windows and one shorter remainder each. Only the histogram of piece lengths (at most `window`
counts) meets on the driver. There the longest remaining length seeds a window, subset sums over the remaining counts, held as
the bits of one integer, give the fill closest to capacity, and the multiset is backtracked and repeated for as long as its
counts last. Where the closest fill leaves slack, a piece of the most frequent remaining length is cut to close it, and its rest
goes back to the histogram. What is left at the end, less than one window, is cut at powers of two, at which sequences need no
padding. So no window is padded. Each step uses up a group of pieces, so the plan has a few thousand rows at any corpus size. Every
piece finds its place from its rank among pieces of its length: a rank within its task plus the sum of earlier tasks' counts.

Defined cases: null or empty texts are one end token; repeated rows are packed once each, and pieces of one length are equal in
rank order, by task and place in it; an empty table gives an empty result; null ids stay null; a very long text is as many full
windows as it has, and one remainder; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import bpe
from .common import materialize, texts

#: Characters encoded at a time, and bytes of pieces that a task gathers before it writes: ids are held in neither for long.
BATCH_CHARS, ROW_GROUP = 2 << 20, 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, task_rank long, ids binary"
#: Pieces [first, stop) of a length, from token `skip` on for `taken` tokens, go to windows, per_window at a time.
PLAN = "piece_length long, first long, stop long, skip long, taken long, per_window long, base_window long, base_offset long"


def pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut at multiples of window; task_rank counts pieces of a length within the writing task."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = bpe.load(path), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            at = 0
            for run in bpe.small_batches(batch.column(1).to_pylist(), BATCH_CHARS):
                rows: list[list] = [[] for _ in range(8)]
                for blob in tok.encode_batch(run):
                    blob += end
                    n = len(blob) // 4
                    for start in range(0, n, window):
                        part = blob[4 * start : 4 * (start + window)]
                        length = len(part) // 4
                        for column, value in zip(rows, (names[at], start, length, zlib.crc32(part), n, task, seen[length], part), strict=True):
                            column.append(value)
                        seen[length] += 1
                    at += 1
                columns = [pa.array(r, pa.int64()) for r in rows[:7]] + [pa.array(rows[7], pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum is the largest up to capacity: subset sums as bits, then backtracked counts."""
    steps, reach, mask = [], 1, (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


class Stock:
    """What remains to be packed: for each length, groups of pieces or of their rests (piece length, first rank, tokens skipped, how many)."""

    def __init__(self, histogram: dict[int, int]):
        self.groups = {n: [(n, 0, 0, count)] for n, count in histogram.items() if count}

    def count(self, length: int) -> int:
        return sum(g[3] for g in self.groups.get(length, []))

    def counts(self) -> dict[int, int]:
        return {n: self.count(n) for n in self.groups}

    def add(self, length: int, group: tuple[int, int, int, int]) -> None:
        self.groups.setdefault(length, []).append(group)

    def whole_times(self, length: int, each: int) -> int:
        """How many windows can take `each` pieces from the first group alone; one where groups have to be mixed."""
        return max(1, self.groups[length][0][3] // each)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        while n:
            piece, first, skip, have = self.groups[length].pop(0)
            used = min(n, have)
            out.append((piece, first, skip, used))
            if have > used:
                self.groups[length].insert(0, (piece, first + used, skip, have - used))
            n -= used
        if not self.groups[length]:
            del self.groups[length]
        return out


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Rows of PLAN that place every token of the histogram's pieces."""
    stock, plan, windows = Stock(histogram), [], 0
    while counts := stock.counts():
        seed = max(counts)
        rest = {k: v for k, v in (counts | {seed: counts[seed] - 1}).items() if v and k <= window - seed}
        fill = best_fill(rest, window - seed) if seed < window else {}
        fill[seed] = fill.get(seed, 0) + 1
        slack = window - sum(k * m for k, m in fill.items())
        # Of the lengths that do not fit any more, the most frequent one is cut.
        spare = {k: v - fill.get(k, 0) for k, v in counts.items() if v > fill.get(k, 0)}
        cut = max(spare, key=lambda k: (spare[k], k)) if slack and spare else None
        if slack and cut is None:
            return plan + last_windows(stock, windows)
        needs = dict(fill)
        if cut is not None:
            needs[cut] = needs.get(cut, 0) + 1
        times = min(stock.whole_times(k, m) for k, m in needs.items())
        offset = 0
        for length, m in fill.items():
            for piece, first, skip, n in stock.take(length, m * times):
                each = m if times > 1 else n
                plan.append((piece, first, first + n, skip, length, each, windows, offset))
                offset += each * length
        if cut is not None:
            for piece, first, skip, n in stock.take(cut, times):
                plan.append((piece, first, first + n, skip, slack, 1, windows, offset))
                stock.add(cut - slack, (piece, first, skip + slack, n))
        windows += times
    return plan


def last_windows(stock: Stock, windows: int) -> list[tuple[int, ...]]:
    """The rest, less than a window: laid end to end and cut where the sequences, each a power of two, end."""
    left = sum(k * v for k, v in stock.counts().items())
    room, offset, plan = 1 << (left.bit_length() - 1), 0, []
    for length in sorted(stock.groups, reverse=True):
        for piece, first, skip, n in stock.take(length, stock.count(length)):
            for rank in range(first, first + n):
                done = 0
                while done < length:
                    if offset == room:
                        left -= room
                        room, offset, windows = 1 << (left.bit_length() - 1), 0, windows + 1
                    part = min(length - done, room - offset)
                    plan.append((piece, rank, rank + 1, skip + done, part, 1, windows, offset))
                    done, offset = done + part, offset + part
    return plan


def place(cut: DataFrame, window: int = 1024, *, with_ids: bool = False) -> DataFrame:
    """cut (a written table of pieces) with sequence_id and offset for every piece; some are cut once more."""
    spark = cut.sparkSession
    by_task = materialize(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    rows = plan_windows(histogram, window)

    def placed(some: DataFrame, plan: list[tuple[int, ...]]) -> DataFrame:
        own = F.broadcast(spark.createDataFrame(plan, PLAN))
        ranked = some.join(shifts, ["length", "task"]).withColumn("rank", F.col("shift") + F.col("task_rank"))
        return ranked.join(own, (F.col("length") == F.col("piece_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))

    turn = F.col("rank") - F.col("first")
    at = [(F.col("base_window") + F.floor(turn / F.col("per_window"))).cast("long").alias("sequence_id"), (F.col("base_offset") + (turn % F.col("per_window")) * F.col("taken")).cast("long").alias("offset")]
    ids = ["ids"] if with_ids else []
    whole = placed(cut if with_ids else cut.drop("ids"), [r for r in rows if r[4] == r[0]])
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *ids, *at)
    # Only pieces of lengths that are cut again bring their ids along.
    lengths = sorted({r[0] for r in rows if r[4] != r[0]})
    again = placed(cut.where(F.col("length").isin(lengths)), [r for r in rows if r[4] != r[0]])
    part = F.substring(F.col("ids"), (4 * F.col("skip") + 1).cast("int"), (4 * F.col("taken")).cast("int"))
    again = again.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("taken").alias("length"), F.crc32(part).alias("ids_crc32"), "doc_tokens", *([part.alias("ids")] if with_ids else []), *at)
    return whole.unionByName(again)


def pack(docs: DataFrame, path: str, window: int = 1024, *, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids where asked for, sequence_id, offset."""
    return place(materialize(pieces(docs, path, window, id_col=id_col, text_col=text_col), "pieces", row_group=ROW_GROUP), window, with_ids=with_ids)
