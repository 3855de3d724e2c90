"""Conversation structure repair: cheapest edits by A* on the edit lattice, block by block.

A row is kept, given another role, or deleted, and empty turns are inserted, so that roles become an optional system turn and then pairs
of user and assistant. A node of the lattice is (rows consumed, what the turns so far end with). Blank and repeated rows must be deleted, and
a truncated row costs at least its charge, kept or deleted; suffix sums of both never exceed what is still to be paid. Nodes leave
the queue by (cost plus that sum, audit), so that among the cheapest edits those with the least audit are found. Two audits of one cost between
the same nodes are never a prefix of one another, so a least whole is made of least parts.

Rows are sorted by ranges over all conversations and numbered; blocks of 256 numbers are searched by themselves, from every state that may
hold at their start to every state at their end, and the blocks of a conversation are then folded in order, which compares paths as the
search does. So a conversation of any length is many tasks' work and needs a block's memory; only its audit, which is one value of the
result, and its digest meet in one task, as a stream.

Defined cases: a null role or text counts as one space; null ids are one conversation; null turns come first; rows of one turn stand by role
and then by the MD5 of their text, and rows equal in all that are interchangeable; role initials other than s, u, a fit nowhere and are legal
next to none; a conversation without rows has an empty audit and no cost; empty and very long texts are worked on whole; empty tables
give empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, named

#: What turns so far end with: nothing, the system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NOTHING, ASSISTANT)
#: The turn that a new or renamed one must be, by state; and where a kept row leads, by state and role initial.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: One letter a row: its role initial (x: another) and its first fault.
FAULTS = ("none", "truncated", "blank", "duplicate")
LETTERS = {(i, f): "suaxSUAX01234567"[4 * j + k] for j, f in enumerate(FAULTS) for k, i in enumerate("suax")}
INITIAL = {c: i for (i, _), c in LETTERS.items()}
FAULT = {c: f for (_, f), c in LETTERS.items()}
#: The least that a row costs.
CHARGE = {c: {"none": 0, "truncated": min(TRUNCATED, DELETE)}.get(f, DELETE) for c, f in FAULT.items()}

BLOCK_BITS = 8


def search(codes: str, start: int = NOTHING, goals: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """For each state at the end, the least (cost, audit) from `start`; with goals, only the first of them that is reached."""
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + CHARGE[codes[i]]
    queue, done, out = [(ahead[0], "", 0, start)], set(), {}
    while queue:
        total, audit, i, q = heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            out[q] = (total, audit)
            if goals and q in goals:
                return {q: out[q]}
        heappush(queue, (total + INSERT, audit + "I", i, NEXT[q]))
        if i < n:
            c, least = codes[i], total - CHARGE[codes[i]]
            heappush(queue, (least + DELETE, audit + "D", i + 1, q))
            if FAULT[c] in ("none", "truncated"):
                least += TRUNCATED if FAULT[c] == "truncated" else 0
                if (q, INITIAL[c]) in KEEP:
                    heappush(queue, (least, audit + "K", i + 1, KEEP[q, INITIAL[c]]))
                heappush(queue, (least + RENAME, audit + "R", i + 1, NEXT[q]))
    return out


@lru_cache(1 << 14)
def paths(codes: str, anywhere: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(start, end, cost, audit) of a block; anywhere: a conversation may go on in it, otherwise it starts in it."""
    return tuple((q, end, *found) for q in (range(4) if anywhere else (NOTHING,)) for end, found in search(codes, q).items())


class Fold:
    """The blocks of one conversation in order: its counts, and the best path to every state so far.

    What all these paths have in common is put aside, so that few letters are copied and compared a block.
    """

    def __init__(self) -> None:
        self.best, self.done = {NOTHING: (0, "")}, []
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.turns, self.first, self.top, self.before = 0, 0, None, None, ""

    def add(self, codes: str, steps: list[tuple[int, int, int, str]], low: int | None, high: int | None, turns: int) -> None:
        best: dict[int, tuple[int, str]] = {}
        for q, end, cost, audit in steps:
            if q in self.best:
                found = (self.best[q][0] + cost, self.best[q][1] + audit)
                best[end] = min(best.get(end, found), found)
        common = commonprefix([a for _, a in best.values()])
        self.done.append(common)
        self.best = {q: (cost, audit[len(common) :]) for q, (cost, audit) in best.items()}
        for c in codes:
            self.counts[FAULT[c]] += 1
        initials = self.before + "".join(INITIAL[c] for c in codes)
        self.illegal += sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        self.before = initials[-1:]
        if turns:
            self.turns += turns - (low == self.top)
            self.first, self.top = low if self.first is None else self.first, high

    def row(self) -> tuple:
        cost, audit = min(self.best[q] for q in GOALS if q in self.best)
        gaps = self.top - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, cost, "".join(self.done) + audit


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage told by the CRC-32 of id and turn: rows dropped, emptied, cut, repeated, or made the user's."""
    told = F.concat_ws(":", *[F.coalesce(named(rows, c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    own = rows.select(named(rows, "conv_id").cast("long").alias("conv_id"), named(rows, "turn").cast("long").alias("turn"), *[F.coalesce(named(rows, c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(told) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return own.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, seq as a written table; seq grows along every conversation and has no holes within a range of the sort."""
    own = rows.select(named(rows, "conv_id").cast("long").alias("conv_id"), named(rows, "turn").cast("long").alias("turn"), *[F.coalesce(named(rows, c), F.lit(" ")).alias(c) for c in ("role", "text")])
    keyed = own.withColumns({"digest": F.md5("text"), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "digest", "row"]  # nulls first; equal rows may be parted
    return materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()).drop("row"), "numbered")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, seq, code: one letter for role initial and first fault. Only texts that a conversation repeats are joined back."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    both = rows.join(seen, rows.conv_id.eqNullSafe(seen.c) & (rows.role == seen.r) & (rows.digest == seen.d), "left")
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(trimmed == "", "blank").when(F.col("seq") > F.col("first"), "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letters = F.create_map(*[F.lit(x) for (i, f), c in LETTERS.items() for x in (f"{i} {f}", c)])
    return both.select("conv_id", "turn", "seq", letters[F.concat_ws(" ", known, fault)].alias("code"))


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id and its gaps, faults, illegal neighbours, cost and audit; rows come from numbered()."""
    ship_package(rows.sparkSession)
    block = F.shiftright("seq", BLOCK_BITS).alias("block")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), "")
    anywhere = F.min(F.col("seq") % (1 << BLOCK_BITS)) == 0
    blocks = coded(rows).groupBy("conv_id", block).agg(letters.alias("codes"), anywhere.alias("anywhere"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Searches all blocks where they are, before those of one conversation meet."""
        for batch in batches:
            result = [paths(c, a) for c, a in zip(batch.column("codes").to_pylist(), batch.column("anywhere").to_pylist(), strict=True)]
            lists = [[p[i] for p in ps] for i in range(4) for ps in result]
            n = batch.num_rows
            columns = {f"p{i}": pa.array(lists[i * n : (i + 1) * n], pa.list_(pa.string() if i == 3 else pa.int64())) for i in range(4)}
            yield pa.record_batch([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = (), None
        for batch in batches:
            out = []
            for conv, codes, low, high, turns, *ps in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "codes", "low", "high", "turns", "p0", "p1", "p2", "p3")], strict=True):
                if now != (conv,):
                    if held:
                        out.append((*now, *held.row()))
                    now, held = (conv,), Fold()
                held.add(codes, list(zip(*ps, strict=True)), low, high, turns)
            yield table(out)
        if held:
            yield table([(*now, *held.row())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.record_batch([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=["conv_id", *SUMMARY])

    steps = "p0 array<long>, p1 array<long>, p2 array<long>, p3 array<string>"
    searched = blocks.mapInArrow(found, f"conv_id long, block long, codes string, anywhere boolean, low long, high long, turns long, {steps}")
    return searched.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(fold, "conv_id long, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in SUMMARY))


class Edits:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of turns that are inserted before the next row, or after the last."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[self.state, role[:1]]
            yield "K", role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield "R", ROLE[self.state], text


def stream(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, audit: for each conversation, in one partition and in order, its summary (seq -1) and then its rows."""
    marks = summary.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *SUMMARY)
    texts = rows.select("conv_id", "seq", "role", "text", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in SUMMARY])
    return marks.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def slices(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[list[dict]]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n).to_pylist()


def repaired(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the repaired conversations, row by row; rows come from numbered()."""
    ship_package(rows.sparkSession)
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, place = None, Edits(""), 0
        for part in slices(batches):
            out = []
            for r in part:
                new = edits.inserted() if r["seq"] < 0 else edits.edited(r["role"], r["text"])
                for turn in new:
                    out.append((conv, place, *turn))
                    place += 1
                if r["seq"] < 0:
                    conv, edits, place = r["conv_id"], Edits(r["audit"]), 0
            yield batch_of(out)
        yield batch_of([(conv, place + i, *turn) for i, turn in enumerate(edits.inserted())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.record_batch([pa.array(c, pa.int64() if i < 2 else pa.string()) for i, c in enumerate(columns)], names=names)

    return stream(rows, summary).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary with repaired_sha256, of the repaired conversation's lines `role:text`; rows come from numbered()."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, edits, sha, lines = None, Edits(""), hashlib.sha256(), 0

        def take(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal lines
            for _, role, text in turns:
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

        for part in slices(batches):
            out = []
            for r in part:
                if r["seq"] >= 0:
                    take(edits.edited(r["role"], r["text"]))
                    continue
                take(edits.inserted())
                if mark:
                    out.append((*mark, sha.hexdigest()))
                mark, edits, sha, lines = (r["conv_id"], *[r[c] for c in SUMMARY]), Edits(r["audit"]), hashlib.sha256(), 0
            yield batch_of(out)
        take(edits.inserted())
        yield batch_of([(*mark, sha.hexdigest())] if mark else [])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 9
        return pa.record_batch([pa.array(c, pa.string() if i > 6 else pa.int64()) for i, c in enumerate(columns)], names=["conv_id", *SUMMARY, "repaired_sha256"])

    longs = ", ".join(f"{c} long" for c in SUMMARY[:-1])
    return stream(rows, summary).mapInArrow(run, f"conv_id long, {longs}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summaries of all conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired rows."""
    rows = numbered(conversations)
    summary = materialize(summaries(rows), "summaries")
    return summary, repaired(rows, summary)


def digest(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Summary and digest of every id of `original`, whose rows may have gone; rows are what is left of them."""
    kept = numbered(rows)
    known = digests(kept, summaries(kept))
    every = original.select(named(original, "conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("o").join(known.alias("k"), F.col("o.conv_id").eqNullSafe(F.col("k.conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    blank = {c: F.coalesce(F.col(f"k.{c}"), F.lit(0).cast("long")) for c in SUMMARY[:-1]} | {"audit": F.coalesce("k.audit", F.lit("")), "repaired_sha256": F.coalesce("k.repaired_sha256", F.lit(empty))}
    return joined.select(F.col("o.conv_id").alias("conv_id"), *[c.alias(n) for n, c in blank.items()])
