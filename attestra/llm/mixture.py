"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are added up by the pattern of their sources; a flow then routes words from
patterns, through sources, to the sources' quotas. The first copy of a pattern's words costs nothing, each further copy costs more than
the one before (convex costs), up to a largest number of copies. Only the arcs into patterns have a cost, so shortest augmenting
paths come in the order of copies: a largest flow with one copy, augmented with the second, the third and so on, is the cheapest flow
for all convex costs at once. The network has a node a pattern and a source, none a document, and is solved on the driver.

Of a pattern's flow, every document gets the whole copies that all can have; for the rest documents are taken in seeded order, and the
one at which the rest ends gives its first words only, so that quotas are met to the word. Where the order ends is found by
refining ranges of the seeded hash: a sum per pattern and range, the range in which the rest ends, its sub-ranges, and so on, until few
rows are left. So no pattern is ever sorted or windowed as a whole, however many documents it has.

Defined cases: a null text counts as empty and has size 0, of which 0 is taken; a null source is a source, the last in order; a document
without sources (an empty array) is in no source and is not taken, its target is 0; null and repeated ids are told apart by their
texts, and rows equal in both are alike, some of which may be taken once more than others; ties of hash are broken among equal rows
only, so that reruns give the same rows; empty tables give empty results; other columns, whatever their names, are left alone. Very
long texts are counted whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORDS, materialize, named

#: Patterns are the driver's; a table with more of them is no mix of sources, and is refused.
MOST_PATTERNS = 1 << 16
#: Rows of a pattern that one window may order.
FEW = 1 << 12
HASH_BITS, DIGIT = 60, 10

Source = str | None


def source_order(name: Source) -> tuple:
    return (name is None, name or "")


def targets(sizes: dict[Source, int], total: int, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> dict[Source, Fraction]:
    """Words that each source is to give: weights, repeating in the order of names, share the total; a source stops at `most` times its size."""
    names = sorted(sizes, key=source_order)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[Source, Fraction] = {}
    while len(out) < len(names):
        left = [s for s in names if s not in out]
        rest, whole = total - sum(out.values()), sum(weight[s] for s in left)
        share = {s: Fraction(rest) * weight[s] / whole for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        out |= {s: Fraction(most * sizes[s]) for s in above} or share
    return out


class Network:
    """Largest flows by levels and blocking paths; capacities may be added between runs."""

    def __init__(self, nodes: int):
        self.at: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def levels(self, source: int, sink: int) -> list[int] | None:
        level = [-1] * len(self.at)
        level[source], queue = 0, deque([source])
        while queue:
            x = queue.popleft()
            for e in self.at[x]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level if level[sink] >= 0 else None

    def augment(self, source: int, sink: int) -> None:
        while (level := self.levels(source, sink)) is not None:
            place = [0] * len(self.at)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    width = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= width
                        self.left[e ^ 1] += width
                    full = next(i for i, e in enumerate(path) if not self.left[e])
                    node, path = self.to[path[full] ^ 1], path[:full]
                elif place[node] < len(self.at[node]):
                    e = self.at[node][place[node]]
                    if self.left[e] and level[self.to[e]] == level[node] + 1:
                        path.append(e)
                        node = self.to[e]
                    else:
                        place[node] += 1
                elif path:  # a dead end: not by this arc again
                    node = self.to[path.pop() ^ 1]
                    place[node] += 1
                else:
                    break


def route(patterns: Sequence[tuple[Sequence[Source], int]], quotas: dict[Source, int], most: int = 3) -> list[dict[Source, int]]:
    """For each pattern (its sources, its words), the words that it gives to each of its sources."""
    names = sorted(quotas, key=source_order)
    source, sink, first = 0, 1, 2 + len(patterns)
    net = Network(first + len(names))
    node = {s: first + i for i, s in enumerate(names)}
    for s in names:
        net.arc(node[s], sink, quotas[s])
    supply, given = [], []
    for i, (members, size) in enumerate(patterns):
        supply.append(net.arc(source, 2 + i, 0))
        given.append({s: net.arc(2 + i, node[s], most * size) for s in members})
    for _ in range(most):  # one more copy, dearer than those before
        for e, (_, size) in zip(supply, patterns, strict=True):
            net.left[e] += size
        net.augment(source, sink)
    return [{s: net.left[e ^ 1] for s, e in arcs.items()} for arcs in given]


def digits() -> list[Column]:
    """Digits of the place of a row in the seeded order, from the most significant on: those of its hash, then those of its row number."""
    part = lambda c, shift: F.shiftright(c, shift).bitwiseAND((1 << DIGIT) - 1)
    return [part("h", s) for s in range(HASH_BITS - DIGIT, -1, -DIGIT)] + [part("u", s) for s in range(6 * DIGIT, -1, -DIGIT)]


def ends(rows: DataFrame, wanted: dict[str, int], counts: dict[str, int], few: int = FEW) -> list[tuple[str, int, int, int]]:
    """(pattern, h, u, words): for each pattern, the row at which `wanted` words of it are reached in seeded order, and what it gives itself.

    rows: pattern, size, h, u. Every round sums one more digit of the order within the range known so far; the driver sees one
    row a pattern and round.
    """
    spark = rows.sparkSession
    order = digits()
    found = {p: ((), 0) for p, w in wanted.items() if w > 0}
    inside = "before < wanted AND wanted <= before + size"

    def within(depth: int) -> DataFrame:
        known = spark.createDataFrame([(p, wanted[p] - b, list(d)) for p, (d, b) in found.items()], "pattern string, wanted long, known array<long>")
        here = rows.join(F.broadcast(known), "pattern")
        return here.where(F.array(*order[:depth]) == F.col("known")) if depth else here

    depth = 0
    while found and depth < len(order) and max(counts[p] for p in found) > few:
        sums = within(depth).groupBy("pattern", "wanted", order[depth].alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        before = F.sum("size").over(Window.partitionBy("pattern").orderBy("digit")) - F.col("size")
        cut = sums.withColumn("before", before).where(inside).collect()  # one row a pattern
        found = {r.pattern: ((*found[r.pattern][0], r.digit), found[r.pattern][1] + r.before) for r in cut}
        counts = {r.pattern: r.n for r in cut}
        depth += 1
    if not found:
        return []
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "u")) - F.col("size")
    last = within(depth).withColumn("before", before).where(inside)
    return [(r.pattern, r.h, r.u, r.wanted - r.before) for r in last.collect()]  # one row a pattern


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 42, keep: bool = False, few: int = FEW, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, members, size, source_size, target, taken for every document; with keep also doc, a struct of all its columns.

    source_col is a string, or an array of strings for documents that belong to several sources. source_size and target are those of the
    document's source, or sums over its sources. taken is the number of words that the mix takes of it, repeats counted.
    """
    text = F.coalesce(named(docs, text_col), F.lit(""))
    source = named(docs, source_col)
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    members = F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string"))))) if many else F.array(source.cast("string"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(named(docs, id_col).cast("string"), F.lit("")), text))
    rows = docs.select(
        named(docs, id_col).cast("long").alias("doc_id"),
        members.alias("members"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
        F.monotonically_increasing_id().alias("u"),
        *([F.struct(*[named(docs, c) for c in docs.columns]).alias("doc")] if keep else []),
    ).withColumn("pattern", F.to_json(F.struct("members")))
    rows = materialize(rows, "sized")
    spark = docs.sparkSession

    sums = rows.groupBy("pattern", "members").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"documents have more than {MOST_PATTERNS} patterns of sources")
    sums.sort(key=lambda r: [source_order(s) for s in r.members])
    sizes: dict[Source, int] = {}
    for r in sums:
        for s in r.members:
            sizes[s] = sizes.get(s, 0) + r.size
    wish = targets(sizes, sum(r.size for r in sums if r.members), weights, most)
    flows = route([(r.members, r.size) for r in sums], {s: floor(t + Fraction(1, 2)) for s, t in wish.items()}, most)

    copies, rest = {}, {}
    for r, flow in zip(sums, flows, strict=True):
        copies[r.pattern], rest[r.pattern] = divmod(sum(flow.values()), r.size) if r.size else (0, 0)
    last = {p: (h, u, w) for p, h, u, w in ends(rows.select("pattern", "size", "h", "u"), rest, {r.pattern: r.n for r in sums}, few)}
    plan = [(r.pattern, sum(sizes[s] for s in r.members), float(sum(wish[s] for s in r.members)), copies[r.pattern], *last.get(r.pattern, (-1, -1, 0))) for r in sums]
    # At most MOST_PATTERNS rows.
    known = F.broadcast(spark.createDataFrame(plan, "pattern string, source_size long, target double, copies long, end_h long, end_u long, end_words long"))
    place, end = F.struct("h", "u"), F.struct(F.col("end_h").alias("h"), F.col("end_u").alias("u"))
    more = F.when(place < end, F.col("size")).when(place == end, F.col("end_words")).otherwise(0)
    taken = (F.col("copies") * F.col("size") + more).alias("taken")
    return rows.join(known, "pattern").select("doc_id", "members", "size", "source_size", "target", taken, *(["doc"] if keep else []))


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, copy, text: the texts of a mix with keep, one row a copy; the last copy ends where the words taken do."""
    n = F.ceil(F.try_divide("taken", "size"))
    each = mixed.where("taken > 0").select("doc_id", "size", "taken", F.col("doc")[text_col].alias("text"), F.explode(F.sequence(F.lit(1), n)).alias("copy"))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORDS}"), F.lit(0)), F.lit(1), words.cast("int")), "")
    return each.select("doc_id", "copy", F.when(words >= F.col("size"), F.col("text")).otherwise(cut).alias("text"))
