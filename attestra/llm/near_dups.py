"""Near-duplicates by HyperMinHash: compressed registers, banded, estimated with collision correction, verified on full sets.

Each bucket of a signature keeps the least hash of its own permutation as a leading-zero count plus mantissa bits (16 bits in all).
Rows of `BAND` registers are band keys. Documents with equal sets are one node from the start, so thousands of copies cost one
signature. In a band's bucket the members are compared with one leader first, the one that shares most buckets with others; the
components of these links are contracted. What is left are pairs of different components in a bucket. Buckets of up to `SMALL`
members give those pairs out. The members of larger ones are gathered into families, and there only the nodes outside the
family's largest component meet the rest, in blocks of bounded size that compare in place and give out no more links than they
have nodes. So every pair that shares a band key is compared or connected already, and a family of thousands of near copies gives
out rows in proportion to its members, not to their pairs.

Comparisons: estimates on registers come first (a margin of five standard deviations below the threshold), then exact overlap of
the full sets of 64-bit shingle hashes, shipped in blocks of bounded size, never a whole group to a task.

Defined cases: texts without words (null, empty, blank) have empty sets and link with nothing; fewer than five words make one
shingle; repeated rows and repeated ids are copies like others; null ids are ignored when the smallest id of a component is
taken (a component of null ids alone has none, and such rows are not kept); ties between equal estimates or counts go to the larger
node number, which changes the order of comparisons and never the components; empty tables give empty results; a very long text is
one set, held whole by the task that compares it; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, texts

WORDS_PER_SHINGLE = 5
PERCENT = 75
MANTISSA = 10
BAND = 4
BANDS = 32
BUCKETS = BAND * BANDS
#: Estimates below threshold - MARGIN are not verified: five standard deviations of a mean over BUCKETS trials.
MARGIN = 5 * (0.75 * 0.25 / BUCKETS) ** 0.5
#: Shingles of partners beside one copy of a leader's set, on average: 8 MB; and partners.
BLOCK, BLOCK_ROWS = 1 << 20, 512
#: Members of a bucket up to which its pairs are given out.
SMALL = 32
#: Shingles in one block of a family, on average: 4 MB; and nodes.
FAMILY_BLOCK, FAMILY_ROWS = 1 << 19, 512
WORD_CACHE = 500_000
#: Shingles sketched at a time: their arrays stay in the processor's cache.
SKETCH_WORDS = 1 << 16

_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, through a cache of bounded size."""
    try:
        return np.array([_words[w] for w in words], np.uint64)
    except KeyError:
        if len(_words) > WORD_CACHE:
            _words.clear()
        for w in set(words).difference(_words):
            _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([_words[w] for w in words], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; bytes.lower and bytes.split act on ASCII alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - k + 1)
    acc = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """A xor mask and an odd multiplier for each bucket, from a fixed rule."""
    seed = mix(np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64))
    return seed[:BUCKETS], seed[BUCKETS:] | np.uint64(1)


MASKS, MULTIPLIERS = permutations()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUCKETS 16-bit registers per non-empty set: leading zeros of the least hash, then its next MANTISSA bits."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    low, buf = np.empty((len(sets), BUCKETS), np.uint64), np.empty_like(flat)
    for j in range(BUCKETS):
        np.bitwise_xor(flat, MASKS[j], out=buf)
        np.multiply(buf, MULTIPLIERS[j], out=buf)
        low[:, j] = np.minimum.reduceat(buf, starts)
    # frexp of the hash gives its leading zeros and next bits; 53 bits of precision are more than a register keeps.
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = np.clip((fraction - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | mantissa


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that independent sets of n and m elements share a register: by leading-zero level, mantissas alike in one of 2^MANTISSA."""
    level = np.arange(1, 64)
    hi, lo = 2.0 ** -(level - 1), 2.0**-level
    inside = lambda k: (1 - lo)[None, :] ** k[:, None] - (1 - hi)[None, :] ** k[:, None]
    return (inside(n.astype(float)) * inside(m.astype(float))).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, corrected for chance collisions."""
    agree = (a == b).mean(1)
    c = chance(n, m)
    return (agree - c) / (1 - c)


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its registers; one pass, written."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, body = batch.column(0), batch.column(1)
            at = 0
            while at < len(body):
                sets, size, start = [], 0, at
                while at < len(body) and size < SKETCH_WORDS:
                    sets.append(shingles(body[at].as_py(), k))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                yield pa.record_batch(
                    [
                        ids.slice(start, at - start),
                        batch.column(2).slice(start, at - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "registers"],
                )

    df = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return materialize(df.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary"), "sketch")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): a hash of each band's registers and its number."""
    width = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * width + 1, F.lit(width))))
    return nodes.select("node", F.explode(keys).alias("key"))


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose corrected estimate comes near it: a, b, na, nb."""
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, BUCKETS)
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = pa.array(estimate(regs(batch.column(4)), regs(batch.column(5)), n, m) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], names=["a", "b", "na", "nb"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, na long, nb long")


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, set) for the nodes in wanted, made again from one text each, found by its id and hash; written."""
    keys = nodes.join(wanted, "node").select("node", "least.*").withColumn("key_id", F.coalesce("doc_id", F.lit(0))).select("node", "key_id", "text_hash")
    keyed = docs.withColumns({"key_id": F.coalesce("doc_id", F.lit(0)), "text_hash": F.xxhash64("text")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    # Only the keys are built into hash tables; texts stream by, and repeated rows leave one copy.
    found = keyed.join(keys.hint("shuffle_hash"), ["key_id", "text_hash"]).select("node", "text")
    return materialize(found.mapInArrow(run, "node long, set binary").dropDuplicates(["node"]), "sets", compression="uncompressed")


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of near (written) with 100 * intersection >= percent * union on full sets.

    A leader a with many partners is dealt to as many blocks as its partners' sets need, with a copy of its own set in each.
    """
    blocks = near.groupBy("a").agg(F.ceil(F.greatest(F.sum("nb") / BLOCK, F.count(F.lit(1)) / BLOCK_ROWS)).alias("blocks"))
    dealt = materialize(near.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "dealt")
    leaders = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "set")
    partners = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "set")

    def compare(group: pa.Table) -> pa.Table:
        names, sets = group["b"].to_pylist(), [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        lead = sets[names.index(None)]
        out = [b for b, other in zip(names, sets, strict=True) if b is not None and overlap(lead, other, percent)]
        return pa.table({"a": pa.array([group["a"][0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return leaders.unionByName(partners).groupBy("a", "block").applyInArrow(compare, "a long, b long")


def pairs_in_bands(regs: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (one of left, one of right) that share a band, each in its first shared band, at most about limit at a time."""
    keys = np.ascontiguousarray(regs).view(np.uint64)  # BAND registers of 16 bits are one number
    for band in range(BANDS):
        order = right[np.argsort(keys[right, band], kind="stable")]
        lo, hi = (np.searchsorted(keys[order, band], keys[left, band], side) for side in ("left", "right"))
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
            n = (hi - lo)[at:stop]
            x = np.repeat(left[at:stop], n)
            y = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)]
            first = (keys[x] == keys[y]).argmax(1) == band
            yield x[first], y[first]
            at = stop


def family_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a family. members: (family, node, label), written.

    Nodes outside the largest component (outer) and those inside are dealt to blocks by their sets' size; each block of outer
    nodes meets every block of the family once. A task holds two blocks and keeps only links that join what it has not yet joined.
    """
    least = percent / 100 - MARGIN
    main = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    sized = members.join(main, "family").join(nodes.select("node", "n_shingles", "registers"), "node").withColumn("outer", F.col("label") != F.col("main"))
    blocks = lambda side: F.ceil(F.greatest((F.sum(F.when(side, F.col("n_shingles")).otherwise(0)) + 1) / FAMILY_BLOCK, F.count_if(side) / FAMILY_ROWS)).cast("int")
    parts = sized.groupBy("family").agg(blocks(F.col("outer")).alias("n_outer"), blocks(~F.col("outer")).alias("n_inner"))
    dealt = sized.join(parts, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("n_outer")).otherwise(F.col("n_inner"))).cast("int"))
    task = lambda i, inner, j: F.struct(i.alias("i"), F.lit(inner).alias("inner"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = F.col("block")
    with_outer = F.transform(upto(F.col("n_outer")), lambda x: task(F.least(block, x), False, F.greatest(block, x)))
    with_inner = F.transform(upto(F.col("n_inner")), lambda x: task(block, True, x))
    of_inner = F.transform(upto(F.col("n_outer")), lambda x: task(x, True, block))
    tasks = F.when(F.col("outer"), F.concat(with_outer, with_inner)).otherwise(of_inner)
    rows = dealt.join(sets, "node").select("family", F.explode(tasks).alias("task"), "node", "label", "outer", "block", "n_shingles", "registers", "set").select("family", "task.*", "node", "label", "outer", "block", "n_shingles", "registers", "set")

    def compare(group: pa.Table) -> pa.Table:
        node, label, n = (group[c].to_numpy() for c in ("node", "label", "n_shingles"))
        outer, block = group["outer"].to_numpy(), group["block"].to_numpy()
        regs = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        full = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        inner, i, j = group["inner"][0].as_py(), group["i"][0].as_py(), group["j"][0].as_py()
        left = np.flatnonzero(outer & (block == i))
        right = np.flatnonzero(~outer) if inner else np.flatnonzero(outer & (block == j))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        out = []
        for x, y in pairs_in_bands(regs, left, right):
            keep = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[keep], y[keep]
            guess = estimate(regs[x], regs[y], n[x], n[y]) if len(x) else np.zeros(0)
            for at in np.argsort(-guess):
                if guess[at] < least:
                    break
                a, b = int(x[at]), int(y[at])
                ra, rb = root(int(label[a])), root(int(label[b]))
                if ra != rb and overlap(full[a], full[b], percent):
                    parent[ra] = rb
                    out.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("family", "i", "inner", "j").applyInArrow(compare, "a long, b long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for every node of links: label is the least node reachable. Alternating large and small stars, written each round.

    links: (a, b) written. The number of rounds follows the logarithm of the longest chain; groups are only ever aggregated.
    """
    def sign(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    before, now = None, sign(edges)
    while now != before:
        # Large star: neighbours larger than a node point to the least of the node and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        before, now = now, sign(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), name)


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, k: int = WORDS_PER_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    keyed = texts(docs, id_col, text_col)
    # Node: the documents of one shingle set, known by the set's 128-bit digest; its number is its place in the written table.
    seen = sketch(keyed, k=k)
    groups = seen.where(F.col("digest").isNotNull()).groupBy("digest")
    of_group = [F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")]
    nodes = materialize(groups.agg(*of_group).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = materialize(band_keys(nodes), "bands")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(bands.join(sizes, "key"), "buckets")
    known = buckets.groupBy("node").agg(F.sum("n").alias("known"))
    leads = materialize(buckets.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead")), "leads")
    star = buckets.join(leads, "key").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    # The full sets of all nodes that share a band key with another, made once for all comparisons below.
    sets = full_sets(buckets.select("node").distinct(), nodes, keyed, k)
    links = confirm(star, nodes, sets, percent, "star")
    labels = components(links)

    # Buckets that more than one component shares.
    label = F.coalesce("label", "node")
    shared = buckets.join(labels, "node", "left").select("key", "node", "n", label.alias("label"))
    mixed = shared.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
    mixed = materialize(shared.join(mixed, "key"), "mixed")
    small = mixed.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("label").alias("other"))
    pairs = small.withColumnRenamed("node", "a").join(other, "key").where("a < b AND label <> other").select("a", "b").distinct()
    pairs = materialize(pairs, "small")
    large = mixed.where(F.col("n") > SMALL)
    families = components(large.join(leads, "key").select(F.col("lead").alias("a"), F.col("node").alias("b")), "families").withColumnRenamed("label", "family")
    members = materialize(large.select("node", "label").distinct().join(families, "node"), "members")
    more = confirm(pairs, nodes, sets, percent, "small").union(materialize(family_links(members, nodes, sets, percent), "family-links"))
    labels = components(links.union(more), "labels")

    labelled = nodes.select("node", "digest", "least_id").join(labels, "node", "left").select("digest", "least_id", label.alias("label"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    final = materialize(labelled.join(least, "label").select("digest", "component_id"), "components")
    out = seen.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Candidate pairs through the estimate and the exact comparison; written."""
    near = materialize(estimated(pairs, nodes, percent), f"{name}-near")
    return materialize(verified(near, sets, percent), f"{name}-links")
