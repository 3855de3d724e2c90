"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by how often their context was seen.

p(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), where the weights l belong to the bucket of c(v), the frequency of
the context. One fold of the training texts is deleted from the counts; expectation-maximisation on its own n-grams finds the
weights; the counts that score are those of all training texts.

Plan: one pass cuts the corpus into chunks of bounded size (texts of the deleted fold apart from the rest), numbers the words
of each chunk and writes them. A chunk's distinct words and word pairs are dealt out as sorted hashes with counts, one block for
each hash range. Blocks of one range meet and are added up, and the sums go back to the chunks that asked. So the corpus crosses the
network as the distinct n-grams of chunks, a frequent word costs a few bytes a chunk, and no table of n-grams is held by one
task or broadcast; the number of ranges follows the size of the corpus. Where there are more ranges than `1 << COARSE_BITS`, a chunk's
blocks would become small and their number would grow with the square of the corpus: then blocks are cut by coarse ranges, batches of
chunks are added up first, the batches' sums meet by fine ranges, and the answers go back the same way. N-grams of the deleted fold
are reduced to rows of equal counts before the weights are learned, so a round of expectation-maximisation reads far less than the
corpus; rounds go on until no weight moves by `TOLERANCE`.

Defined cases: null and empty texts score their end token alone; a null id counts as the empty string when its fold is drawn;
repeated rows are learned and scored one by one, and no rows are ranked, so there are no ties; in an empty table nothing is learned or
scored; a very long text is one chunk, held whole; other columns, whatever their names, are not read. Words and pairs are compared by
64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, texts

FOLDS = 10
#: Of the folds, 0 is held out of training altogether; 1 is deleted from the counts while the weights are learned.
TEST_FOLD, DELETED_FOLD = 0, 1
#: Context buckets by powers of two of the context's frequency; bucket 0: context never seen.
BUCKETS = 64
#: Expectation-maximisation ends when no weight moves by as much.
TOLERANCE = 1e-4
CHUNK_BYTES = 8 << 20
#: Text behind one hash range.
RANGE_BYTES = 16 << 20
#: Of a range's number, the bits by which chunks cut their blocks: some hundred n-grams of a full chunk in each.
COARSE_BITS = 12

#: Words are hashed with seed 0; the start and the end of a text have seed 1.
MARK_START, MARK_END = xxhash.xxh3_64_intdigest(b"start", 1), xxhash.xxh3_64_intdigest(b"end", 1)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by byte planes: the planes of zeros that small numbers have cost nothing."""
    planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b), dtype=np.uint64)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Layout:
    """A chunk's words and pairs in the order of their hashes: the same when it is counted and when it is scored."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, hashes: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        context = np.concatenate([[0], flat[:-1]])
        context[starts] = 0
        code, self.token_pair = np.unique(context * len(hashes) + flat, return_inverse=True)
        self.left, self.right = code // len(hashes), code % len(hashes)
        keys = pair_hash(hashes[self.left], hashes[self.right])
        self.flat, self.context, self.starts = flat, context, starts
        self.word_order, self.pair_order = np.argsort(hashes, kind="stable"), np.argsort(keys, kind="stable")
        self.word_keys, self.pair_keys = hashes[self.word_order], keys[self.pair_order]


class Chunk:
    """Texts that are counted together: words numbered in order of first sight, 0 the start and 1 the end of a text."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number = self.number
        words = (text or "").encode().lower().split()
        out = [number.setdefault(w, len(number) + 2) for w in words]
        out.append(1)
        self.ids.append(doc_id)
        self.tokens.append(np.array(out, np.int32))
        self.size += len(text or "") + 1

    def row(self, chunk: int) -> tuple:
        """A row of CHUNKS: ids, which are null, lengths, tokens, hashes of the words."""
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        hashes = np.array([MARK_START, MARK_END, *map(xxhash.xxh3_64_intdigest, self.number)], np.uint64)
        ids = np.array([i or 0 for i in self.ids]).astype(np.int64).view(np.uint64)
        return (chunk, -1, 0, *map(squeeze, (ids, np.array([i is None for i in self.ids]), lengths, np.concatenate(self.tokens), hashes)))


class Opened:
    """A chunk's row, read again."""

    def __init__(self, row: dict):
        raw, null, lengths, flat, hashes = (unsqueeze(row[c]) for c in "abcde")
        self.ids = [None if x else i for i, x in zip(raw.view(np.int64).tolist(), null.tolist(), strict=True)]
        self.lengths = lengths.astype(np.int64)
        self.lay = Layout(flat.astype(np.int64), self.lengths, hashes)
        self.folds = [fold_of(i) for i in self.ids]

    def blocks(self, chunk: int, range_bits: int) -> list[tuple]:
        """Rows of CHUNKS, one per hash range and order: sorted keys, counts in training texts, counts as contexts."""
        lay = self.lay
        learned = np.repeat(np.array(self.folds) != TEST_FOLD, self.lengths)
        tally = lambda at, n: np.bincount(at[learned], minlength=n)
        words, contexts, pairs = tally(lay.flat, len(lay.word_order)), tally(lay.context, len(lay.word_order)), tally(lay.token_pair, len(lay.left))
        one = cut_by_range(chunk, 1, range_bits, lay.word_keys, words[lay.word_order], contexts[lay.word_order])
        return one + cut_by_range(chunk, 2, range_bits, lay.pair_keys, pairs[lay.pair_order], None)


def cut_by_range(chunk: int, order: int, range_bits: int, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray | None) -> list[tuple]:
    """Rows of CHUNKS for sorted keys, one for each range that has any."""
    owner = (keys >> np.uint64(64 - range_bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    block = lambda a, lo, hi: None if a is None else squeeze(a[lo:hi])
    return [(chunk, int(owner[lo]), order, squeeze_sorted(keys[lo:hi]), block(counts, lo, hi), block(contexts, lo, hi), None, None) for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True)]


CHUNKS = "chunk long, slice long, ngram int, a binary, b binary, c binary, d binary, e binary"
ANSWERS = CHUNKS + ", n long, n_kept long, v long, v_kept long"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def range_bits_of(docs: DataFrame) -> int:
    """Bits of the hash ranges' number, which follows the corpus' length."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return max(2, (total // RANGE_BYTES).bit_length())


def cut(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows of CHUNKS, written. Chunks of the deleted fold have odd numbers."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, open_chunks = TaskContext.get().partitionId() << 32, 0, [Chunk(), Chunk()]
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                odd = int(fold_of(doc_id) == DELETED_FOLD)
                open_chunks[odd].add(doc_id, text.as_py())
                if open_chunks[odd].size >= CHUNK_BYTES:
                    yield batch_of([open_chunks[odd].row(base + 2 * n + odd)], CHUNKS)
                    n, open_chunks[odd] = n + 1, Chunk()
        for odd, chunk in enumerate(open_chunks):
            if chunk.ids:
                yield batch_of([chunk.row(base + 2 * n + odd)], CHUNKS)

    return materialize(docs.mapInArrow(run, CHUNKS), "chunks", compression="uncompressed")


def deal(chunks: DataFrame, range_bits: int) -> DataFrame:
    """The n-gram blocks of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                yield batch_of(Opened(row).blocks(row["chunk"], range_bits), CHUNKS)

    return chunks.mapInArrow(run, CHUNKS)


def sum_ranges(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus counts of every n-gram, in the order of the block that asked; and each range's part of N and V.

    An answer holds a: counts of all training folds, b: those of words as contexts; for chunks of the deleted fold also c and d,
    the same without that fold.
    """

    def run(parts: pa.Table) -> pa.Table:
        chunks, slices = parts["chunk"].to_pylist(), parts["slice"].to_pylist()
        order = parts["ngram"][0].as_py()
        keys = [unsqueeze_sorted(b) for b in parts["a"].to_pylist()]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.repeat(np.array([c % 2 == 0 for c in chunks]), [len(k) for k in keys])

        def added(column: str) -> tuple[np.ndarray, np.ndarray]:
            own = np.concatenate([unsqueeze(b) for b in parts[column].to_pylist()]).astype(np.float64)
            total = np.bincount(inverse, own, len(every)).astype(np.int64)
            return total, np.bincount(inverse[kept], own[kept], len(every)).astype(np.int64)

        sums = [added("b")] + ([added("c")] if order == 1 else [])
        rows, at = [], 0
        for chunk, s, own in zip(chunks, slices, keys, strict=True):
            i = inverse[at : at + len(own)]
            at += len(own)
            full = [squeeze(t[i]) for t, _ in sums] + [None] * (2 - len(sums))
            less = [squeeze(k[i]) for _, k in sums] + [None] * (2 - len(sums)) if chunk % 2 else [None, None]
            rows.append((chunk, s, order, *full, *less, None, None, None, None, None))
        if order == 1:
            total, without = sums[0]
            rows.append((-1, 0, 0, None, None, None, None, None, int(total.sum()), int(without.sum()), int((total > 0).sum()), int((without > 0).sum())))
        return pa.Table.from_batches([batch_of(rows, ANSWERS)])

    # A group is one hash range of one order: about RANGE_BYTES of text stand behind it, and a hot n-gram has one entry a chunk.
    both = materialize(blocks.groupBy("slice", "ngram").applyInArrow(run, ANSWERS), "ngram-answers", compression="uncompressed")
    return both.where("chunk >= 0").drop("n", "n_kept", "v", "v_kept"), both.where("chunk < 0").select("n", "n_kept", "v", "v_kept")


def count_all(chunks: DataFrame, range_bits: int, coarse_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sum_ranges for the blocks of all chunks, in one step or, beyond coarse_bits, by batches of chunks."""
    coarse_bits = COARSE_BITS if coarse_bits is None else coarse_bits
    if range_bits <= coarse_bits:
        return sum_ranges(deal(chunks, range_bits))
    # A batch has as much of a coarse range as a fine range has of all chunks; even and odd chunks have batches of their own.
    batches = 1 << (range_bits - coarse_bits)
    batch = 2 * (F.col("slice") * batches + F.pmod(F.xxhash64("chunk"), F.lit(batches))) + F.col("chunk") % 2
    blocks = materialize(deal(chunks, coarse_bits), "blocks", compression="uncompressed").withColumn("batch", batch)

    def union(parts: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        keys = [unsqueeze_sorted(b) for b in parts["a"].to_pylist()]
        return (keys, *np.unique(np.concatenate(keys), return_inverse=True))

    def add_up(parts: pa.Table) -> pa.Table:
        order, (_, every, inverse) = parts["ngram"][0].as_py(), union(parts)
        total = lambda c: np.bincount(inverse, np.concatenate([unsqueeze(b) for b in parts[c].to_pylist()]).astype(np.float64), len(every)).astype(np.int64)
        return pa.Table.from_batches([batch_of(cut_by_range(parts["batch"][0].as_py(), order, range_bits, every, total("b"), total("c") if order == 1 else None), CHUNKS)])

    def hand_back(parts: pa.Table) -> pa.Table:
        asked, told = parts.filter(parts["asks"]), parts.filter(pc.invert(parts["asks"])).sort_by("slice")
        # Answers of a batch by rising range are those of its keys in their order.
        sums = [np.concatenate([unsqueeze(x) for x in told[c].to_pylist()]) if told[c][0].as_py() is not None else None for c in "abcd"]
        keys, _, inverse = union(asked)
        rows, at = [], 0
        for chunk, own_slice, own in zip(asked["chunk"].to_pylist(), asked["slice"].to_pylist(), keys, strict=True):
            i = inverse[at : at + len(own)]
            at += len(own)
            rows.append((chunk, own_slice, asked["ngram"][0].as_py(), *[None if s is None else squeeze(s[i]) for s in sums], None))
        return pa.Table.from_batches([batch_of(rows, CHUNKS)])

    answers, parts = sum_ranges(blocks.groupBy("batch", "ngram").applyInArrow(add_up, CHUNKS))
    asked = blocks.withColumn("asks", F.lit(True))
    told = answers.withColumns({"batch": F.col("chunk"), "asks": F.lit(False)}).select(*asked.columns)
    both = asked.unionByName(told).groupBy("batch", "ngram").applyInArrow(hand_back, CHUNKS)
    return materialize(both, "chunk-answers", compression="uncompressed"), parts


class Answered(Opened):
    """A chunk with the corpus' counts of its words, contexts and pairs; without: less the deleted fold."""

    def __init__(self, group: pa.Table):
        order = np.lexsort((group["slice"].to_numpy(), group["ngram"].to_numpy()))
        super().__init__(group.slice(int(order[0]), 1).to_pylist()[0])
        self.group, self.order = group, order[1:]

    def counts(self, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair's right word, its context and itself."""
        ngram = self.group["ngram"].to_numpy()

        def spread(order: int, column: str, rank: np.ndarray) -> np.ndarray:
            out, values = np.empty(len(rank), np.int64), self.group[column]
            out[rank] = np.concatenate([unsqueeze(values[int(i)].as_py()) for i in self.order if ngram[i] == order]).astype(np.int64)
            return out

        one, two = ("c", "d") if without else ("a", "b")
        lay = self.lay
        return spread(1, one, lay.word_order)[lay.right], spread(1, two, lay.word_order)[lay.left], spread(2, one, lay.pair_order)


def gather(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """A chunk's own row beside its answers, grouped by chunk; a chunk's size is bounded."""
    return chunks.unionByName(answers).groupBy("chunk")


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def heldout_rows(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(bucket, pair, context, word, n): deleted n-grams by their counts in the kept folds; rows of equal counts are added up."""

    def run(group: pa.Table) -> pa.Table:
        chunk = Answered(group)
        word, context, pair = chunk.counts(without=True)
        rows, inverse = np.unique(np.stack([pair, context, word], 1), axis=0, return_inverse=True)
        n = np.bincount(inverse.reshape(-1), np.bincount(chunk.lay.token_pair), len(rows)).astype(np.int64)
        return pa.table({"bucket": bucket_of(rows[:, 1]), "pair": rows[:, 0], "context": rows[:, 1], "word": rows[:, 2], "n": n})

    odd = F.col("chunk") % 2 == 1
    each = gather(chunks.where(odd), answers.where(odd)).applyInArrow(run, "bucket long, pair long, context long, word long, n long")
    return materialize(each.groupBy("bucket", "pair", "context", "word").agg(F.sum("n").alias("n")), "heldout")


def learn(heldout: DataFrame, n: int, v: int, tolerance: float = TOLERANCE) -> list[tuple[float, float, float]]:
    """(l2, l1, l0) for each context bucket by expectation-maximisation; only sums per bucket reach the driver."""
    weights = [(0.0, 1 / 2, 1 / 2), *[(1 / 3, 1 / 3, 1 / 3)] * (BUCKETS - 1)]
    moved = 1.0
    while moved >= tolerance:
        table = F.array(*[F.array(*map(F.lit, w)) for w in weights])
        w = table[F.col("bucket").cast("int")]
        parts = [
            w[0] * F.coalesce(F.try_divide(F.col("pair").cast("double"), F.col("context")), F.lit(0.0)),
            w[1] * F.col("word") / F.lit(max(n, 1)),
            w[2] / F.lit(v + 1.0),
        ]
        df = heldout.select("bucket", "n", *[p.alias(f"e{i}") for i, p in enumerate(parts)]).withColumn("all", F.expr("e0 + e1 + e2")).where(F.col("all") > 0)
        sums = df.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"e{i}") / F.col("all")).alias(f"s{i}") for i in range(3)]).collect()  # at most BUCKETS rows
        before, weights = weights, list(weights)
        for r in sums:
            total = r["s0"] + r["s1"] + r["s2"]
            # A hundredth of an event keeps the uniform part from vanishing where the deleted fold has few contexts.
            floor = (0.01 if r["bucket"] else 0.0, 0.01, 0.01)
            weights[r["bucket"]] = tuple((r[f"s{i}"] + x) / (total + sum(floor)) for i, x in enumerate(floor))
        moved = max(abs(a - b) for x, y in zip(before, weights, strict=True) for a, b in zip(x, y, strict=True))
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row of SCORES per document, by a model learned from the training folds of the same table."""
    df = texts(docs, id_col, text_col)
    range_bits = range_bits_of(df)
    chunks = cut(df)
    answers, parts = count_all(chunks, range_bits)
    n, n_kept, v, v_kept = (int(x or 0) for x in parts.agg(*[F.sum(c) for c in ("n", "n_kept", "v", "v_kept")]).first())
    weights = np.array(learn(heldout_rows(chunks, answers), n_kept, v_kept, tolerance))

    def run(group: pa.Table) -> pa.Table:
        chunk = Answered(group)
        word, context, pair = chunk.counts(without=False)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        w = weights[bucket_of(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        per_text = lambda x: np.add.reduceat(x[chunk.lay.token_pair], chunk.lay.starts)
        held = [f == TEST_FOLD for f in chunk.folds]
        columns = [chunk.ids, held, chunk.lengths.tolist(), per_text((word > 0).astype(np.int64)).tolist(), [n] * len(held), per_text(base).tolist(), per_text(np.log10(p)).tolist()]
        return pa.Table.from_batches([batch_of(list(zip(*columns, strict=True)), SCORES)])

    return gather(chunks, answers).applyInArrow(run, SCORES)
