"""Byte-level BPE by a segment tree over adjacent pair ranks.

Each piece of a text (the public pre-tokenizer's pattern) holds its symbols in a row and a segment tree over the ranks of its
adjacent pairs. The root is the leftmost lowest-ranked pair: it is merged, the two or three pairs beside it get new ranks by
point updates of logarithmic cost, and this goes on until the root says that no pair can merge. Many pieces are merged in step:
row i of every array below is piece i, so one numpy operation advances all trees of a size class at once. A size class of few
pieces, such as one unbroken run of a million letters, gains nothing by that: each of its pieces has a tree in plain arrays.

Texts repeat their pieces, so each Python worker keeps the ids of pieces it has seen in a cache of bounded size; which pieces it
holds changes the time but never the result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: The pre-tokenizer's pattern (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without a character of UNLIKE, where the standard engine's classes agree; it is about twice as fast.
PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Anything but Latin letters, ASCII and common punctuation; of these, numerals that are no digits and separators are left out.
UNLIKE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]"
FREE = np.int64(2**62)
CACHE_PIECES = 700_000
#: Pieces longer than this many bytes are encoded but not cached, so the cache is bounded in bytes too.
CACHE_BYTES = 64
#: Size classes of fewer pieces are merged one piece after another.
FEW = 32
#: Symbols merged in step at a time: bounds the arrays whatever the number or length of pieces.
STEP_SYMBOLS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fold(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PairRanks.BITS)


class PairRanks:
    """(left id, right id) -> rank and merged id: open addressing over one numpy table."""

    BITS = 18

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        size = 1 << self.BITS
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, FREE, np.int64)
        self.out = np.full(size, -1, np.int64)
        for rank, ((a, b), m) in enumerate(zip(pairs, merged, strict=True)):
            k = (a << 20) | b
            at = int(fold(np.array([k], np.uint64))[0])
            while self.key[at] >= 0 and self.key[at] != k:
                at = (at + 1) % size
            if self.key[at] < 0:
                self.key[at], self.rank[at], self.out[at] = k, rank, m

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or that of an empty slot (rank FREE) where the pair never merges."""
        k = (a << 20) | b
        at = fold(k.view(np.uint64)).astype(np.int64)
        todo = np.flatnonzero((self.key[at] != k) & (self.key[at] >= 0))
        while todo.size:
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            todo = todo[(self.key[at[todo]] != k[todo]) & (self.key[at[todo]] >= 0)]
        return at


class ByteBPE:
    """A byte-level BPE vocabulary file: encode and decode whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pairs = PairRanks([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        # Pair to (rank, merged id) in one number, for pieces that are merged alone; the first rank of a pair holds.
        self.rank_of = {(vocab[a] << 20) | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.piece, self.plain, self.unlike = regex.compile(PATTERN), re.compile(PLAIN), re.compile(UNLIKE)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return (self.piece if self.unlike.search(text) else self.plain).findall(text)
        return [p for i, part in enumerate(self.split.split(text)) for p in ([part] if i % 2 else self.piece.findall(part))]

    def merge(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has; rows holds their first symbols, padded to a power of two."""
        n, width = rows.shape
        if width == 1:
            return rows[:, 0], np.ones(n, np.int64)
        sym, bits = rows.copy(), width.bit_length() - 1
        at = np.arange(width)
        right = np.broadcast_to(at + 1, (n, width)).copy()
        left = np.broadcast_to(at - 1, (n, width)).copy()
        right[right >= lengths[:, None]] = width  # no neighbour
        tree = np.full((n, 2 * width), FREE, np.int64)
        i, j = np.nonzero(at[None, :] + 1 < lengths[:, None])
        rank = self.pairs.rank[self.pairs.find(sym[i, j], sym[i, j + 1])]
        tree[i, width + j] = np.where(rank == FREE, FREE, (rank << bits) | j)
        for level in range(bits - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        alive = np.ones((n, width), bool) & (at[None, :] < lengths[:, None])
        rows_now = np.flatnonzero(tree[:, 1] != FREE)
        flat = tree.reshape(-1)

        def put(r: np.ndarray, j: np.ndarray, key: np.ndarray) -> None:
            node = r * (2 * width) + width + j
            base = r * (2 * width)
            flat[node] = key
            for _ in range(bits):
                off = node - base
                node = base + (off >> 1)
                flat[node] = np.minimum(flat[base + (off | 1)], flat[base + (off & ~np.int64(1))])

        def rerank(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """New key of the pair that starts at a, with b as its right symbol (width: none)."""
            some = b < width
            key = np.full(r.size, FREE, np.int64)
            rr, aa, bb = r[some], a[some], b[some]
            rank = self.pairs.rank[self.pairs.find(sym[rr, aa], sym[rr, bb])]
            key[some] = np.where(rank == FREE, FREE, (rank << bits) | aa)
            put(r, a, key)

        while rows_now.size:
            r = rows_now
            j = tree[r, 1] & (width - 1)
            k = right[r, j]
            sym[r, j] = self.pairs.out[self.pairs.find(sym[r, j], sym[r, k])]
            alive[r, k] = False
            after = right[r, k]
            right[r, j] = after
            has = after < width
            left[r[has], after[has]] = j[has]
            put(r, k, np.full(r.size, FREE, np.int64))
            rerank(r, j, after)
            before = left[r, j]
            has = before >= 0
            rerank(r[has], before[has], j[has])
            rows_now = r[tree[r, 1] != FREE]
        return sym[alive], alive.sum(1)

    def merge_alone(self, piece: bytes) -> bytes:
        """Ids of one piece, by the same tree over arrays of 28 bytes a symbol."""
        n = len(piece)
        if n == 1:
            return np.uint32(self.of_byte[piece[0]]).tobytes()
        bits = (n - 1).bit_length()
        width, none, rank_of = 1 << bits, int(FREE), self.rank_of.get
        sym = array("i", self.of_byte[np.frombuffer(piece, np.uint8)].astype("i4").tobytes())
        left, right = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        tree = array("q", [none]) * (2 * width)

        def key(a: int, b: int) -> int:
            """Rank and place of the pair of symbols a and b; the lowest is the leftmost of the lowest rank."""
            found = rank_of((sym[a] << 20) | sym[b])
            return none if found is None else (found >> 20 << bits) | a

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            node >>= 1
            while node:
                x, y = tree[2 * node], tree[2 * node + 1]
                low = x if x < y else y
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        for at in range(n - 1):
            tree[width + at] = key(at, at + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (top := tree[1]) != none:
            a = top & (width - 1)
            b = right[a]
            sym[a] = rank_of((sym[a] << 20) | sym[b]) & 0xFFFFF
            after = right[a] = right[b]
            sym[b] = -1
            put(b, none)
            if after < n:
                left[after] = a
            put(a, key(a, after) if after < n else none)
            if left[a] >= 0:
                put(left[a], key(left[a], a))
        return np.array([x for x in sym if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for i, b in enumerate(raw):
            if pieces[i] in self.special:
                out[i] = np.uint32(self.special[pieces[i]]).tobytes()
            elif b:
                classes.setdefault(1 << (len(b) - 1).bit_length(), []).append(i)
        for width, own in classes.items():
            if len(own) < FEW:
                for i in own:
                    out[i] = self.merge_alone(raw[i])
                continue
            step = max(1, STEP_SYMBOLS // width)
            for s in range(0, len(own), step):
                part = own[s : s + step]
                lengths = np.array([len(raw[i]) for i in part])
                rows = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                merged, counts = self.merge(self.of_byte[rows], lengths)
                ids, ends = merged.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
                for i, start, end in zip(part, [0, *ends], ends, strict=False):
                    out[i] = ids[start:end]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [self.pieces(t) for t in texts]
        cache = self.cache
        new = {p for ps in cut for p in ps}.difference(cache)
        extra: dict[str, bytes] = {}
        if new:
            fresh = list(new)
            extra = dict(zip(fresh, self.encode_pieces(fresh), strict=True))
            if len(cache) + len(extra) > CACHE_PIECES:
                keep = {p: cache[p] for ps in cut for p in ps if p in cache}
                cache.clear()
                extra |= keep
            cache.update((p, v) for p, v in extra.items() if len(p) <= CACHE_BYTES)
        out = []
        for ps in cut:
            try:
                out.append(b"".join(map(cache.__getitem__, ps)))
            except KeyError:
                out.append(b"".join(extra[p] if p in extra else cache[p] for p in ps))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.names.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One vocabulary per worker and path."""
    return ByteBPE(path)


def small_batches(texts: Iterable[str | None], limit: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of texts of about limit characters, so that memory follows the longest text, not the number of rows."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
