"""Fill-in-middle examples by overlapping-chunk decomposition.

A text is cut between tokens, at two ranks of its token boundaries. Whether a boundary follows a byte is told by that byte and the
next one alone, so the bytes of all texts of a batch are cut into chunks that overlap by one byte, and every chunk counts its
boundaries by itself. Prefix sums of the counts, text by text, say in which chunk each rank lies; only those chunks are looked at again,
for the place of the cut. Work is one vector pass over the bytes, in slabs of bounded size; nothing is shuffled.

The bytes are those of UTF-8: white space of the token pattern is ASCII, and no byte of a longer character looks like it.

Defined cases: a null text counts as empty and is plain with no tokens; a null id takes part in the hash as an empty string and
stays null; repeated rows give a row each, equal ones equal rows, and no rows are compared, so there are no ties (equal ranks
give an empty middle); empty tables give empty results; other columns, whatever their names, are not read. A very long text is
worked on whole, in the task that reads its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of the chunks that are looked at together.
CHUNK, SLAB = 1 << 14, 1 << 22


def boundaries(data: np.ndarray, ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For data[start:stop], whether a token ends with each byte; looks at one byte more. ends: places behind the last byte of a text, sorted.

    A token ends with a byte that is not white space and has white space behind it, and with the last byte of a text.
    """
    seen = data[start : stop + 1]
    space = (seen == 32) | ((seen - np.uint8(9)) < 5)
    out = ~space[: stop - start]
    out[: len(space) - 1] &= space[1:]
    last = ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, stop, "right")] - 1 - start
    out[last] = True
    return out


class Chunks:
    """Boundary counts of all chunks of a batch of texts; chunks never span two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, slab: int = SLAB):
        """offsets: n + 1 places of the texts in data."""
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        self.ends = offsets[1:][lengths > 0]
        per_text = -(-lengths // chunk)
        #: The first chunk of every text, and where each chunk starts.
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.starts = np.append(np.repeat(offsets[:-1], per_text) + place * chunk, offsets[-1])
        counts = np.zeros(len(self.starts) - 1, np.int64)
        at = 0
        while at < len(counts):  # a slab is as many whole chunks as fit
            upto = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + slab, "right")) - 1)
            found = boundaries(data, self.ends, self.starts[at], self.starts[upto])
            counts[at:upto] = np.add.reduceat(found, self.starts[at:upto] - self.starts[at], dtype=np.int64)
            at = upto
        #: Boundaries before each chunk, over the whole batch.
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tokens = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def cut(self, text: int, rank: int) -> int:
        """Where, in bytes from the text's start, its first `rank` tokens end."""
        if rank == 0:
            return 0
        wanted = self.before[self.first[text]] + rank
        chunk = int(np.searchsorted(self.before, wanted, "left")) - 1
        start = self.starts[chunk]
        inside = np.flatnonzero(boundaries(self.data, self.ends, start, self.starts[chunk + 1]))
        return int(start + inside[wanted - self.before[chunk] - 1] + 1 - self.offsets[text])


def characters(data: bytes | memoryview) -> int:
    """Code points: bytes that do not continue a character."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and the n + 1 places of its texts in them; nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def fill_in_middle(docs: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the example's text).

    Hashes of seed and id choose the two ranks, whether a text is cut at all, and in which order its parts stand. Texts that hold
    one of the three marks are left plain, so that every example can be taken apart again (restored).
    """
    ship_package(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            chunks = Chunks(data, offsets, chunk)
            h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
            n, whole = chunks.tokens, memoryview(data)
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            rows, held = [], 0
            at = 0
            for i in range(len(n)):
                text = bytes(whole[offsets[i] : offsets[i + 1]])
                if not text or h3[i] % 100 >= percent or any(m in text for m in marks):
                    rows.append(("plain", None, None, text))
                else:
                    a, b = chunks.cut(i, int(low[i])), chunks.cut(i, int(high[i]))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    p, s, m = marks
                    spm = h4[i] % 100 < spm_percent
                    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
                    rows.append(("spm" if spm else "psm", characters(prefix), characters(middle), out))
                held += len(text)
                if held >= SLAB or i + 1 == len(n):
                    form, pre, mid, out = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [batch.column(0).slice(at, len(rows)), pa.array(n[at : i + 1]), pa.array(form), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                    )
                    rows, held, at = [], 0, i + 1

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return texts(docs, id_col, text_col).select("doc_id", "text", *hashes).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of. No part holds a mark, and no mark can arise where a part and a mark meet, so each stands once."""
    middle, head = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    first = lambda mark: F.substring_index(F.substring(head, 4, 2**31 - 1), mark, 1)
    last = lambda mark: F.substring_index(head, mark, -1)
    psm = F.concat(first(SUFFIX), middle, last(SUFFIX))
    spm = F.concat(last(PREFIX), middle, first(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
