"""WARC archives: records with chunked payloads, segmented where long, written as gzip members and read back by reassembly.

An archive is a table of gzip members, one row per member; members of one archive joined in order are a .warc.gz file, and such
files can be read into the same table. Reading goes by the records' own headers: whole records are decoded where they lie; only
segments are shuffled, still compressed, to be grouped by origin identifier, ordered by segment number, checked against the total
length and cleared of chunked transfer framing.

Defined cases: null payloads count as empty; null urls are written as an empty target; null page ids never win a response over a
page with an id, and among equal payloads without ids all are responses; repeated rows of the winning page are all responses;
empty tables give empty archives; a very long payload is as many segments as it needs, and is held whole by the task that puts
them together; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize

MEMBERS = "archive long, position long, member binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
CRLF = b"\r\n"
#: Blocks longer than this are cut into continuation records; framing chunks are of this size as well.
SEGMENT = 32 << 10
CHUNK = 8 << 10


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; a size line may carry extensions, trailers after the last chunk are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size:
            raise ValueError("chunk is cut short")
        out.append(part)
        at = end + 2 + size + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + CRLF * 2) + packer.flush()


def fields(head: bytes, encoding: str) -> dict[str, str]:
    """Headers after the first line, names lower-cased."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode(encoding).split("\r\n")[1:])}


def head_of(data: bytes) -> dict[str, str]:
    """Headers of a gzip member, which is inflated no further than to their end."""
    opener, raw = zlib.decompressobj(31), b""
    while CRLF * 2 not in raw:
        part = opener.decompress(opener.unconsumed_tail if raw else data, 1024)
        if not part:
            raise ValueError("record has no end of its headers")
        raw += part
    return fields(raw.partition(CRLF * 2)[0], "utf-8")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(CRLF * 2)
    headers = fields(head, "utf-8")
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("record is cut short")
    return headers, block


def write_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, segment: int = SEGMENT) -> DataFrame:
    """A table of MEMBERS: one response or revisit record per page, long ones followed by their continuations."""
    ship_package(pages.sparkSession)
    df = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    df = df.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    alike = df.where(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    winners = materialize(alike.where("n > 1").drop("n"), "warc-winners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rid = f"urn:attestra:{task}:{position}"
                sha = base32_sha1(payload)
                common = [("WARC-Record-ID", f"<{rid}>"), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Page-ID", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{sha}")]
                if winner is not None and winner != page_id:
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    rows.append((task, position, member([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:page:{winner}>")], http)))
                    position += 1
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                for k, part in enumerate(parts, 1):
                    kind = [("WARC-Type", "response"), *common] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{rid}:{k}>"), ("WARC-Segment-Origin-ID", f"<{rid}>")]
                    if len(parts) > 1:
                        kind.append(("WARC-Segment-Number", k))
                        if k == len(parts):
                            kind.append(("WARC-Segment-Total-Length", len(block)))
                    rows.append((task, position, member(kind, part)))
                    position += 1
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["archive", "position", "member"])

    # Equal payloads may hold a third of all rows; adaptive execution splits such a partition of this join.
    joined = df.select("page_id", "url", "payload", "digest", "size").join(winners, ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", "winner").mapInArrow(run, MEMBERS)


def read_files(files: DataFrame) -> DataFrame:
    """MEMBERS of .warc.gz files as read by format("binaryFile"): the gzip members are told apart by inflating."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, rest, position, archive = [], bytes(content), 0, zlib.crc32(path.encode())
                while rest:
                    opener = zlib.decompressobj(31)
                    opener.decompress(rest)
                    data, rest = rest[: len(rest) - len(opener.unused_data)], opener.unused_data
                    rows.append((archive, position, data))
                    position += 1
                yield pd.DataFrame(rows, columns=["archive", "position", "member"])

    return files.select("path", "content").mapInPandas(run, MEMBERS)


def decoded(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of RECORDS from the first segment's headers and the whole block; the digest is checked."""
    http, _, body = block.partition(CRLF * 2)
    sent = fields(http, "latin-1")
    told = headers["warc-payload-digest"].removeprefix("sha1:")
    refers = headers.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
    page = headers.get("warc-page-id", "")
    if headers["warc-type"] == "revisit":
        size, payload = int(sent["content-length"]), None
    else:
        payload = dechunk(body) if sent.get("transfer-encoding") == "chunked" else body
        size = len(payload)
        if base32_sha1(payload) != told:
            raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return (int(page) if page else None, headers.get("warc-target-uri"), headers["warc-type"], int(refers) if refers else None, size, told, payload if with_payload else None)


def reassemble(parts: list[tuple[int, bytes]], with_payload: bool = True) -> tuple:
    """One record from the gzip members of its segments, in any order; the total length is verified."""
    opened = [(n, *parse(data)) for n, data in sorted(parts)]
    if [n for n, _, _ in opened] != list(range(1, len(opened) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(b for _, _, b in opened)
    if int(opened[-1][1].get("warc-segment-total-length", -1)) != len(block):
        raise ValueError("segments do not add up to the total length")
    return decoded(opened[0][1], block, with_payload)


def read_records(members: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """RECORDS of a table of MEMBERS."""
    ship_package(members.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.strip().split(" ")[0] for c in RECORDS.split(",")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that their headers call no segments."""
        for batch in batches:
            yield table([decoded(*parse(data), with_payload) for data in batch.column(0).to_pylist() if "warc-segment-number" not in head_of(data)])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments under their origin, which for a first segment is its own identifier."""
        for batch in batches:
            rows = []
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = head_of(data)
                if "warc-segment-number" in h:
                    rows.append((archive, h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), data))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))]
            yield pa.record_batch(columns, names=["archive", "origin_id", "segment", "member"])

    def grouped(parts: pa.Table) -> pa.Table:
        # A group is one record, as large as its longest page and no larger.
        return pa.Table.from_batches([table([reassemble(list(zip(parts["segment"].to_pylist(), parts["member"].to_pylist(), strict=True)), with_payload)])])

    split = members.select("archive", "member").mapInArrow(segments, "archive long, origin_id string, segment int, member binary")
    return members.select("member").mapInArrow(whole, RECORDS).unionByName(split.groupBy("archive", "origin_id").applyInArrow(grouped, RECORDS))


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write pages to archives in the shared folder and read all records back, without their payloads."""
    return read_records(materialize(write_records(pages, **options), "warc", compression="uncompressed"), with_payload=False)
