import base64
import hashlib
import random

import pytest

from attestra.llm import warc


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefg é\r\n<>") for _ in range(150_000))
    rows = [(1, "http://a/1", "x", 0), (2, "http://a/2", "x", 0), (9, None, "x", 0), (4, "u", None, 0), (5, "u", "", 0), (6, "u\nv", long, 0), (7, "u", long, 0), (8, "u", "solo é", 0), (None, "u", "x", 0), (3, "u", "z" * 40_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, member int").repartition(3)
    members = warc.materialize(warc.write_records(pages, segment=10_000), "t")
    got = {r.page_id: r for r in warc.read_records(members).collect()}
    assert len(got) == len(rows)
    best = {}
    for pid, _, html, _ in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if pid is None else pid)
    for pid, _, html, _ in rows:
        raw, r = (html or "").encode(), got[pid]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if best[html or ""] == pid:
            assert (r.record_type, r.refers_to) == ("response", None) and bytes(r.payload) == raw
        else:
            assert (r.record_type, r.refers_to) == ("revisit", best[html or ""])
    # The members of an archive are a .warc.gz file; read_files tells them apart again.
    for archive in {r.archive for r in members.select("archive").distinct().collect()}:
        own = sorted(members.where(members.archive == archive).collect(), key=lambda r: r.position)
        (tmp_path / f"{archive}.warc.gz").write_bytes(b"".join(bytes(r.member) for r in own))
    again = warc.read_records(warc.read_files(spark.read.format("binaryFile").load(str(tmp_path))))
    key = lambda r: (r.page_id or 0, r.record_type, r.payload_digest)
    assert sorted(map(key, again.collect())) == sorted(map(key, got.values()))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(pages, revisit_from=2).collect()} == {"response"}


def test_broken_records_are_refused():
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"abcdef"))]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abcdef", 4)
    first = warc.member([*head, ("WARC-Segment-Number", 1)], block[:60])
    last = warc.member([("WARC-Type", "continuation"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", len(block))], block[60:])
    assert warc.reassemble([(2, last), (1, first)])[6] == b"abcdef"
    with pytest.raises(ValueError):
        warc.reassemble([(2, last)])
    with pytest.raises(ValueError):
        warc.reassemble([(1, first), (2, warc.member([("WARC-Segment-Total-Length", len(block) + 1)], block[60:]))])
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
