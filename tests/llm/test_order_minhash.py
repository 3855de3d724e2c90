import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from attestra.llm import order_minhash as om


def u64(x):
    return x & (2**64 - 1)


def s64(x):
    return x - 2**64 if x >= 2**63 else x


def fold(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return s64(h)


def signature(text):
    """By its definition: the minima of all numbered k-mers in each bucket, in text order."""
    hs = [struct.pack("<q", fold([w.encode()])) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not hs:
        return [0] * om.BUCKETS
    seen, items = Counter(), []
    for i in range(max(len(hs) - om.K + 1, 1)):
        h = fold(hs[i : i + om.K])
        items.append((fold([struct.pack("<q", h), struct.pack("<i", seen[h])]), i))
        seen[h] += 1
    out = []
    for b in range(om.BUCKETS):
        own = sorted(x for x in items if x[0] % om.BUCKETS == b)[: om.PICKS]
        t = fold(struct.pack("<q", v) for v, _ in sorted(own, key=lambda x: x[1])) & 0x7FFFFFFF
        out.append(max(t, 1) if own else 0)
    return out


def likeness(a, b):
    filled = sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True))
    return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / filled if filled else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), fold([(r[1] or "").encode()])))
    out = []
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = signature(t), signature(edited), signature(nxt)
        as_text = lambda f: "".join(f"{x:08x}" for x in f)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"wé{i}" for i in range(40)]
    texts = [None, "", " \n", "one", "two words", "\U0001f600 a b c"] + [" ".join(rng.choice(vocab) for _ in range(rng.choice([5, 50, 300, 2000]))) for _ in range(40)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "null id text here"), (None, None), (14, "same id other text"), (70, texts[10]), (70, texts[10])]
    return rows


def test_one_id_in_a_third_of_all_rows_is_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(om, "RANGE_BYTES", 400)
    monkeypatch.setattr(om, "QUANTILES", 9)
    monkeypatch.setattr(om, "STRETCH", 4)
    rng = random.Random(8)
    rows = [(70 if i % 3 == 0 else i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = om.fingerprints(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    bounds = [10, 40, 70, 70, 70, 100]
    ranges = docs.withColumn("text_hash", om.F.xxhash64("text")).where("doc_id = 70").select(om.id_range(bounds, 2)).distinct().count()
    assert ranges > 3


def test_null_ids_in_a_third_of_all_rows_are_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(om, "RANGE_BYTES", 400)
    monkeypatch.setattr(om, "QUANTILES", 9)
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i, "same text" if i % 9 == 0 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, om.fingerprints(docs).collect()), key=key) == sorted(brute(rows), key=key)
    hashed = docs.withColumn("text_hash", om.F.xxhash64("text")).where("doc_id IS NULL")
    for bounds in ([], [10, 40, 70]):
        assert hashed.select(om.id_range(bounds, 2, 8)).distinct().count() == 8


@pytest.mark.parametrize("size", [1 << 30, 20_000, 3_000])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(om, "RANGE_BYTES", size)
    monkeypatch.setattr(om, "QUANTILES", 7)
    rows = corpus()
    got = om.fingerprints(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, own string, range int").repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_one_document_empty_table_and_order_sensitivity(spark):
    schema = "doc_id long, text string"
    r = om.fingerprints(spark.createDataFrame([(5, "abc def ghi jkl")], schema)).first()
    assert r.near_next == 1.0 and r.n_chars == 15
    assert om.fingerprints(spark.createDataFrame([], schema)).count() == 0
    words = [f"w{i}" for i in range(600)]
    there, turned = " ".join(words), " ".join(words[300:] + words[:300])
    rows = {r.doc_id: r for r in om.fingerprints(spark.createDataFrame([(2, there), (1, turned)], schema)).collect()}
    # The k-mers of the two are nearly the same set; their order is not.
    assert rows[2].near_next < 0.8


def test_minima_are_those_of_all_kmers(spark):
    rng = random.Random(11)
    sizes = [190, 194, 195, 300, 1000, 4000]
    texts = [" ".join(f"w{rng.randrange(v)}" for _ in range(n)) for n in sizes for v in (3, 30, 100_000) for _ in range(3)] + ["same " * 5000, " ".join(f"w{i}" for i in range(100_000))]
    got = om.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == "".join(f"{x:08x}" for x in signature(texts[r.doc_id])), r.doc_id
