import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from attestra.llm import bpe, packing, tokens

PATH = tokens.vocabulary_path()


def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def samples():
    rng = random.Random(5)
    letters = "abcdefgh thénç  \n\t'sßあ😀#&|0123ABC"
    out = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "don't  stop\n\n now", "x" * 3000, "ab" * 700 + " " * 50 + "é" * 300, "\u0000​ "]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(200)]


def test_ids_equal_the_library():
    t, own = library(), bpe.ByteBPE(PATH)
    texts = samples()
    for text, blob in zip(texts, own.encode_batch(texts), strict=True):
        e = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(blob, "<u4").tolist() == e, text[:80]
        assert own.decode(np.array(e, np.int64)) == t.decode(e, skip_special_tokens=False)


def test_cache_of_any_size_gives_the_same_ids(monkeypatch):
    texts = samples()
    want = bpe.ByteBPE(PATH).encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    own = bpe.ByteBPE(PATH)
    assert [own.encode_batch([t])[0] for t in texts] == want


def test_long_unbroken_pieces_equal_the_library():
    t, own, rng = library(), bpe.ByteBPE(PATH), random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 33, 40_000) for letters in ("ab", "aehtns", " ", "é日本", "0123456789")]
    for text, blob in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(blob, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_spark_round_trip(spark):
    t, texts = library(), [None, *samples()]
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokens.round_trip(docs, PATH).collect()}
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(e)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, PATH), PATH).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)} | {None: "null id"}
    assert tokens.round_trip(docs.limit(0), PATH).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        cap = rng.randrange(1, 100)
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * m for s in sums for m in range(v + 1) if s + k * m <= cap}
        fill = packing.best_fill(counts, cap)
        assert sum(k * m for k, m in fill.items()) == max(sums)
        assert all(m <= counts[k] for k, m in fill.items())


def test_pack_covers_every_id_once(spark):
    t, texts = library(), [None, *samples(), *(["same text here"] * 40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, PATH).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    total = padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0 and len(by_seq) == total // 1024 + bin(total % 1024).count("1")
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plans_place_every_token_once_without_padding():
    rng = random.Random(2)
    shapes = [{600: 1000}, {1: 3}, {}, {1024: 5}, {1023: 7, 1024: 2}] + [{rng.randrange(1, 1025): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))} for _ in range(30)]
    for histogram in shapes:
        windows, parts = defaultdict(list), defaultdict(list)
        for piece, first, stop, skip, taken, each, base, offset in packing.plan_windows(histogram, 1024):
            for turn in range(stop - first):
                windows[base + turn // each].append((offset + turn % each * taken, taken))
                parts[piece, first + turn].append((skip, taken))
        for spans in (*windows.values(), *parts.values()):
            spans.sort()
            assert all(b[0] == a[0] + a[1] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        ends = lambda spans: sum(spans[-1])
        assert all(ends(x) == 1024 or ends(x) & (ends(x) - 1) == 0 for x in windows.values())
        assert sorted(parts) == [(k, i) for k in sorted(histogram) for i in range(histogram[k])] and all(ends(x) == k for (k, _), x in parts.items())


def test_pieces_of_a_very_long_text_beside_clashing_columns(spark):
    t, long = library(), "word and more 123 " * 60_000
    docs = spark.createDataFrame([(1, long, 5, 6, 7), (None, "tail", 1, 2, 3), (1, long, 5, 6, 7)], "doc_id long, text string, length int, `a.b` int, ids int")
    rows = packing.pack(docs, PATH, with_ids=False).collect()
    n = len(t.encode(long, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * n and {r.doc_tokens for r in rows if r.doc_id == 1} == {n}
    assert sum(r.length for r in rows if r.doc_id is None) == len(t.encode("tail", add_special_tokens=False).ids) + 1
