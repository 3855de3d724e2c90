import random
import re
import zlib
from collections import Counter
from math import ceil, log2, log10

import pytest

from attestra.llm import interpolation as lm

START, END = object(), object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def brute(rows):
    def counted(folds):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for i, t in rows:
            if fold(i) in folds:
                ts = tokens(t)
                uni.update(ts)
                for v, w in zip([START, *ts], ts):
                    bi[v, w] += 1
                    ctx[v] += 1
        return uni, bi, ctx

    bucket = lambda c: min(ceil(log2(c + 1)), lm.BUCKETS - 1)
    uni, bi, ctx = counted(set(range(2, 10)))
    n, v = sum(uni.values()), len(uni)
    events = [(bucket(ctx[a]), bi[a, w] / ctx[a] if ctx[a] else 0, uni[w] / max(n, 1), 1 / (v + 1)) for i, t in rows if fold(i) == 1 for a, w in zip([START, *tokens(t)], tokens(t))]
    weights = [[0, 0.5, 0.5]] + [[1 / 3] * 3 for _ in range(lm.BUCKETS - 1)]
    while True:
        sums = {}
        for b, *ps in events:
            e = [x * p for x, p in zip(weights[b], ps)]
            s = sums.setdefault(b, [0, 0, 0])
            for k in range(3):
                s[k] += e[k] / sum(e)
        before = [list(w) for w in weights]
        for b, s in sums.items():
            floor = [0.01 if b else 0, 0.01, 0.01]
            weights[b] = [(x + f) / (sum(s) + sum(floor)) for x, f in zip(s, floor)]
        if max(abs(x - y) for p, q in zip(before, weights) for x, y in zip(p, q)) < 1e-4:
            break
    uni, bi, ctx = counted(set(range(1, 10)))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        score = 0
        for a, w in zip([START, *ts], ts):
            l = weights[bucket(ctx[a])]
            score += log10(l[0] * (bi[a, w] / ctx[a] if ctx[a] else 0) + l[1] * uni[w] / max(n, 1) + l[2] / (v + 1))
        out.append((i, fold(i) == 0, len(ts), sum(uni[w] > 0 for w in ts), n, base, score))
    return out


def corpus(n=150):
    rng = random.Random(8)
    words = [f"W{i}" if i % 7 == 0 else f"wé{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(None, "null id"), (3, rows[3][1]), (1000, None), (1001, "\t\n"), (1002, "never seen words \x01start \x00end")]


def close(got, want):
    key = lambda r: (str(r[0]), r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == tuple(b)[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    close(lm.score(docs).collect(), brute(rows))


def test_batches_of_chunks_and_fine_ranges_agree(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_BYTES", 400)
    monkeypatch.setattr(lm, "COARSE_BITS", 2)
    monkeypatch.setattr(lm, "cut", lambda docs, cut=lm.cut: cut(docs.repartition(3)))
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, `a.b` string")
    assert lm.range_bits_of(lm.texts(docs)) > lm.COARSE_BITS
    close(lm.score(docs).collect(), brute(rows))


def test_a_very_long_text(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate([200_000, 30, 3, 100, 50, 60, 80, 20, 90, 40, 70])]
    close(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the cat sat on the mat", "a dog ran to the park", "we all saw it then"]) for _ in range(20))) for i in range(200)]
    held = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) / 2


def test_without_training_texts_and_empty(spark):
    rows = [(i, "a b") for i in range(40) if fold(i) == 0]
    close(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_chunks_agree(spark, monkeypatch):
    rows = corpus()
    chunk = lm.Chunk()
    for i, t in rows:
        chunk.add(i, t)
    opened = lm.Opened(dict(zip(("chunk", "slice", "ngram", "a", "b", "c", "d", "e"), chunk.row(0), strict=True)))
    assert opened.ids == [i for i, _ in rows]
    keys = [lm.unsqueeze_sorted(r[3]) for r in opened.blocks(0, 3)]
    assert all((k[1:] >= k[:-1]).all() for k in keys)
    assert sum(len(k) for k in keys) == len(opened.lay.word_order) + len(opened.lay.left)
