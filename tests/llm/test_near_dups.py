import random
import re

import numpy as np

from attestra.llm import near_dups


def sets_of(rows):
    out = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [None, "", "  \n", "one", "One", "a b c d", "a b c d e"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.choice([6, 8, 30, 120, 400]))]
        rows.append(" ".join(ws))
        for _ in range(rng.randrange(4)):
            ws = list(ws)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rows.append(" ".join(ws).upper() if rng.random() < 0.3 else " ".join(ws))
        rows.append(passage + " " + " ".join(rng.choice(vocab) for _ in range(20)))
    return rows


def test_equals_brute_force(spark):
    texts = corpus()
    rng = random.Random(9)
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[9]), (None, "only null ids here at all"), (ids[8], texts[8]), (ids[8], texts[20])]
    got = near_dups.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, label string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_chain_of_near_copies(spark):
    words = [f"t{i}" for i in range(1000)]
    rows = [(100 - i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(40)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_empty(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    for n, shared in ((40, 30), (2000, 1800), (20_000, 10_000)):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]])
        regs = near_dups.registers([np.unique(a), np.unique(b)])
        true = shared / (2 * n - shared)
        assert abs(near_dups.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0] - true) < 5 * (true * (1 - true) / near_dups.BUCKETS) ** 0.5


def test_family_of_many_near_copies(spark, monkeypatch):
    """Copies of one text with one to many words changed, so that most are alike to the original and few to each other."""
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "FAMILY_BLOCK", 4000)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randrange(12)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(ws)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_very_long_texts_and_columns_of_any_name(spark):
    words = [f"w{i % 5000}x{i // 7}" for i in range(60_000)]
    near = words[:55_000] + ["other"] * 5000
    rows = [(5, " ".join(words), 1, "d", 2), (3, " ".join(near), 1, "d", 2), (9, " ".join(reversed(words)), 1, "d", 2), (None, None, None, None, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest int, `x.y` string, registers int").repartition(3)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 3, False), (3, 3, True), (9, 9, True), (None, None, False)}
