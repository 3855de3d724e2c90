"""Mixing to target weights: targets and flows against plain versions, quotas to the word, reruns, hot groups."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from attestra.llm import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, total):
    """Excess over three times the size goes back to those below, by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out = {s: Fraction(total * weight[s], sum(weight.values())) for s in names}
    while over := [s for s in names if out[s] > 3 * sizes[s]]:
        extra = sum(out[s] - 3 * sizes[s] for s in over)
        for s in over:
            out[s] = Fraction(3 * sizes[s])
        below = [s for s in names if out[s] < 3 * sizes[s]]
        for s in below:
            out[s] += extra * weight[s] / sum(weight[x] for x in below)
    return out


def test_targets():
    r = random.Random(1)
    for _ in range(300):
        sizes = {s: r.choice([0, 1, 5, 100, 10_000]) for s in r.sample(["a", "b", "c", "d", "B", "é", "", None], r.randint(1, 8))}
        total = sum(sizes.values())
        got = mixture.targets(sizes, total)
        assert got == plain_targets(sizes, total) and sum(got.values()) == total


def cheapest(patterns, quotas, most):
    """Smallest cost of the largest flow over all routings, by trying all."""
    options = []
    for members, size in patterns:
        ways = [w for w in itertools.product(range(most * size + 1), repeat=len(members)) if sum(w) <= most * size]
        options.append([(dict(zip(members, w, strict=True)), sum(max(0, sum(w) - k * size) for k in range(1, most))) for w in ways])
    best = None
    for choice in itertools.product(*options):
        got = Counter()
        for flow, _ in choice:
            got.update(flow)
        if all(got[s] <= quotas[s] for s in got):
            value = (-sum(got.values()), sum(c for _, c in choice))
            best = value if best is None else min(best, value)
    return best


def test_flow_is_largest_and_cheapest():
    r = random.Random(2)
    for _ in range(40):
        names = ["a", "b", None][: r.randint(1, 3)]
        patterns = [(r.sample(names, r.randint(1, min(2, len(names)))), r.randint(0, 2)) for _ in range(r.randint(1, 3))]
        quotas = {s: r.randint(0, 5) for s in names}
        flows = mixture.route(patterns, quotas, 2)
        given = Counter()
        for flow in flows:
            given.update(flow)
        assert all(given[s] <= quotas[s] for s in names) and all(v >= 0 for f in flows for v in f.values())
        amounts = [sum(f.values()) for f in flows]
        assert all(a <= 2 * size for a, (_, size) in zip(amounts, patterns, strict=True))
        cost = sum(max(0, a - size) for a, (_, size) in zip(amounts, patterns, strict=True))
        assert (-sum(amounts), cost) == cheapest(patterns, quotas, 2)


def documents(n, seed=3):
    r = random.Random(seed)
    source = lambda: r.choice(["hot"] * 6 + ["b", "c", "d", None, "É"])
    rows = [(i if r.random() < 0.8 else None, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 3, 30, 200]))), source()) for i in range(n)]
    rows += [(None, "same text here", "hot")] * (n // 2) + [(1, None, "b"), (2, "", None), (3, "x " * 20_000, "c")]
    return rows


SCHEMA = "doc_id long, text string, source string, size string, `h.u` int"


@pytest.mark.parametrize("few", [1, 40, 1 << 16])
def test_mix_meets_targets(spark, few):
    rows = documents(300)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = mixture.mix(df, few=few).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.members[0], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes, sum(sizes.values()))
    taken = Counter()
    for r in got:
        s = r.members[0]
        taken[s] += r.taken
        assert (r.source_size, r.target) == (sizes[s], float(want[s])) and 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    # every document of a source gets the copies that all can have; at most one of them is cut
    by = defaultdict(list)
    for r in got:
        if r["size"]:
            by[r.members[0]].append((r.taken // r["size"], r.taken % r["size"]))
    for found in by.values():
        assert max(c for c, _ in found) - min(c for c, _ in found) <= 1 and sum(rest > 0 for _, rest in found) <= 1
    again = mixture.mix(df.repartition(2, "text"), few=7).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    assert Counter(map(str, mixture.mix(df, seed=43).collect())) != Counter(map(str, got))


def test_texts_of_copies(spark):
    rows = documents(40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    mixed = mixture.mix(df, keep=True)
    words = Counter()
    for r in mixture.copies(mixed).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += r.taken
        assert r.doc["h.u"] == 1 and r.doc["size"] == "x"
    assert +words == +want


def test_overlapping_sources(spark):
    rows = [(1, "a b c d", ["x"]), (2, "a b c d", ["y", "x", "x"]), (3, "a b", None), (4, "a", []), (5, "c d e f g h", ["y"])]
    got = {r.doc_id: r for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()}
    # sizes: x 8, y 10, null 2; the total of 16 by weights 1, 2, 3; null stops at 6, and x and y share 10
    assert [got[i].target for i in (1, 3, 4, 5)] == pytest.approx([10 / 3, 6, 0, 20 / 3]) and got[2].target == pytest.approx(10)
    assert got[3].taken == 6 and got[4].taken == 0 and got[2].members == ["x", "y"]
    assert sum(got[i].taken for i in (1, 2, 5)) == 10  # one copy is enough for all three


def test_empty_and_wordless(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mix(none).count() == 0
    got = mixture.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], none.schema)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
