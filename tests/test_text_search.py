"""Catalogue text search against a plain scoring of all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from attestra.operators import text_search


def plain(products, asks, k):
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    known = {(p, frozenset(words(t))) for p, t in products if p is not None and words(t)}
    df = Counter(w for _, ws in known for w in ws)
    impact = {w: round(1000 * math.log(1 + len(known) / n)) for w, n in df.items()}
    out = []
    for i, t in asks:
        scored = [(-sum(impact[w] for w in words(t) & ws), len(ws), p) for p, ws in known if words(t) & ws]
        out += [(i, p, -s, r) for r, (s, _, p) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,chunk", [(1, 3), (5, 7), (10, 10_000)])
def test_hits_equal_plain_scores(spark, k, chunk):
    r = random.Random(k)
    rare = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(r.sample(["nike", "nike", "dunk", "Low", "retro"], r.randint(0, 4)) + r.sample(rare, r.randint(0, 3)))
    products = [(f"p{i}", text()) for i in range(300)] + [(f"q{i}", "Nike Dunk LOW") for i in range(100)] + [(None, "nike w1"), ("p1", "a second text w2"), ("x", None), ("y", "--")]
    asks = [(i, text()) for i in range(60)] + [(100, "nike"), (101, "nike dunk low"), (102, None), (103, ""), (104, "unheard of"), (105, "nike unheard w3"), (106, "NIKE-dunk, low!")]
    index = text_search.Index(spark.createDataFrame(products, "product_id string, text string").repartition(3), k=k, chunk=chunk)
    got = index.search(spark.createDataFrame(asks, "i int, text string")).collect()
    assert sorted(((x.i, x.product_id, x.score, x["rank"]) for x in got), key=str) == plain(products, asks, k)
    assert text_search.Index(index.first.select("product_id", "sid").toDF("product_id", "text").limit(0)).search(spark.createDataFrame(asks, "i int, text string")).count() == 0


def test_common_words_are_not_looked_up(spark):
    """With enough products of a rarer word, the word that all have is no reason to look at them."""
    products = [(f"p{i}", "nike shoe" if i % 10 else "nike dunk shoe") for i in range(500)]
    index = text_search.Index(spark.createDataFrame(products, "product_id string, text string"), k=5)
    terms = index.ask(spark.createDataFrame([("nike dunk",)], "text string")).first().terms
    assert [t.token for t in terms] == ["dunk", "nike"] and terms[0].df == 50 and terms[1].impact < terms[0].impact
    assert [(r.product_id, r["rank"]) for r in sorted(index.search(spark.createDataFrame([(1, "nike dunk")], "i int, text string")).collect(), key=lambda r: r["rank"])] == [("p0", 1), ("p10", 2), ("p100", 3), ("p110", 4), ("p120", 5)]
