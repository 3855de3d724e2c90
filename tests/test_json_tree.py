"""JSON trees as variants against the walk in plain Python."""

import json
import random

from attestra.functions import json_tree
from attestra.sources import pages


def tree(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([None, True, 3, -2.5, "text", "", "é\n"])
    if kind < 0.7:
        return {r.choice(["sku", "Style-Code", "a b", "x", "image", "é"]) + str(i): tree(r, depth - 1) for i in range(r.randint(0, 4))}
    return [tree(r, depth - 1) for _ in range(r.randint(0, 4))]


def test_members_equal_the_walk(spark):
    r = random.Random(2)
    trees = [tree(r, 5) for _ in range(60)] + [[{"k": i} for i in range(300)], {"deep": None}]
    deep = {"k0": 1}
    for i in range(1, 20):
        deep = {f"k{i}": deep}
    trees.append(deep)
    texts = [json.dumps(t, ensure_ascii=False) for t in trees]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "{broken"), (903, '{"a": 1, "a": 2}')]
    got = {}
    for x in json_tree.members(spark.createDataFrame(rows, "id long, j string").repartition(3), "id", "j").where("key IS NOT NULL").collect():
        got.setdefault(x.id, []).append((x.key, x.kind if x.kind != "scalar" else x.value))
    shown = lambda v: "object" if isinstance(v, dict) else "array" if isinstance(v, list) else None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    for i, t in enumerate(trees):
        assert sorted(got.get(i, []), key=str) == sorted(((k, shown(v)) for k, v in pages.walk(t)), key=str), (i, t)
    assert not {900, 901, 902, 903} & got.keys()
    assert json_tree.members(spark.createDataFrame([], "id long, j string"), "id", "j").count() == 0


def test_named_members(spark):
    rows = [(1, '{"SKU": " a1 ", "x": {"sku": "later"}}'), (2, '{"x": {"style - code": 7}, "sku": "  "}'), (3, '[{"sku": null}, {"sku": "b"}]')]
    got = json_tree.named(spark.createDataFrame(rows, "id long, j string"), "id", "j", ["sku", "stylecode"]).collect()
    assert sorted(map(tuple, got)) == [(1, "sku", "a1"), (2, "stylecode", "7"), (3, "sku", "b")]
