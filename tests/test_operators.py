import random
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from attestra.operators import knn, merge
from attestra.sources import pages
from attestra.streaming import state


def test_knn_equals_numpy(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(vectors)] + [(900, None, 1)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = defaultdict(list)
    for r in sorted(knn.nearest(df.where("vec_id < 7"), df, 4).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    v = vectors.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(7):
        s = v @ v[q]
        s[q] = -9
        assert got[q] == np.argsort(-s)[:4].tolist()
    one = knn.nearest(df.where("vec_id < 7"), df.coalesce(1), 4)
    assert sorted(map(tuple, one.select("query_id", "rank", "vec_id").collect())) == [(q, i + 1, v) for q in range(7) for i, v in enumerate(got[q])]
    key = lambda r: tuple(r)
    whole, parts = knn.nearest(df, df, 4), knn.nearest(df, df, 4, query_bytes=3000, vector_bytes=5000)
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key) and whole.count() == 1200
    other = knn.nearest(df, df.repartition(5, "embedding"), 4, query_bytes=1 << 30, vector_bytes=2000)
    assert sorted(other.collect(), key=key) == sorted(whole.collect(), key=key)


def test_knn_of_repeated_ids_and_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = knn.nearest(df.where("vec_id = 2"), df, 9).collect()
    assert sorted((r["rank"], r.vec_id, r.similarity) for r in got) == [(1, 1, 0.995037190), (2, 1, 0.995037190), (3, 1, 0.09950372)]


def test_similarity_to_owner(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8))
    label = rng.choice([1, 1, 1, 2, 3], 200)
    label[7] = 9  # alone
    df = spark.createDataFrame([(i, x.tolist(), int(o)) for i, (x, o) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.query_id: r.similarity for r in knn.similarity_to_owner(df, df, vector_bytes=1500).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.where((label[:, None] == label[None, :]) & ~np.eye(200, dtype=bool), u @ u.T, -2).max(1)
    assert got.keys() == set(range(200)) - {7} and all(abs(got[i] - s[i]) < 2e-9 for i in got)


def test_index_finds_nine_of_ten(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 24))
    v = centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 24))
    v[500:700] = v[500]  # a common vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 10 = 0")
    index = knn.Index(df)
    assert index.lists.select("id").distinct().count() == 1500
    exact = {(r.query_id, r.vec_id): r.similarity for r in knn.nearest(asked, df, 10).collect()}
    found = {(r.query_id, r.vec_id): r.similarity for r in index.search(asked, 10, vector_bytes=20_000).collect()}
    assert len(found) == 1500 and all(exact[p] == s for p, s in found.items() if p in exact)
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert {(r.query_id, r.vec_id): r.similarity for r in index.search(asked, 10, share=1.0).collect()} == exact
    assert knn.Index(df.limit(0)).search(asked, 10).count() == 0


def test_knn_of_equal_vectors_prefers_small_ids(spark):
    df = spark.createDataFrame([(i, [1.0, float(i == 5)], 0) for i in range(60)], "vec_id long, embedding array<double>, label int").repartition(7)
    got = sorted(tuple(r) for r in knn.nearest(df.where("vec_id = 3"), df, 3).select("rank", "vec_id").collect())
    assert got == [(1, 0), (2, 1), (3, 2)]
    assert knn.nearest(df.limit(0), df, 3).count() == 0 and knn.nearest(df, df.limit(0), 3).count() == 0


UPDATES = [
    # key, name, color, price, authoritative, ord
    ("A1", "", "white", 90.0, False, 1), ("A1", "Alpha", "", None, True, 2), ("A1", "Alpha two", "black", 95.0, False, 3),
    ("B2", "Beta", "", 10.0, False, 1), ("B2", "", "red", 12.0, True, 2), ("C3", "", "", None, False, 1),
]
CURRENT = [("A1", "old alpha", "", None), ("B2", "", "blue", 9.0), ("D4", "Delta", "tan", 40.0)]


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame(CURRENT, "key string, name string, color string, price double")
    updates = spark.createDataFrame(UPDATES, "key string, name string, color string, price double, authoritative boolean, ord long")
    once = merge.upsert(current, updates, "key", ["name", "color", "price"])
    twice = merge.upsert(once, updates, "key", ["name", "color", "price"])
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    assert {r.key: r.name for r in once.collect()}["A1"] == "Alpha"


def test_admission_does_not_count_refused(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4), f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ip long, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: r.admitted for r in state.admit(df, key="ip", time="at", row="id", most=3, window_s=60.0).collect()}
    held = defaultdict(deque)
    for i, ip, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        t = int(at[14:16]) * 60 + int(at[17:])
        while held[ip] and held[ip][0] <= t - 60:
            held[ip].popleft()
        ok = len(held[ip]) < 3
        if ok:
            held[ip].append(t)
        assert got[i] == ok


def test_jsonl_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"title":"a","tags":["gs"]}\n{"title":"b","tags":[]}\n')
    assert [r.title for r in pages.load_cases(spark, str(tmp_path / "c.jsonl"), "gs").collect()] == ["a"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streamed_latest_rows_are_files_not_driver_memory(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "some"))
    got = state.stream_latest(spark, "/root/testdata/sf0.001", "events.parquet")
    assert got.inputFiles()
    key = lambda r: r.user_id
    assert sorted(got.collect(), key=key) == sorted(state.latest_by_key(events).collect(), key=key)
    # Several files, and none.
    got = state.stream_latest(spark, str(tmp_path / "some"), "*.parquet")
    assert sorted(got.collect(), key=key) == sorted(state.latest_by_key(events).collect(), key=key)
    events.limit(0).write.parquet(str(tmp_path / "none"))
    assert state.stream_latest(spark, str(tmp_path / "none"), "*.parquet").count() == 0
