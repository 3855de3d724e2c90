"""Committed tables: readers, repeated batches, killed commits, compaction."""

import pytest

from attestra.operators.versions import Table
from attestra.streaming import state

SCHEMA = "key string, name string, at long"


def test_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["key"], ["at"])
    with pytest.raises(ValueError, match="no version"):
        t.read()
    rows = lambda *rs: spark.createDataFrame(list(rs), SCHEMA)
    got = lambda v=None: sorted(map(tuple, t.read(v).collect()), key=str)
    assert t.commit(rows(("a", "one", 1), ("b", "two", 1), (None, "none", 1)), "first") == 1
    assert t.commit(rows(("a", "late", 5), ("a", "early", 2), ("c", "new", 1)).select("at", "name", "key"), "second") == 2
    assert t.commit(rows(("z", "again", 9)), "second") == 2  # the batch has been committed
    second = [("a", "late", 5), ("b", "two", 1), ("c", "new", 1), (None, "none", 1)]
    assert got() == sorted(second, key=str) and got(1) == sorted([("a", "one", 1), ("b", "two", 1), (None, "none", 1)], key=str)
    # A later folder wins whatever its order column says.
    assert t.commit(rows(("a", "older but later", 0)), "third") == 3
    assert ("a", "older but later", 0) in got()
    before = got()
    assert t.compact() == 4 and got() == before and len(t.manifest()["folders"]) == 1 and t.compact() == 4
    assert got(2) == sorted(second, key=str)  # old versions stay readable
    assert t.commit(rows(), "empty") == 5 and got() == before


def test_a_killed_commit_is_not_seen_and_may_be_repeated(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"), ["key"], ["at"])
    t.commit(spark.createDataFrame([("a", "one", 1)], SCHEMA), "first")

    def die(manifest):
        raise KeyboardInterrupt

    new = spark.createDataFrame([("a", "two", 2), ("b", "x", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(t, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            t.commit(new, "second")
    assert [tuple(r) for r in t.read().collect()] == [("a", "one", 1)] and t.versions() == [1]
    assert t.commit(new, "second") == 2 and t.commit(new, "second") == 2
    assert sorted(map(tuple, t.read().collect())) == [("a", "two", 2), ("b", "x", 1)]


def test_two_jobs_cannot_commit_one_version(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["key"], ["at"])
    now = t.manifest()
    t.commit(spark.createDataFrame([("a", "one", 1)], SCHEMA), "first")
    with pytest.raises(RuntimeError, match="another job"):
        t.publish(now | {"version": 1})


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["key"], ["at"])
    for i in range(3):
        spark.createDataFrame([("a", f"v{i}", i), (f"k{i}", "x", 0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.commit_stream(stream(), t, f"{tmp_path}/state")
    got = lambda: sorted(map(tuple, t.read().collect()))
    assert got() == [("a", "v2", 2), ("k0", "x", 0), ("k1", "x", 0), ("k2", "x", 0)] and t.manifest()["version"] == 3
    state.commit_stream(stream(), t, f"{tmp_path}/state")  # nothing new
    state.commit_stream(stream(), t, f"{tmp_path}/other-state")  # all again, as after a lost checkpoint
    assert t.manifest()["version"] == 3 and len(got()) == 4
