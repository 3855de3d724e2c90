"""Resolution as a stream: the rows of the batch query after the last batch, after a killed batch and after a restart."""

import os
import re

import duckdb
import pytest

from attestra.operators.versions import Table
from attestra.plans import derived, resolution
from attestra.plans.resolution_sql import ORACLES

DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_killed_and_restarted(spark, tmp_path, monkeypatch):
    customers = spark.read.parquet(f"{DIR}/customer.parquet")
    arrive = lambda condition: customers.where(condition).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    relation = lambda name: derived.frame(spark, DIR, name)
    resolver = resolution.Resolver(relation("listings_raw"), relation("signals_raw"), relation("verdicts_raw"))
    results, calls = Table(spark, str(tmp_path / "rows"), ["query_id"], []), []
    resolve = resolver.resolve
    monkeypatch.setattr(resolver, "resolve", lambda raw: calls.append(raw.count()) or resolve(raw))

    def run(place="state"):
        stream = spark.readStream.schema(customers.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        resolution.resolve_stream(derived.shape(stream, "requests_raw"), resolver, results, f"{tmp_path}/{place}")

    arrive("c_custkey % 3 = 0")
    run()
    first = results.read().count()
    arrive("c_custkey % 3 <> 0")
    with monkeypatch.context() as m:
        m.setattr(resolver, "resolve", lambda raw: calls.append(raw.count()) or results.read())  # any rows will do
        m.setattr(results, "publish", lambda manifest: 1 / 0)  # the job dies before the manifest is written
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run()
    assert results.read().count() == first == calls[0] and results.versions() == [1]
    run()  # from the checkpoint: the second batch only
    assert calls == [first, customers.count() - first, customers.count() - first]
    run()  # nothing new
    run("lost-checkpoint")  # all batches again: none is resolved twice
    assert len(calls) == 3 and results.versions() == [1, 2]
    con = duckdb.connect()
    for t in ("part", "customer", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLES["resolve_queries"])
    got = results.read().select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_an_empty_batch_and_requests_without_signals(spark):
    relation = lambda name: derived.frame(spark, DIR, name)
    resolver = resolution.Resolver(relation("listings_raw").limit(3), relation("signals_raw").limit(0), relation("verdicts_raw").limit(0))
    blank = relation("requests_raw").where("NOT seen").limit(1).selectExpr("query_id", "CAST(NULL AS STRING) AS title", "* EXCEPT (query_id, title)")
    [row] = resolver.resolve(blank).collect()
    assert (row.status, row.failure, row.confidence, row.style_code) == ("unresolved", "NO_CANDIDATES", 0.0, None)
    assert resolver.resolve(blank.limit(0)).count() == 0


def test_a_batch_keeps_one_row_a_request(spark, tmp_path, monkeypatch):
    """What a batch writes are its signals, what they come to and its catalogue's evidence: no table of scored candidates, nor a shuffle of them by code."""
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(40).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    relation = lambda name: derived.frame(spark, str(tmp_path), name)
    resolver = resolution.Resolver(relation("listings_raw"), relation("signals_raw"), relation("verdicts_raw"))
    tables, written = {}, resolution.written

    def kept(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L, style_code#\d+, \d", plan) or "c_model" not in plan
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(resolution, "written", kept)
    assert resolver.resolve(relation("requests_raw")).count() == 40
    assert {name for name, df in tables.items() if "score" in df.columns} == set() and tables["standings"].count() <= 40
