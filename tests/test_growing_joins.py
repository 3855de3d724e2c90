"""Relations that grow with the requests are joined by shuffle, however small Spark estimates them: none goes through the driver."""

import os
import re

from pyspark.sql import functions as F

from attestra.functions import models
from attestra.functions import text as tx
from attestra.operators import observe, records, relational, scoring
from attestra.operators.text_search import Index
from attestra.plans import derived, resolution
from attestra.plans.queries import QUERIES
from attestra.session import written


def broadcasts(df):
    return re.findall(r"Broadcast\w*Join", df._jdf.queryExecution().executedPlan().toString())


def test_candidates_and_observations(spark):
    keys = written(spark.range(50).select(F.col("id").alias("query_id"), F.lit("DD000010").alias("style_code")), "keys")
    observed = written(keys.select("query_id", F.lit("Nike").alias("brand")), "observed")
    web = keys.withColumns({"agreement": F.lit(1), "trust": F.lit(0.5)})
    paired = scoring.pair(keys, observed, web)
    assert not broadcasts(paired)
    assert paired.count() == 50


def test_verdicts_and_leaders(spark):
    keys = written(spark.range(50).select(F.col("id").alias("query_id"), F.lit("DD000010").alias("style_code")), "keys")
    scored = keys.withColumns({"score": F.lit(0.5), "rejected": F.lit(False), "rejection_reason": F.lit(""), "contradictions": F.array().cast("array<string>")})
    told = keys.select("query_id", "style_code", F.lit("same").alias("verdict"), F.lit(0.9).alias("confidence"), F.array(F.lit("note")).alias("contradictions"))
    assert not broadcasts(scoring.verify(scored, told))
    leaders = keys.select("query_id", "style_code", F.lit("").alias("o_model"), F.lit("").alias("o_model_name"))
    listed = spark.createDataFrame([("DD000010", "p1", "Nike Dunk Low", "Nike Dunk Low", False)], "style_code string, product_id string, title string, model string, ambiguous boolean")
    confirmed = scoring.confirm(leaders, listed)
    assert not broadcasts(confirmed)
    assert confirmed.where("confirmed").count() == 50


def test_hits_and_titles(spark):
    raw = spark.createDataFrame([(f"p{i}", f"nike dunk {i}", f"DD{i:04d}-100") for i in range(30)], "product_id string, text string, style_id string")
    asks = written(spark.range(60).select(F.col("id").alias("query_id"), F.lit(0).alias("ask"), F.concat(F.lit("dunk "), F.col("id") % 30).alias("text")), "asks")
    hits = Index(raw, k=3).search(asks)
    # The asks themselves, a row each, are not sent to all tasks; lists of questions may be.
    assert "SortMergeJoin" in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.where("rank = 1").count() == 60
    titled = models.with_titles(asks, "text", None, "parsed")
    assert "BuildLeft" not in titled._jdf.queryExecution().executedPlan().toString()
    assert titled.where("parsed IS NOT NULL").count() == 60


def test_confirmed(spark):
    asked = written(spark.range(50).select(F.col("id").alias("query_id"), F.array().cast("array<string>").alias("labeled_codes")), "asked")
    judged = written(
        asked.select("query_id", F.lit("DD000010").alias("style_code"), F.lit(0.9).alias("score"), F.lit(False).alias("rejected"), F.lit("x").alias("name"), F.lit("").alias("colorway"), F.lit("").alias("model"), F.lit(1).alias("ord"))
        .withColumns({"verdict": F.lit("same"), "verdict_confidence": F.lit(0.9), "contradictions": F.array().cast("array<string>"), "c_model": F.lit(0.9), "c_colorway": F.lit(0.9)}),
        "judged",
    )
    decided = resolution.decide(asked, judged, judged.select("query_id", F.lit(True).alias("confirmed")))
    assert not broadcasts(decided)
    assert decided.where("status <> 'unresolved'").count() == 50


def test_small_files_are_spread(spark, tmp_path):
    """Rows derived from one small file are the work of as many tasks as a shuffle has, and codes of results are looked for once."""
    spark.range(40).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    results = derived.frame(spark, str(tmp_path), "results_raw")
    assert results.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert results.count() == 120
    found = records.discover(results)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 40


def test_listings_of_codes(spark, tmp_path):
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(40).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    assert not broadcasts(QUERIES["segment_join"](spark, str(tmp_path)))


EVIDENCE = "query_id long, style_code string, display string, kind string, detail string, weight double, similarity double, ord long"


def test_evidence_that_meets_by_query_is_the_pool_of_all(spark):
    one = [(1, "AB1", "AB1", "page_sku", "x", 0.9, None, 7), (1, "AB1", "A-B1", "page_sku", "x", 0.8, 0.7, 9), (1, "CD2", "C-D2", "web", "y", 0.5, 0.9, 9000), (2, "AB1", "AB1", "web", "y", 0.5, None, 1), (4, "", "", "web", "y", 0.5, None, 1)]
    other = [(1, "AB1", "AB-1", "catalog_search", "c", 0.2, None, 3), (1, "CD2", "CD-2", "catalog_search", "c", 0.2, None, 4000), (1, "EF3", "EF3", "catalog_search", "c", 0.2, None, 4100), (3, "AB1", "A B1", "catalog_search", "c", 0.2, 0.4, 2)]
    a, b = (spark.createDataFrame(r, EVIDENCE) for r in (one, other))
    by = lambda df, name: observe.by_query(observe.gathered(df), name)
    met = observe.met(by(a, "own").join(by(b, "listed"), "query_id", "full_outer"), "own", "listed")
    want = observe.pool(a.unionByName(b))
    assert met.columns == want.columns
    assert sorted(met.collect(), key=str) == sorted(want.collect(), key=str)


def test_the_catalogue_is_asked_once_for_equal_requests(spark, tmp_path, monkeypatch):
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(40).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    asked, search = [], Index.search
    monkeypatch.setattr(Index, "search", lambda self, asks: asked.append(asks.count()) or search(self, asks))
    few = resolution.requests(spark, str(tmp_path)).where("query_id IN (1, 2, 3)")
    many = few.withColumn("query_id", F.explode(F.sequence(F.col("query_id") * 100, F.col("query_id") * 100 + 19)))
    raw, none = derived.frame(spark, str(tmp_path), "listings_raw"), derived.frame(spark, str(tmp_path), "signals_raw").limit(0)
    pooled = resolution.pool(many, none, resolution.index(raw), raw)
    assert pooled.select("query_id").distinct().count() == 60
    assert asked and asked[0] <= 6


def test_texts_of_a_catalogue_are_cut_where_products_are_dealt(spark):
    raw = spark.createDataFrame([("p1", "nike dunk"), ("p2", ""), ("p3", None), (None, "nike")], "product_id string, text string")
    index = Index(raw.repartition(2, "product_id"))
    for table in (index.first, index.tokens):
        assert table.count() > 0
    assert "search-rows" in str(sorted(os.listdir(spark.conf.get("spark.checkpoint.dir"))))


def test_marks_of_colours_compare_as_their_tokens(spark):
    names = ["", "White/Black", "Black/White", "Off White/Black", "University Red", "Panda", "Reverse Panda", "Sail/Gum", "Core Black & Gold", "Bred", "nothing", "brass wolf bronze coconut milk og", "white white panda", None]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    x, y = tx.colour_tokens(F.col("a")), tx.colour_tokens(F.col("b"))
    got = rows.select("a", "b", tx.token_similarity(x, y).alias("tokens"), tx.mark_similarity(tx.marks(x), tx.marks(y)).alias("marks")).collect()
    assert [r for r in got if r.tokens != r.marks] == []
    assert len({r.marks for r in got}) > 4
    # Every token has a bit of its own, and a word holds them.
    assert sorted(w for names in tx.BITS for w in set(names)) == tx.KNOWN and max(map(len, tx.BITS)) < 64


def test_candidates_are_dealt_once(spark):
    """Candidates meet observations and what the web says in one shuffle; a code that the web names twice stays two rows."""
    keys = written(spark.range(50).select(F.col("id").alias("query_id"), F.lit("DD000010").alias("style_code")), "keys")
    observed = written(keys.select("query_id", F.lit("Nike").alias("brand")), "observed")
    web = keys.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("agreement"), F.lit(0.5).alias("trust")).where("query_id < 10 OR agreement = 3")
    paired = scoring.pair(keys, observed, written(web, "web"))
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert paired.count() == 60 and paired.where("web_agreement = 2 AND o_brand = 'Nike'").count() == 10
    assert not re.search(r"hashpartitioning\(query_id#\d+L, style_code", plan)


def test_colours_are_looked_at_once_for_each_text(spark, monkeypatch):
    """Marks are made for distinct texts, nulls as the empty text, and are those of each text by itself."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("White/Black", "Panda"), ("Panda", None), (None, ""), ("", "Sail/Gum")] * 25)], "id int, a string, b string")
    seen, marks = [], tx.marks
    monkeypatch.setattr(tx, "written", lambda df, name: seen.append(df.count()) or written(df, name))
    got = tx.with_marks(rows, {"x": "a", "y": "b"})
    assert seen == [4] and got.count() == 100 and got.columns == ["id", "a", "b", "x", "y"]
    wanted = lambda c: marks(tx.colour_tokens(F.col(c)))
    assert got.where(~F.col("x").eqNullSafe(wanted("a")) | ~F.col("y").eqNullSafe(wanted("b"))).count() == 0
    observed = observe.observe(resolution.shaped(derived.shape(spark.range(30).withColumnRenamed("id", "c_custkey"), "requests_raw")))
    assert observed.count() == 30 and len(seen) == 2 and seen[1] < 30


def test_candidates_of_a_query_meet_its_observation_as_one_row(spark):
    one = F.struct(F.lit("DD000010").alias("style_code"), F.lit(0.5).alias("similarity"))
    two = F.struct(F.lit("DD000011").alias("style_code"), F.lit(0.7).alias("similarity"))
    found = written(spark.range(50).select(F.col("id").alias("query_id"), F.array(one, two).alias("candidates")), "found")
    observed = written(found.select("query_id", F.lit("Nike").alias("brand")), "observed")
    web = written(found.where("query_id < 10").select("query_id", F.lit("DD000010").alias("style_code"), F.explode(F.array(F.lit(1), F.lit(2))).alias("agreement"), F.lit(0.5).alias("trust")), "web")
    paired = scoring.pair_by_query(found, observed, web)
    plain = scoring.pair(found.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*"), observed, web)
    assert paired.columns == plain.columns
    assert sorted(paired.collect(), key=str) == sorted(plain.collect(), key=str) and paired.count() == 110
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert not broadcasts(paired) and "Generate" in plan[: plan.index("SortMergeJoin")]


def test_keys_are_those_of_the_pool(spark, tmp_path):
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(60).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    keys, pool = (resolution.gathered(spark, str(tmp_path), step) for step in (resolution.keys, resolution.pool))
    assert sorted(keys.collect()) == sorted(pool.select("query_id", "style_code").collect())
    assert keys.count() > 60


def test_values_of_a_key_meet_rows_as_blocks(spark, tmp_path, monkeypatch):
    """A left join with repeated, null and unknown keys and null values; what crosses the join of listings are blocks of bounded size, dealt to all tasks."""
    monkeypatch.setattr(relational, "BLOCK", 3)
    rows = spark.createDataFrame([(i, k) for i in range(20) for k in ("a", "b", "none", None)], "query_id long, code string").withColumn("more", F.col("query_id") * 2)
    values = spark.createDataFrame([("a", f"p{i}") for i in range(50)] + [("b", None), ("b", "p1"), ("b", "p1"), (None, "p9"), ("other", "p3")], "code string, product_id string")
    got, want = relational.with_values(rows, values, "code", "product_id", "query_id"), rows.join(values, "code", "left").select(*rows.columns, "product_id")
    assert got.columns == want.columns and got.count() == 20 * (50 + 3 + 2)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(40).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    plan = QUERIES["segment_join"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan[: plan.index("SortMergeJoin")]


def test_candidates_are_not_dealt_after_their_query(spark, tmp_path):
    """Verdicts come along with the observation, and what is written of a query is one row: no join by query and code, no candidates in a table."""
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(40).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    judged = resolution.judged(spark, str(tmp_path))
    assert not re.search(r"hashpartitioning\(query_id#\d+L, style_code", judged._jdf.queryExecution().executedPlan().toString())
    stood = resolution.stood(judged)
    assert stood.count() == judged.select("query_id").distinct().count() < judged.count()
    # What only verdicts have is there: each meets the candidate of its code.
    told = resolution.verdicts(derived.frame(spark, str(tmp_path), "verdicts_raw"))
    plain = scoring.verify(scoring.contradict(resolution.scored(spark, str(tmp_path))), told)
    columns = ["query_id", "style_code", "verdict", "verdict_confidence", "contradictions", "score", "rejected", "rejection_reason"]
    assert judged.columns == plain.columns
    assert sorted(judged.select(columns).collect(), key=str) == sorted(plain.select(columns).collect(), key=str)


def test_standings(spark):
    """Order, runner-up, leader and codes by hand: ties by ord, the rejected last, rows of one code each shown, a query whose rows are all rejected."""
    schema = "query_id long, style_code string, score double, rejected boolean, ord long, name string, colorway string, model string, verdict string, verdict_confidence double, contradictions array<string>, c_model double, c_colorway double, display string, brand string, o_model string"
    row = lambda q, code, score, rejected, ord, name, verdict=None, notes=(): (q, code, score, rejected, ord, name, "", "", verdict, None, list(notes), 0.5, 0.5, f"{code}-1", "Nike", f"m{q}")
    rows = [
        row(1, "A", 0.9, False, 1, ""), row(1, "B", 0.8, False, 3, "b", "same", ["verifier:x"]), row(1, "C", 0.8, False, 2, "c"), row(1, "D", 1.0, True, 0, "d"),
        row(2, "A", 0.9, True, 1, "a"), row(3, "A", 0.4, False, 1, "a", "same"), row(3, "A", 0.4, False, 1, "a", "uncertain"),
    ]
    got = {r.query_id: r for r in scoring.standings(spark.createDataFrame(rows, schema).repartition(3), 3).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one.leader, one.top.style_code, one.top.score, one.top.dead, one.next_dead, one.next_score, one.next_verdict, one.candidates, one.o_model) == ("A", "C", 0.8, 0, 0, 0.8, "same", ["A", "C", "B"], "m1")
    assert [tuple(x) for x in one.own] == [("C", "C-1", "c", "Nike", "", "")] and one.top.clean and not one.top.doubted
    assert (two.leader, two.top.style_code, two.top.dead, two.next_dead, two.candidates, len(two.own)) == (None, "A", 2, None, ["A"], 1)
    assert (three.leader, three.top.verdict, three.next_verdict, three.candidates, len(three.own)) == ("A", "same", "uncertain", ["A", "A"], 2)
    every = scoring.standings(spark.createDataFrame(rows, schema), every=True).where("query_id = 1").first()
    assert sorted(x.style_code for x in every.own) == ["A", "B", "C", "D"] and every.candidates == ["A", "C", "B", "D"]
