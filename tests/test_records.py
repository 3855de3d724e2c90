import json

from pyspark.sql import functions as F

from attestra.operators import catalog, records


def test_figures_and_median(spark):
    schema = "expected string, got string, ranked array<string>, status string, product_id string, expected_product_id string, ms long"
    rows = [("A-1", "A1", ["A1"], "high", "p", "p", 4), ("B-2", "X", ["X", "B2"], "medium", None, None, 1), ("C3", None, None, "unresolved", None, None, 3), ("D4", "D4", ["Q", "R", "S", "D4"], "high", "p", "q", 10)]
    r = records.measure(spark.createDataFrame(rows, schema)).first()
    assert (r.cases, r.top1, r.top3, r.confident, r.false_positives, r.unresolved, r.median_ms) == (4, 0.5, 0.5, 0.75, 0.25, 0.25, 3.5)
    assert round(r.exact_if_confident, 4) == 0.6667 and round(r.mapped_if_confident, 4) == 0.3333
    empty = records.measure(spark.createDataFrame([], schema)).first()
    assert empty.cases == 0 and empty.exact_if_confident is None and empty.median_ms is None


def test_targets_images_and_queue(spark):
    c = spark.createDataFrame([(1, "a", None, "n", "", 0.9, 1, 2, None), (1, "b", 0.8, "n", "", 0.8, 2, 1, "p"), (1, "c", None, "", "", 0.7, 3, 1, None), (1, "d", None, "n", "", 0.95, 4, 3, None)], "query_id long, style_code string, similarity double, name string, model string, raw_score double, ord long, priority long, product_id string")
    assert [r.style_code for r in records.without_photos(c, 5).orderBy("rank").collect()] == ["d", "a"]
    assert [r.style_code for r in records.lookups(c, 2).orderBy("rank").collect()] == ["c", "a"]
    images = spark.createDataFrame([(1, 1, "https://ebay.com/1", 900, 900), (1, 2, "https://www.nike.com/2", 100, 100), (1, 3, "https://goat.com/3", 500, 300), (1, 4, "https://x.org/4", None, None)], "query_id long, ord long, url string, width long, height long")
    assert [r.ord for r in records.rank_images(images).orderBy("rank").collect()] == [3, 2, 4, 1]
    photos = spark.createDataFrame([(1, 3, "h1", True), (1, 1, "h1", True), (1, 2, "h2", False), (1, 4, "h3", True)], "query_id long, ord long, sha256 string, decodable boolean")
    assert [r.sha256 for r in records.distinct_images(photos).orderBy("rank").collect()] == ["h1", "h3"]
    results = spark.createDataFrame([(1, "low", 0.7, 5, None, "name", None, [("x", True), ("y", False)], True, False), (2, "low", 0.7, 9, "t", "n", "Z", [], True, False), (3, "low", 0.7, 9, "t", "n", None, [("x", True)], True, True)],
        "query_id long, status string, confidence double, created_at long, title string, product_name string, style_code string, candidates array<struct<style_code:string,rejected:boolean>>, review_required boolean, reviewed boolean")
    assert [(r.query_id, r.title, r.top_candidate) for r in records.queue_items(results).collect()] == [(2, "t", "Z"), (1, "name", "y")]


def test_intake_reuse_and_short_circuit(spark):
    rows = [(1, "https://a/x", "t", ["h"]), (2, None, " ", None), (3, "ftp://a", "", None), (4, "", "t", None)]
    got = {r.query_id: r for r in records.intake(spark.createDataFrame(rows, "query_id long, product_url string, title string, image_hashes array<string>")).collect()}
    assert [(got[i].status, got[i].input_kind) for i in (1, 2, 3, 4)] == [("queued", "mixed"), ("error", "image"), ("error", "url"), ("queued", "image")]
    on, out = records.not_sneakers(spark.createDataFrame([(1, True), (2, False), (3, None)], "query_id long, v_is_sneaker boolean"))
    assert [r.query_id for r in on.orderBy("query_id").collect()] == [1, 3] and out.first().failures == "NOT_A_SNEAKER"


def test_catalogue_rows_variants_and_markets(spark):
    raw = [json.dumps({"productId": 7, "styleId": "A/B", "title": "T", "productAttributes": {"retailPrice": "$1,200"}}), json.dumps({"title": "no id"}), "{broken", None]
    got = catalog.products(spark.createDataFrame([(r,) for r in raw], "json string")).collect()
    assert [(r.product_id, r.style_id, r.retail_price, r.colorway) for r in got] == [("7", "A/B", 1200.0, "")]
    variants = [{"variantId": "v1", "sizeChart": {"defaultConversion": {"size": "6", "type": "US W"}}}, {"variantId": "v2", "variantValue": "W7", "sizeChart": {"defaultConversion": {"type": "us w"}}}, {"variantName": "none"}]
    sized = catalog.sizes(spark.createDataFrame([(json.dumps(v),) for v in variants], "json string"))
    assert sorted((r.variant_id, r.size) for r in sized.collect()) == [("v1", "W6"), ("v2", "W7")]
    rows = [{"variantId": "v1", "lowestAskAmount": "0", "standardMarketData": {"lowestAsk": "90"}}, {"variantId": "zz", "highestBidAmount": 50}, {"variantId": "v2"}, {"variantId": None, "variantValue": "9", "lowestAskAmount": "80"}]
    market = catalog.market(spark.createDataFrame([("p", json.dumps(r)) for r in rows], "product_id string, json string"), sized)
    assert sorted((r["size"], r.lowest_ask, r.highest_bid) for r in market.collect()) == [("9", 80.0, None), ("ANY", None, 50.0), ("W6", 90.0, None)]
    assert tuple(catalog.market_overview(market).first()) == ("p", 80.0, 50.0, 3)


def test_lines_and_deletes(spark, tmp_path):
    records.write_lines(spark.createDataFrame([(1, "é")], "a long, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":"é"}'
    products, images = spark.createDataFrame([("a",), ("b",)], "product_id string"), spark.createDataFrame([("a", 1), ("b", 2)], "product_id string, i long")
    left, kept = records.delete_products(products, images, spark.createDataFrame([("a",)], "product_id string"))
    assert [r.product_id for r in left.collect()] == ["b"] and [r.i for r in kept.collect()] == [2]
    final = spark.createDataFrame([("high", "A-1", "n", "b", "m", "c", "p", 1), ("low", "B-2", "n", "b", "m", "c", None, 2)], "status string, style_code string, product_name string, brand string, model string, colorway string, product_id string, query_id long")
    assert [(r.style_code, r.authoritative) for r in records.winners(final).collect()] == [("A1", True)]
    index = spark.createDataFrame([("a", "h1", 1)], "product_id string, image_hash string, ord long")
    grown = records.grow_index(index, spark.createDataFrame([("a", "h1", 5), ("a", "h2", 6), ("a", "h2", 7)], "product_id string, image_hash string, ord long"))
    assert [tuple(r) for r in grown.select("product_id", "image_hash", "ord").collect()] == [("a", "h2", 6)]
