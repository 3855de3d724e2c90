"""Requests and their results as rows: intake, reuse of earlier results, targets of further work, reviews, metrics, and tables kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, urls
from ..session import growing, written
from .merge import exact_median, insert_absent, top_n
from .observe import filled, text

#: What each domain's word on a code is worth, by its last two labels; others count half (fixed values).
DOMAIN_TRUST = {
    "stockx.com": 1.0, "goat.com": 1.0, "flightclub.com": 0.9, "stadiumgoods.com": 0.9, "nike.com": 1.0, "adidas.com": 1.0, "newbalance.com": 1.0, "asics.com": 1.0, "converse.com": 1.0, "vans.com": 1.0,
    "puma.com": 1.0, "reebok.com": 1.0, "salomon.com": 1.0, "on.com": 1.0, "hoka.com": 1.0, "sneakernews.com": 0.8, "solecollector.com": 0.8, "kicksonfire.com": 0.7, "sneakerfiles.com": 0.7,
    "hypebeast.com": 0.7, "nicekicks.com": 0.7, "footlocker.com": 0.8, "finishline.com": 0.8, "jdsports.com": 0.7, "champssports.com": 0.7, "hibbett.com": 0.7, "dtlr.com": 0.7, "shoepalace.com": 0.7,
    "sneakersnstuff.com": 0.7, "kith.com": 0.7, "undefeated.com": 0.7, "extrabutterny.com": 0.7, "ebay.com": 0.4, "grailed.com": 0.4, "amazon.com": 0.3, "walmart.com": 0.2, "poshmark.com": 0.3,
}
DEFAULT_TRUST = 0.5
#: An image this large counts as a photo rather than a thumbnail (fixed values).
BIG_WIDTH, BIG_HEIGHT = 400, 300


def trust_of(domain: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DOMAIN_TRUST.items() for x in pair])
    return F.coalesce(F.try_element_at(table, domain), F.lit(DEFAULT_TRUST))


def intake(requests: DataFrame) -> DataFrame:
    """Rows to work on from requests (query_id, product_url, title, image_hashes): status, input_kind, cache_key and error.

    Without an image, an address or a title, or with an address that is not http(s), a row is refused.
    """
    images, url, title = F.coalesce("image_hashes", F.array().cast("array<string>")), text("product_url"), F.trim(text("title"))
    nothing = (F.size(images) == 0) & (url == "") & (title == "")
    odd = (url != "") & ~url.rlike("(?i)^https?://")
    kind = F.when((url != "") & (F.size(images) > 0), F.lit("mixed")).when(url != "", F.lit("url")).otherwise(F.lit("image"))
    error = F.when(nothing, F.lit("nothing to identify: neither image, address nor title")).when(odd, F.lit("no http(s) address")).otherwise(F.lit(""))
    return requests.select("query_id", F.when(error == "", F.lit("queued")).otherwise(F.lit("error")).alias("status"), kind.alias("input_kind"), urls.cache_key(images, url, title).alias("cache_key"), error.alias("error"))


def not_sneakers(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to go on with, and final rows of those whose photos show no sneaker: nothing further is done for them."""
    shown = F.coalesce("v_is_sneaker", F.lit(True))
    out = requests.where(~shown).select("query_id", F.lit("unresolved").alias("status"), F.lit(0.0).alias("confidence"), F.lit("NOT_A_SNEAKER").alias("failures"), F.lit(True).alias("review_required"))
    return requests.where(shown), out


def reuse(requests: DataFrame, results: DataFrame, *, days: int = 7) -> DataFrame:
    """query_id, result_id: the newest high or medium result of a request's cache_key, made at most `days` before the request.

    requests: query_id, cache_key, asked_at; results: result_id, cache_key, status, created_at. An equi-join on the key and an aggregate.
    """
    sure = results.where(F.col("status").isin("high", "medium")).select("cache_key", "result_id", "created_at")
    both = requests.join(sure, "cache_key").where((F.col("created_at") <= F.col("asked_at")) & (F.col("created_at") >= F.col("asked_at") - F.expr(f"INTERVAL {days} DAYS")))
    return both.groupBy("query_id").agg(F.max_by("result_id", F.struct("created_at", "result_id")).alias("result_id"))


def discover(results: DataFrame, hint: str | None = None, per_result: int = 2) -> DataFrame:
    """query_id, style_code, display, agreement, trust, domains, titles, first_ord of search results (query_id, ord, url, title, snippet).

    The two surest codes of each result count. A domain's trust counts once, at its first result that names the code, in full where it
    labels it and at 0.7 where not. Three aggregates with partial sums.
    """
    c = F.col
    domain = urls.domain(c("url"))
    found = codes.codes_in(F.concat_ws(" ", text("title"), text("snippet")), F.lit(hint or ""), F.lit(0.5))
    named = results.select("query_id", "ord", domain.alias("domain"), F.substring(text("title"), 1, 160).alias("shown"), F.slice(found, 1, per_result).alias("found"))
    rows = named.select("query_id", "ord", "domain", c("shown").alias("title"), F.posexplode("found").alias("i", "x"))
    rows = rows.select("query_id", "domain", "title", c("x.code").alias("style_code"), c("x.display").alias("display"), c("x.labeled").alias("labeled"), (c("ord") * per_result + c("i")).alias("ord"))
    # Written, as domains and titles both read it: codes are looked for once.
    rows = written(rows, "discovered")
    first = rows.groupBy("query_id", "style_code", "domain").agg(F.min_by("labeled", "ord").alias("labeled"), F.min_by("display", "ord").alias("display"), F.min("ord").alias("ord"))
    value = trust_of(c("domain")) * F.when(c("labeled"), F.lit(1.0)).otherwise(F.lit(0.7))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ord", x))), lambda e: e[x])
    pool = first.groupBy("query_id", "style_code").agg(F.min_by("display", "ord").alias("display"), F.count(F.lit(1)).alias("agreement"), F.round(F.sum(value), 6).alias("trust"), in_order("domain").alias("domains"), F.min("ord").alias("first_ord"))
    titles = rows.where("title <> ''").groupBy("query_id", "style_code", "title").agg(F.min("ord").alias("ord")).groupBy("query_id", "style_code").agg(in_order("title").alias("titles"))
    return pool.join(growing(titles), ["query_id", "style_code"], "left")


def lookups(candidates: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` codes of each query, in the order of priority, that the catalogue has not named yet (product_id null)."""
    return top_n(candidates.where("product_id IS NULL"), ["query_id"], most, F.col("priority"), F.col("ord")).select("query_id", "style_code", "rank")


def to_verify(ranked: DataFrame, most: int = 3) -> DataFrame:
    """The best living candidates of each query (place from scoring.rank)."""
    return ranked.where(~F.col("rejected") & (F.col("place") <= most))


def without_photos(scored: DataFrame, most: int = 5) -> DataFrame:
    """Candidates for which a reference photo is worth looking for: the best named ones that no image was compared with."""
    named = (text("name") != "") | (text("model") != "")
    return top_n(scored.where(F.col("similarity").isNull() & named), ["query_id"], most, F.desc("raw_score"), F.col("ord")).select("query_id", "style_code", F.col("rank").cast("long").alias("rank"))


def rank_images(images: DataFrame, most: int = 6) -> DataFrame:
    """Image search results (query_id, ord, url, width, height), trusted domains first, then large ones, then as they came."""
    big = (F.coalesce("width", F.lit(0)) >= BIG_WIDTH) & (F.coalesce("height", F.lit(0)) >= BIG_HEIGHT)
    return top_n(images, ["query_id"], most, F.desc(trust_of(urls.domain(F.col("url")))), F.desc(big), F.col("ord"))


def distinct_images(images: DataFrame, most: int = 6) -> DataFrame:
    """The first `most` different images of each query that can be decoded (query_id, ord, content or sha256, decodable)."""
    first = images.where("decodable").groupBy("query_id", "sha256").agg(F.min("ord").alias("ord"))
    return top_n(first, ["query_id"], most, F.col("ord")).select("query_id", "sha256", F.col("rank").cast("long").alias("rank"))


def queue_items(results: DataFrame, most: int = 50) -> DataFrame:
    """The newest rows that wait for a review, with the candidate shown first: the product's code, else the best living candidate, else the first."""
    c = F.col
    living = F.filter("candidates", lambda x: ~x["rejected"])
    top = filled(text("style_code"), text(F.coalesce(F.get(living, F.lit(0))["style_code"], F.get("candidates", F.lit(0))["style_code"])))
    rows = results.where("review_required AND NOT reviewed").select("query_id", "status", "confidence", "created_at", filled(text("title"), text("product_name")).alias("title"), top.alias("top_candidate"))
    return rows.orderBy(c("created_at").desc(), "query_id").limit(most)


def error_maps(failures: DataFrame) -> DataFrame:
    """query_id, codes (distinct, in order of first sight) and details (map of code to details in order) of failures (query_id, code, detail, ord)."""
    by_code = failures.groupBy("query_id", "code").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.when(text("detail") != "", F.struct("ord", F.substring("detail", 1, 300).alias("detail"))))).alias("told"))
    rows = by_code.withColumn("told", F.transform("told", lambda x: x["detail"]))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "code", "told")))
    out = rows.groupBy("query_id").agg(ordered.alias("x"))
    return out.select("query_id", F.transform("x", lambda e: e["code"]).alias("codes"), F.map_from_entries(F.transform(F.filter("x", lambda e: F.size(e["told"]) > 0), lambda e: F.struct(e["code"], e["told"]))).alias("details"))


def timings(stages: DataFrame) -> DataFrame:
    """query_id and a map of stage to milliseconds, in the order in which stages ended (query_id, stage, ms, ord); the last run of a stage counts."""
    last = stages.groupBy("query_id", "stage").agg(F.max_by(F.struct("ms", "ord"), "ord").alias("x")).select("query_id", "stage", "x.*")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "stage", "ms"))), lambda e: F.struct(e["stage"], e["ms"]))
    return last.groupBy("query_id").agg(F.map_from_entries(entries).alias("timings_ms"))


def measure(results: DataFrame) -> DataFrame:
    """One row of accuracy figures of results (expected, got, ranked, status, product_id, expected_product_id, ms), codes normalised.

    top1, top3 over all cases; exact and mapped among confident ones (null where there is none); false positives are confident and wrong.
    """
    c = F.col
    want, got = codes.normalize_code(c("expected")), codes.normalize_code(c("got"))
    sure, hit = c("status").isin("high", "medium"), want == got
    mapped = sure & hit & c("product_id").isNotNull() & ((text("expected_product_id") == "") | (c("product_id") == c("expected_product_id")))
    in_three = F.array_contains(F.slice(F.coalesce("ranked", F.array().cast("array<string>")), 1, 3), want)
    share = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), b), 6)
    n = F.count(F.lit(1))
    rates = results.agg(
        n.alias("cases"), share(hit, n).alias("top1"), share(in_three, n).alias("top3"), share(sure, n).alias("confident"), share(sure & hit, F.count_if(sure)).alias("exact_if_confident"),
        share(mapped, F.count_if(sure)).alias("mapped_if_confident"), share(sure & ~hit, n).alias("false_positives"), share(c("status") == "unresolved", n).alias("unresolved"), F.round(F.avg("ms"), 6).alias("mean_ms"),
    )
    return rates.join(F.broadcast(exact_median(results, "ms").withColumnRenamed("median", "median_ms")), F.lit(True))


def delete_products(products: DataFrame, images: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """products and images (both with product_id) without those in gone, to be written in their place."""
    keys = gone.select("product_id").distinct()
    return products.join(keys, "product_id", "left_anti"), images.join(keys, "product_id", "left_anti")


def winners(final: DataFrame) -> DataFrame:
    """Updates of the product table from high and medium results: authoritative where the catalogue names the product."""
    rows = final.where(F.col("status").isin("high", "medium") & F.col("style_code").isNotNull())
    return rows.select(codes.normalize_code(F.col("style_code")).alias("style_code"), text("product_name").alias("name"), text("brand").alias("brand"), text("model").alias("model"), text("colorway").alias("colorway"), F.col("product_id").isNotNull().alias("authoritative"), F.col("query_id").alias("ord"))


def write_lines(df: DataFrame, path: str) -> None:
    """df as JSON lines, one object a row; absent fields are left out."""
    df.write.mode("overwrite").json(path)


def grow_index(current: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Photos to append to an index of reference images (product_id, image_hash, …): those of confirmed matches that it has not."""
    return insert_absent(current, confirmed, ["product_id", "image_hash"], ["ord"])
