"""Joins, aggregates and folds that the resolution pipeline is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import normalize_code
from ..functions.text import let
from ..session import growing
from .merge import exact_median


def json_pairs(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, key, value of every top-level member of a JSON object; what does not parse has none. Keys lose case, dashes and spaces."""
    pairs = F.from_json(F.coalesce(F.col(json_col), F.lit("{}")), "map<string,string>")
    rows = df.select(F.col(id_col), F.explode(pairs).alias("key", "value"))
    return rows.select(id_col, F.lower(F.regexp_replace("key", "[- ]", "")).alias("key"), "value")


def harvest(hits: DataFrame, trust: DataFrame, default: float = 0.5) -> DataFrame:
    """code: n_domains, trust and first hit. hits: code, domain, labeled, ord. A domain counts once, as its first hit was labelled.

    Two aggregates: the first hit of each (code, domain), then sums by code; trust is looked up by the domain's last two labels.
    """
    first = hits.where("domain <> ''").groupBy("code", "domain").agg(F.min_by("labeled", "ord").alias("labeled"), F.min("ord").alias("ord"))
    known = first.withColumn("suffix", F.substring_index("domain", ".", -2)).join(trust, "suffix", "left")
    value = F.coalesce("trust", F.lit(default)) * F.when(F.col("labeled"), F.lit(1.0)).otherwise(F.lit(0.7))
    return known.groupBy("code").agg(F.count(F.lit(1)).alias("n_domains"), F.round(F.sum(value), 6).alias("trust"), F.min("ord").alias("first_ord"))


def segments_of(style_id: Column) -> Column:
    """array<struct(code, display)> of a compound code: split at slashes, without what stands in parentheses, codes normalised and distinct."""
    parts = F.transform(F.split(F.coalesce(style_id, F.lit("")), "/"), lambda x: F.trim(F.regexp_replace(x, r"\([^)]*\)", "")))
    named = F.filter(F.transform(parts, lambda x: F.struct(normalize_code(x).alias("code"), x.alias("display"))), lambda x: x["code"] != "")
    return let(named, lambda xs: let(F.transform(xs, lambda x: x["code"]), lambda cs: F.filter(xs, lambda x, i: F.array_position(cs, x["code"]) == i + 1)))


def segments(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """id, style_code for each part of a compound code."""
    return df.select(F.col(id_col), F.explode(F.transform(segments_of(F.col(code_col)), lambda x: x["code"])).alias("style_code"))


#: Values of a block, about, and hands that each key of a join of blocks is dealt to.
BLOCK, HANDS = 1_000, 8


def with_values(rows: DataFrame, values: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """rows with the value of every row of values that has their key, null where none has: a left join whose result may be the square of its input.

    Values of a key meet rows as blocks of bounded size, an array each, so that the join moves blocks and what comes out of it is unpacked
    where it is written. Rows of a key are dealt to HANDS tasks by the hash of the column row; how much comes out of few bytes is nothing that adaptive
    execution sees, so partitions are as many as a shuffle has.
    """
    c, parts = F.col, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = values.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64(value), c("n_blocks")).alias("block")
    # Structs, since a value may be null.
    blocks = values.join(growing(counts), key).groupBy(key, block).agg(F.collect_list(F.struct(value)).alias("block_values"))
    blocks = blocks.select(key, "block_values", F.explode(F.sequence(F.lit(0), F.lit(HANDS - 1))).alias("hand"))
    dealt = rows.withColumn("hand", F.pmod(F.xxhash64(row), F.lit(HANDS)).cast("int"))
    met = dealt.repartition(parts, key, "hand").join(growing(blocks.repartition(parts, key, "hand")), [key, "hand"], "left")
    return met.select(*[c(x) for x in rows.columns], F.explode_outer("block_values").alias("v")).select(*rows.columns, f"v.{value}")


def choose_listing(parts: DataFrame) -> DataFrame:
    """Per brand the richest listing, whether listings disagree with the first one, and how many there are."""
    first = parts.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "p_size"), "p_partkey").alias("first"))
    rich = F.struct((F.length("p_name") > 20).cast("int").alias("named"), F.col("p_retailprice").alias("price"), (-F.col("p_partkey")).alias("order"))
    joined = parts.join(first, "p_brand")
    return joined.groupBy("p_brand").agg(F.max_by("p_partkey", rich).alias("chosen"), F.bool_or((F.col("p_type") != F.col("first.p_type")) | (F.col("p_size") != F.col("first.p_size"))).alias("ambiguous"), F.count(F.lit(1)).alias("n_listings"))


def slices(time: Column, width_us: int) -> Column:
    """array<struct(slice, guest)>: the slice of time that a row lies in, and as a guest the next one, which looks back into it."""
    own = F.floor(F.unix_micros(time.cast("timestamp")) / width_us)
    return F.array(F.struct(own.alias("slice"), F.lit(False).alias("guest")), F.struct((own + 1).alias("slice"), F.lit(True).alias("guest")))


def ttl_lookup(requests: DataFrame, entries: DataFrame, *, key: str, time: str, row: str, days: int) -> DataFrame:
    """row of each request with that of the newest entry of its key within the last days, or null.

    An as-of join without a range join: both sides go through one window per key and slice of `days`, which carries the last entry
    along; entries are in the next slice as well. So a key with a third of all rows is as many tasks as it has slices.
    """
    own = lambda df, asks: df.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(row).alias("r"), F.lit(asks).alias("asks"), slices(F.col(time), days * 86_400_000_000).alias("at"))
    both = own(requests, 1).withColumn("at", F.slice("at", 1, 1)).unionByName(own(entries, 0)).withColumn("at", F.explode("at"))
    w = Window.partitionBy("k", "at.slice").orderBy("t", "asks", "r").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("asks") == 0, F.struct("t", "r")), ignorenulls=True).over(w)
    hit = both.withColumn("hit", last).where("asks = 1")
    fresh = F.col("hit.t") >= F.col("t") - F.expr(f"INTERVAL {days} DAYS")
    return hit.select(F.col("r").alias(row), F.when(fresh, F.col("hit.r")).alias("cached"))


def counts_in_window(df: DataFrame, *, key: str, time: str, row: str, window_us: int) -> DataFrame:
    """row and how many rows of its key lie in the window that ends with it, itself and its equals in time included; by key and slice."""
    dealt = df.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(row).alias(row), F.explode(slices(F.col(time), window_us)).alias("at"))
    w = Window.partitionBy("k", "at.slice").orderBy("t").rangeBetween(-window_us, 0)
    return dealt.withColumn("in_window", F.count(F.lit(1)).over(w)).where("NOT at.guest").select(row, "in_window")


def running_counts(df: DataFrame, *, bucket: Column, part: Column, order: list[str], row: str) -> DataFrame:
    """row, bucket and its place in the bucket by order. Parts of a bucket, in order, are numbered apart and shifted by the parts before."""
    rows = df.select(bucket.alias("bucket"), part.alias("part"), F.col(row).alias(row), *[F.col(c).alias(f"o_{i}") for i, c in enumerate(order)])
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(*[f"o_{i}" for i in range(len(order))]))
    numbered = rows.withColumn("place", place).join(sizes.select("bucket", "part", before.alias("before")), ["bucket", "part"])
    return numbered.select(row, "bucket", (F.col("before") + F.col("place")).alias("used"))


def evaluate(df: DataFrame) -> DataFrame:
    """One row of rates: accuracy, precision and false positives of guess against truth, mean and exact median latency."""
    right, said = F.col("guess") == F.col("truth"), F.col("guess") == 1
    share = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), b), 6)
    rates = df.agg(
        F.count(F.lit(1)).alias("n"),
        share(right, F.count(F.lit(1))).alias("accuracy"),
        share(right & said, F.count_if(said)).alias("precision"),
        share(said & ~right, F.count_if(F.col("truth") == 0)).alias("false_positive_rate"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
    )
    return rates.join(F.broadcast(exact_median(df, "latency").withColumnRenamed("median", "median_latency")), F.lit(True))
