"""Merging and ordering relations: first-wins folds, arg-max, latest rows, pools, upserts. Every tie has an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def arg_max(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per key: the largest value, the first of equals. An aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(value)).alias("v"), *order)).alias("row"))
    return best.select(*keys, "row.*")


def first_filled(column: str, *order: str) -> Column:
    """Aggregate: the first non-empty value in order."""
    return F.min_by(column, F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.struct(*order)))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key with their rank; Spark prunes to n per key and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def merge_evidence(evidence: DataFrame, *, keys: tuple[str, ...] = ("query_id", "style_code")) -> DataFrame:
    """Candidates of evidence rows (…keys, kind, detail, weight, ord): best weight, kinds in order of first sight, distinct evidence."""
    edges = evidence.groupBy(*keys, "kind", "detail").agg(F.max("weight").alias("weight"), F.min("ord").alias("ord"))
    kinds = edges.groupBy(*keys, "kind").agg(F.max("weight").alias("weight"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    return kinds.groupBy(*keys).agg(
        F.sum("n").alias("n_evidence"),
        F.max("weight").alias("best_weight"),
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"]), ",").alias("kinds"),
    )


def upsert(current: DataFrame, updates: DataFrame, key: str, columns: list[str], authoritative: str = "authoritative") -> DataFrame:
    """current merged with updates: an empty value never replaces a filled one; authoritative updates replace, others only fill.

    Several updates of a key are folded in the order of ``ord``: the last authoritative value, else the first filled one.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    folds = []
    for c in columns:
        folds += [F.max_by(c, F.when(filled(c) & F.col(authoritative), F.col("ord"))).alias(f"{c}__a"), F.min_by(c, F.when(filled(c), F.col("ord"))).alias(f"{c}__f")]
    new = updates.groupBy(key).agg(*folds)
    old = lambda c: F.when(F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")) != "", F.col(f"o.{c}"))
    joined = current.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(F.col(f"n.{c}__a"), old(c), F.col(f"n.{c}__f")).alias(c) for c in columns])


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose key is not in current, once each."""
    return arg_first(new, keys, order).join(current.select(*keys), keys, "left_anti")


def arg_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def exact_median(df: DataFrame, column: str, few: int = 1024) -> DataFrame:
    """One row with the exact median of a column, null where it has no numbers; NaN counts as none.

    Values are counted before they meet. While more than `few` distinct values lie where the middle is, that range is cut into as many
    parts, counted in one aggregate, and the part with the middle is looked at next: no window or sort holds all values.
    """
    spark, c = df.sparkSession, F.col
    counts = written(df.where(c(column).isNotNull() & ~F.isnan(c(column).cast("double"))).groupBy(c(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "median-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("low"), F.max("v").alias("high")).first()

    def at(place: int) -> float:
        """The value at a place of the sorted column, from 1."""
        low, high, values = whole["low"], whole["high"], whole["values"]
        here = counts
        while values > few:
            # Halves, since the whole range may be no finite number.
            part = F.least(F.floor((c("v") / 2 - low / 2) / (high / 2 - low / 2) * few), F.lit(few - 1))
            parts = here.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # at most `few`
            for p in sorted(parts, key=lambda p: p["low"]):
                if place <= p["n"]:
                    break
                place -= p["n"]
            low, high, values = p["low"], p["high"], p["values"]
            here = counts.where(c("v").between(low, high))
        for r in sorted(here.collect()):  # at most `few`
            if place <= r["n"]:
                return r["v"]
            place -= r["n"]
        raise AssertionError("place beyond the last value")

    n = whole["n"]
    middle = (at((n + 1) // 2) + at((n + 2) // 2)) / 2.0 if n else None
    return spark.createDataFrame([(middle,)], "median double")
