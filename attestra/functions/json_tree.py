"""Walks of JSON trees as variants: one row a member, level by level, on the JVM.

Defined cases: null, empty and invalid texts, and objects that name a key twice, have no rows; a JSON null is a row without a value; a null
id is kept; repeated rows give their rows each; empty tables give no rows; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Levels that are walked, and items of a list (fixed values).
DEPTH, ITEMS = 12, 200


def members(df: DataFrame, id_col: str, json_col: str, *, depth: int = DEPTH, items: int = ITEMS) -> DataFrame:
    """id, level, path, key (null for items of lists), kind (object, array or scalar), value (of scalars, as text).

    Every level is written, and read for the next one, so that no tree is gone through twice; there are as many jobs as the deepest
    tree has levels, `depth` at most.
    """
    spark, c = df.sparkSession, F.col
    kind = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v).startswith("ARRAY"), "array").otherwise("scalar")
    v = F.try_parse_json(json_col)
    here = written(df.select(c(id_col).alias("id"), F.lit("$").alias("path"), v.alias("v")).where("v IS NOT NULL").withColumn("kind", kind("v")), "json-roots")
    empty = spark.createDataFrame([], here.select("id").schema.simpleString()[7:-1] + ", level int, path string, key string, kind string, value string")
    found = empty
    for level in range(1, depth + 2):
        inner = here.where("kind <> 'scalar'")
        if inner.isEmpty():
            break
        told = spark.sql("SELECT t.id, t.path, t.kind AS parent, e.pos, e.key, e.value AS v FROM {inner} t, LATERAL variant_explode(t.v) e", inner=inner)
        kept = told.where((c("parent") == "object") | (c("pos") < items))
        path = F.concat("path", F.when(c("parent") == "object", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), c("pos").cast("string"), F.lit("]"))))
        here = written(kept.select("id", path.alias("path"), F.when(c("parent") == "object", c("key")).alias("key"), "v").withColumn("kind", kind("v")), "json-level")
        value = F.when(c("kind") == "scalar", c("v").cast("string"))
        found = found.unionByName(here.select("id", F.lit(level).alias("level"), "path", "key", "kind", value.alias("value")))
    return found


def named(df: DataFrame, id_col: str, json_col: str, names: list[str]) -> DataFrame:
    """id, name, value: for each of the names, the first member by level and path whose key is it but for case, dashes and spaces, if it is filled."""
    rows = members(df, id_col, json_col).where("kind = 'scalar' AND trim(value) <> ''").withColumn("name", F.lower(F.regexp_replace("key", "[- ]", "")))
    first = rows.where(F.col("name").isin(names)).groupBy("id", "name").agg(F.min_by("value", F.struct("level", "path")).alias("value"))
    return first.select("id", "name", F.trim("value").alias("value"))
