"""Helpers that the corpus operators share: lineage cuts, let-bindings and ASCII text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Java and RE2 read these alike: ASCII white space and maximal runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def materialize(df: DataFrame, name: str, compression: str = "zstd", row_group: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here and survives lost executors.

    row_group: bytes that a writing task gathers before it writes; for tables with large values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each place the fold of the values before it, and at the end that of all; n + 1 values.

    Appending to one array would cost the square of n; blocks keep the arrays that grow short.
    """

    def folds(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: add(acc, x)))
        inner = lambda firsts: F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), lambda b, first: F.slice(folds(b, first), F.lit(1), F.size(b)))
        return let(folds(totals, zero), lambda firsts: F.concat(F.flatten(inner(firsts)), F.array(F.element_at(firsts, -1))))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda i: F.slice(v, i, F.lit(block)))
    return F.when(F.size(values) > 0, let(cut(values), joined)).otherwise(F.array(zero))


def named(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(columns: list[str], stem: str) -> str:
    """stem, lengthened until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same for pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
