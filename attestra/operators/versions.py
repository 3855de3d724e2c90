"""Committed tables: folders of Parquet under a manifest that is written last.

A commit writes its rows to a folder of its own and then one manifest, a small JSON file that names all folders of the new version, by renaming a
finished file. A reader takes the newest manifest and sees the version it names, whole; what a killed job has written without a
manifest is never read, and neither is what a later commit adds. A commit carries the name of its batch, and a batch that has been
committed is not committed again, so a stream or a retried job may repeat it.

Rows of one key are the latest by folder and then by the order columns; compaction writes them once, as a new version. One job writes at a time:
of two that commit the same version the second fails.

Defined cases: null keys are one key; equal rows are one of them; an empty batch is a version; a table without a version cannot be
read; columns are those of the first commit, by name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import latest


class Table:
    """A committed table at a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.of = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self.fs = self.of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def name(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        place = self.of(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, by default the newest; version 0 has no folders."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return {"version": 0, "folders": [], "batches": [], "schema": None}
        rows = self.spark.read.text(self.name(version), wholetext=True).collect()  # one small file
        return json.loads(rows[0].value)

    def commit(self, rows: DataFrame, batch: str, *, instead: bool = False) -> int:
        """Add rows, or put them in the place of all others; the new version, or the present one if the batch has been committed."""
        now = self.manifest()
        if batch in now["batches"]:
            return now["version"]
        schema = T.StructType.fromJson(now["schema"]) if now["schema"] else rows.schema
        folder = f"rows-{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]).write.parquet(f"{self.path}/{folder}")
        new = {"version": now["version"] + 1, "folders": [*([] if instead else now["folders"]), folder], "batches": [*now["batches"], batch], "schema": json.loads(schema.json())}
        self.publish(new)
        return new["version"]

    def publish(self, manifest: dict) -> None:
        """The commit itself: a finished file gets its name."""
        draft, final = self.of(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self.of(self.name(manifest["version"]))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} has been committed by another job")

    def read(self, version: int | None = None) -> DataFrame:
        """The latest row of every key in a version."""
        told = self.manifest(version)
        if told["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        schema = T.StructType.fromJson(told["schema"])
        number = "__folder"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}").withColumn(number, F.lit(i)) for i, f in enumerate(told["folders"])]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return latest(every, self.keys, number, *self.order).select(*[f"`{f.name}`" for f in schema])

    def compact(self) -> int:
        """A version of one folder with the rows that the newest one has."""
        now = self.manifest()
        return self.commit(self.read(now["version"]), f"compaction of {now['version']}", instead=True) if len(now["folders"]) > 1 else now["version"]
