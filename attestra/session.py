"""Getting the package to Python workers wherever the driver found it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once, so that workers can import it in any working directory."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="attestra-")) / "attestra.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="attestra-"))
    return _own_dir[0]


def growing(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: its size grows with the input, and Spark's estimate of it may be far too small to broadcast by.

    A table derived from a few columns of a file, or written with much repetition, is estimated by the bytes of the file; what is sent
    through the driver are its rows.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has: a small file is a task or two, however much is made of each of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it is computed once, and its lineage ends here.

    reader: the session that reads it, where that is not df's own (as for the batches of a stream).
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
