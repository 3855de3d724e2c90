"""Stateful operators: admission limits and latest rows, in batch and as streams."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.merge import arg_first
from ..operators.versions import Table
from ..session import shared_dir, written


def sessions(requests: DataFrame, window_us: int) -> DataFrame:
    """requests (k, t, r) with session: the time of the first request of the run they lie in; runs are at least the window apart.

    Nothing that was admitted before a session holds in it. Requests are compared within slices of time, to which those of the slice before
    are guests; the slices' last starts are then carried along, so a key with a third of all rows is as many tasks as it has slices.
    """
    c = F.col
    own = F.floor(c("t") / window_us)
    at = F.array(F.struct(own.alias("slice"), F.lit(False).alias("guest")), F.struct((own + 1).alias("slice"), F.lit(True).alias("guest")))
    within = Window.partitionBy("k", "slice").orderBy("t", "r")
    seen = requests.select("k", "t", "r", F.explode(at).alias("at")).select("k", "t", "r", "at.*").withColumn("last", F.lag("t").over(within)).where(~c("guest"))
    begins = seen.select("k", "t", "r", "slice", F.when(c("last").isNull() | (c("t") - c("last") >= window_us), c("t")).alias("begin"))
    begins = written(begins, "session-begins")
    ends = begins.groupBy("k", "slice").agg(F.max("begin").alias("begin"))
    carried = ends.select("k", "slice", F.max("begin").over(Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    upto = begins.withColumn("here", F.max("begin").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = upto.alias("u").join(carried.alias("c"), c("u.k").eqNullSafe(c("c.k")) & (c("u.slice") == c("c.slice")))
    return joined.select("u.k", "u.t", "u.r", F.coalesce("u.here", "c.carried").alias("session"))


def admit(requests: DataFrame, *, key: str, time: str, row: str, most: int, window_s: float) -> DataFrame:
    """row, admitted: at most `most` admitted requests of a key in any window_s seconds; refused ones do not count.

    Whether a request is admitted depends on those before it only as far back as the last pause of a whole window, so keys are cut into
    sessions there. Rows of a session arrive sorted in a partition and are folded batch by batch: the state is the last `most` admitted
    times, so a session of any length needs no more memory than that. A null key is a key; a null time is refused and counts nowhere.
    """
    window_us = round(window_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for batch in batches:
            out = []
            for k, s, t, r in zip(batch["k"], batch["session"], batch["t"], batch["r"], strict=True):
                if (k, s) != now:
                    now, held = (k, s), deque()
                while held and held[0] <= t - window_us:
                    held.popleft()
                if ok := len(held) < most:
                    held.append(t)
                out.append((r, ok))
            yield pd.DataFrame(out, columns=[row, "admitted"])

    df = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(row).alias("r"))
    dealt = sessions(df.where("t IS NOT NULL"), window_us).repartition("k", "session").sortWithinPartitions("k", "session", "t", "r")
    return dealt.mapInPandas(run, f"{row} long, admitted boolean").unionByName(df.where("t IS NULL").select(F.col("r").cast("long").alias(row), F.lit(False).alias("admitted")))


def admit_stream(requests: DataFrame, *, key: str, time: str, row: str, most: int, window_s: float) -> DataFrame:
    """The same for a stream: the state of a key is its last `most` admitted times, and is dropped once the watermark has left them behind.

    requests has a watermark on its time column. Rows of a key are folded in order of time within each batch.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        for batch in [pd.concat(list(batches)).sort_values(["t", "r"])]:
            out = []
            for t, r in zip(batch["t"].tolist(), batch["r"].tolist(), strict=True):
                while held and held[0] <= t - window_s:
                    held.popleft()
                if ok := len(held) < most:
                    held.append(t)
                out.append((r, ok))
            yield pd.DataFrame(out, columns=[row, "admitted"])
        state.update((list(held),))
        state.setTimeoutTimestamp(max(int((max(held, default=0.0) + window_s) * 1000), state.getCurrentWatermarkMs() + 1))

    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t")
    df = requests.select(F.col(key).alias("k"), time, seconds, F.col(row).alias("r"))
    return df.groupBy("k").applyInPandasWithState(run, f"{row} long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class TtlCache(StatefulProcessor):
    """The newest entry of a key as state, for as long as it is fresh.

    Rows of a key come in order of time within a batch, entries before the requests of the same instant. A timer of event time drops an
    entry once the watermark has left its life behind, so the state holds keys with a fresh entry only.
    """

    def __init__(self, life_us: int, row: str):
        self.life_us, self.row = life_us, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "t long, r long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        out = []
        for t, asks, r in pd.concat(list(rows)).sort_values(["t", "asks", "r"])[["t", "asks", "r"]].itertuples(index=False):
            if asks:
                out.append((r, held[1] if held and held[0] >= t - self.life_us else None))
            elif held is None or (t, r) >= tuple(held):
                held = (int(t), int(r))
        if held:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.entry.update(tuple(held))
            self.handle.registerTimer((held[0] + self.life_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.row, "cached"]).astype({self.row: "int64", "cached": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_stream(rows: DataFrame, *, key: str, time: str, row: str, asks: Column, days: int) -> DataFrame:
    """row and cached of each request (rows where asks holds) as relational.ttl_lookup gives them, of a stream with requests and entries.

    rows has a watermark on its time column, and its batches come in order of time; what a key has in one batch meets in one task. The state
    store must be RocksDB's.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    df = rows.select(F.col(key).alias("k"), F.col(time), seconds.alias("t"), asks.cast("int").alias("asks"), F.col(row).cast("long").alias("r"))
    return df.groupBy("k").transformWithStateInPandas(TtlCache(days * 86_400_000_000, row), f"{row} long, cached long", "Append", "EventTime")


def commit_stream(stream: DataFrame, table: Table, place: str, step: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A stream, run to its end, into a committed table: a version a batch, and each batch once, whatever is repeated after a failure.

    step: what becomes of a batch before it is committed. It sees the batch as a written table of the committed table's session, so it may
    read it often and join it with tables of that session; it is not called for a batch that has been committed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        name = f"batch {number}"
        if step is None:
            table.commit(batch, name)
        elif name not in table.manifest()["batches"]:
            table.commit(step(written(batch, "batch", table.spark)), name)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def append_absent(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One batch of a stream into a growing Parquet table: rows whose key it has not yet, once each."""
    spark = batch.sparkSession
    new = arg_first(batch, keys, order)
    try:
        known = spark.read.schema(batch.schema).parquet(path).select(*keys)
        new = new.join(known, keys, "left_anti")
    except AnalysisException as e:  # the first batch finds no table
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.select(*batch.columns).write.mode("append").parquet(path)


def latest_by_key(events: DataFrame) -> DataFrame:
    """The same plan for a batch and for a stream in update or complete mode."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("x")).select("user_id", F.col("x.event_type").alias("status"), F.col("x.event_id").alias("event_id"))


def deduplicate_within(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark's delay; state is dropped as the watermark passes."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


#: The state store that processors with state variables need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ttl(spark: SparkSession, folder: str, files: str, days: int) -> DataFrame:
    """Purchases with the newest view of their user within days, by a streaming query over the events in folder; its result is a Parquet table."""
    events = spark.readStream.schema(spark.read.parquet(f"{folder}/{files}").schema).option("pathGlobFilter", files).parquet(folder)
    events = events.where("event_type IN ('purchase', 'view')").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")
    out = ttl_stream(events, key="user_id", time="at", row="event_id", asks=F.col("event_type") == "purchase", days=days)
    place = f"{shared_dir(spark)}/ttl-{uuid.uuid4().hex}"
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, ROCKS)
    try:
        query = out.writeStream.format("parquet").option("path", f"{place}-rows").option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{place}-rows")


def stream_latest(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """Latest status per user by a streaming query over the files in folder, run to its end; its result is a Parquet table."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    name = f"latest_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    stream = latest_by_key(spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder))
    batches = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}-rows")
        batches.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}-rows") if batches else spark.createDataFrame([], stream.schema)
