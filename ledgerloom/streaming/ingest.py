"""Incremental ingest and sessions, as Structured Streaming over the same expressions as the batch queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(rows: DataFrame, order: Column, files: int, path: str) -> DataFrame:
    """rows as a stream of files that come one after the other, each a range of the order, written to path.

    Files count by their times, so these are set in the order of the ranges.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(files, order).write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, f in enumerate(found):
        fs.setTimes(f, 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "100000d").parquet(path)


def read_up(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read up, from the folder it is written to.

    Each micro-batch overwrites a folder of its own number, so one that is run again writes the same once. In complete
    mode the last batch has all rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).option("basePath", folder)
    if mode == "complete":
        return found.parquet(f"{folder}/batch={query.lastProgress.batchId}").drop("batch")
    return found.parquet(folder).drop("batch")


#: Parts that keys are dealt into by their hash; each has one state.
BUCKETS = 256


def _plain(values: pd.Index | pd.Series) -> list:
    """Values as a state holds them: missing ones null, times without pandas' own type."""
    return [None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in values.tolist()]


def carried_over(stream: DataFrame, key: str, order: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream's rows with the last known value up to each, also where it came in an earlier micro-batch: key, order, value.

    A key's last known value is kept as long as the stream is. Keys share the states of `buckets` parts, so that calls of
    Python grow with the parts and not with the keys. A micro-batch holds a key's own rows only, and they may come in any
    order within it; across batches rows come in order.
    """
    kinds = dict(stream.dtypes)

    def carry(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        known = rows.groupby(key, sort=False, dropna=False)[value].ffill()
        if last:
            known = known.fillna(rows[key].map(pd.Series(list(last.values()), index=pd.Index(list(last), dtype=rows[key].dtype))))
        rows[value] = known
        ends = rows.groupby(key, sort=False, dropna=False)[value].last().dropna()
        if len(ends):
            last.update(zip(_plain(ends.index), _plain(ends), strict=True))
            state.update((list(last), list(last.values())))
        yield rows[[key, order, value]]

    # null keys have a part of their own, as pandas tells whole numbers beside nulls by 53 bits only
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    own = stream.select(key, order, value, bucket.alias("__bucket")).groupBy("__bucket")
    return own.applyInPandasWithState(carry, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}", f"keys array<{kinds[key]}>, lasts array<{kinds[value]}>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events with less than the gap between them; late bounds the state of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session.start").alias("start"), "n_events", F.round("total", 6).alias("total"))


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    found = timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("event_type", F.col("w.start").alias("start"), "n_events")


def fresh(stream: DataFrame, path: str, text: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose path and content haven't been met within the watermark: state is bounded by it."""
    return stream.withColumn("sha1", F.sha1(text)).withWatermark(time, late).dropDuplicatesWithinWatermark([path, "sha1"])


def upserted(stream: DataFrame, folder: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends each micro-batch's rows that the folder doesn't hold yet, until the source is read up.

    A batch overwrites a folder of its own number and leaves that out of what it compares with, so one that is run again
    gives the same rows once. Of rows of a batch that share a key any one is kept.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{number}"
        try:
            there = spark.read.parquet(folder)
            there = there.where(F.col("batch").cast("string") != own) if "batch" in there.columns else there
            batch = batch.join(there.select(key).distinct(), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/batch={own}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
