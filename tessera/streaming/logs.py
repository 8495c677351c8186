"""Event logs as streams: windowed counts, keyed upserts and start-finish latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import best_row


def window_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per event-time window and kind. Events later than `late` behind the newest are left out of a
    stream; a batch has no late events."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    w = e.groupBy(F.window("_ts", width).alias("_w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("_w.start").alias("w"), kind, "n", "total")


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    s = e.groupBy(F.session_window("_ts", gap).alias("_w"), user).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


#: Batches after which the changes are merged into the state.
MERGE = 16


def _versions(spark, path: str, kind: str) -> list[int]:
    """The finished versions of a kind ('d' changes, 's' state) under a path, ascending."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hp(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(hp(path))] if fs.exists(hp(path)) else []
    return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and fs.exists(hp(f"{path}/{n}/_SUCCESS")))


def _state(spark, path: str, upto: int, schema=None) -> DataFrame | None:
    """The last row of each key as of a batch: the newest merged state and the changes after it."""
    base = [v for v in _versions(spark, path, "s") if v <= upto][-1:]
    later = [v for v in _versions(spark, path, "d") if v <= upto and (not base or v > base[0])]
    paths = [f"{path}/s={v}" for v in base] + [f"{path}/d={v}" for v in later]
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths) if paths else None


def upsert_sink(path: str, key: str, stamp: str):
    """A foreachBatch function that keeps the last state of each key in parquet folders under `path`.

    A batch writes only its own last row of each key; every MERGE batches they are merged into a new state, so a batch
    costs what it changes and a MERGE-th of the state. A batch that is run again after a failure replaces its folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c not in (key, stamp)]
        rows = batch.select(key, stamp, *cols)
        best_row(rows, [key], [stamp, *cols], [stamp, *cols]).write.mode("overwrite").parquet(f"{path}/d={epoch}")
        if epoch % MERGE == MERGE - 1:
            best_row(_state(spark, path, epoch, rows.schema), [key], [stamp, *cols], [stamp, *cols]).write.mode("overwrite").parquet(f"{path}/s={epoch}")

    return write


def latest_state(spark, path: str, key: str, stamp: str) -> DataFrame:
    """The last row of each key, of all finished batches."""
    d = _state(spark, path, 1 << 60)
    cols = [c for c in d.columns if c not in (key, stamp)]
    return best_row(d, [key], [stamp, *cols], [stamp, *cols])


def run_to_end(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what its source has now, into parquet, and stops."""
    q = result.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def dispatch_latency(events: DataFrame, dispatch: str, kind: str, ts: str, group: str, ok: str) -> DataFrame:
    """Starts joined with their finishes: group, started, finished, failed, mean and greatest seconds.

    kind is 'start' or 'finish'; the first finish of a dispatch counts.
    """
    one = events.groupBy(dispatch).agg(
        F.min(F.when(F.col(kind) == "start", F.struct(ts, group))).alias("s"), F.min(F.when(F.col(kind) == "finish", F.struct(ts, ok))).alias("f")
    ).where("s IS NOT NULL")
    secs = F.col(f"f.{ts}") - F.col(f"s.{ts}")
    return one.groupBy(F.col(f"s.{group}").alias(group)).agg(
        F.count(F.lit(1)).alias("started"), F.count("f").alias("finished"), F.count(F.when(~F.col(f"f.{ok}"), 1)).alias("failed"), F.avg(secs).alias("mean_s"), F.max(secs).alias("max_s")
    )
