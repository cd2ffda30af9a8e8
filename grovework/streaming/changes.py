"""File-change streams: event filter, trailing debounce by session windows, incremental apply in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovework.functions.text import scan_match
from grovework.operators.reconcile import file_diff

CHANGES = "project string, path string, kind string, ts timestamp, arrived_at timestamp"
DEBOUNCE = "5 seconds"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The change events in Parquet files of a folder, as a stream."""
    r = spark.readStream.schema(CHANGES)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def relevant(events: DataFrame, suffixes: list[str], exclude: list[str]) -> DataFrame:
    """Events of files with a known suffix that no exclude pattern matches (stateless)."""
    keep = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes])
    return events.where(F.col("path").isNotNull() & keep & (~scan_match(F.col("path"), exclude) if exclude else F.lit(True)))


def debounce(events: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """Bursts per project: a trailing debounce, each event extending the burst by ``gap``.

    ``project, start, last, n_events, paths`` (sorted, distinct). On a stream give a ``watermark``: a burst is emitted
    once the watermark has passed its end; later events for it are dropped. In batches events are first merged by spans of
    one gap, which cannot divide a burst, so that a busy project is a row for each span and not for each event.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    if not events.isStreaming:
        return _debounce_batch(events, gap)
    w = F.session_window("ts", gap)
    return events.groupBy("project", w).agg(F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set("path")).alias("paths"), F.max("ts").alias("last")).select(
        "project", F.col("session_window.start").alias("start"), "last", "n_events", "paths"
    )


def _debounce_batch(events: DataFrame, gap: str) -> DataFrame:
    long = F.expr(f"unix_micros(timestamp_micros(0) + interval {gap})")
    at = F.unix_micros("ts")
    spans = events.where(F.col("ts").isNotNull()).groupBy("project", F.floor(at / long).alias("_span")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.collect_set("path").alias("paths")
    )
    order = Window.partitionBy("project").orderBy("_span")
    pause = F.unix_micros("start") - F.unix_micros(F.lag("last").over(order))
    marked = spans.withColumn("_new", F.when(pause <= long, 0).otherwise(1))
    burst = marked.withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return burst.groupBy("project", "_burst").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n_events"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths")
    ).drop("_burst")


def append_latest(changes: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write of each micro-batch the newest event per path to ``folder/batch=<id>``.

    A batch that is replayed overwrites its own folder, and nothing is kept on the driver, so the table survives restarts;
    no batch reads or rewrites what earlier ones wrote. ``latest_changes`` of the folder gives the state.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        latest_changes(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id:012d}")

    w = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event per path of all batches in ``folder`` (none: no rows)."""
    if not any(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")) or []):
        return spark.createDataFrame([], CHANGES)
    return latest_changes(spark.read.schema(CHANGES).parquet(folder))


def latest_changes(events: DataFrame) -> DataFrame:
    """Of each path the newest event (late arrivals lose to newer event times); repeated events count once."""
    newest = F.max(F.struct("ts", "arrived_at", "kind")).alias("e")
    return events.where(F.col("path").isNotNull()).groupBy("project", "path").agg(newest).select("project", "path", "e.kind", "e.ts", "e.arrived_at")


def classify(events: DataFrame, scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths of events as ``changed`` (on disk), ``deleted`` (indexed, no longer there) or ``ignored``."""
    p = events.select("project", F.col("path").alias("file_path")).distinct()
    a = scanned.select("project", "file_path", F.lit(True).alias("_disk")).distinct()
    b = indexed.select("project", "file_path", F.lit(True).alias("_known")).distinct()
    c = F.when(F.col("_disk"), "changed").when(F.col("_known"), "deleted").otherwise("ignored")
    return p.join(a, ["project", "file_path"], "left").join(b, ["project", "file_path"], "left").select("project", "file_path", c.alias("change"))


def apply_incrementally(
    changes: DataFrame, stored: Callable[[], DataFrame], scanned: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Run ``apply(diff, batch_id)`` per micro-batch, where ``diff`` has the paths whose checksum really differs.

    ``checkpoint`` is a folder all executors share; one query per project keeps writers apart. ``apply`` gets each batch
    at least once and must be idempotent by ``batch_id``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        paths = batch.select("project", F.col("path").alias("file_path")).distinct()
        old = stored().join(paths, ["project", "file_path"], "left_semi")
        diff = file_diff(old, scanned(paths)).where(F.col("change") != "same")
        if not diff.isEmpty():
            apply(diff, batch_id)

    w = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
