"""Structured Streaming twins of the batch operators.

``stream_ingest``            listing of CSV files -> normalised Parquet (``foreachBatch``; each
                              micro-batch is one batch of ``sources.increments``).
``stream_row_findings``      stateless row detectors on a streaming table.
``stream_campaign``          password spray / brute force: counters and an entry per distinct
                              value for each (key, epoch-aligned bucket), in keyed state.
``stream_success_after_failures``  events wait in keyed state by the minute until the watermark
                              passes them, then follow each other in event-time order; what no
                              later event can meet is dropped.  Both: ``stateful``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import nz
from ..operators import row_detectors
from ..operators.campaigns import failure_rows
from ..session import ship_package
from ..sources.increments import append_batch, listed
from .stateful import CAMPAIGN_OUT, SAF_OUT, CampaignCounts, SuccessAfterFailures, use_keyed_state


# -- ingest ---------------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, source_dir: str, tables: str, checkpoint: str, max_files_per_trigger: int | None = None):
    """Start an ``availableNow`` stream of the CSV files of a folder into ``tables``; returns the StreamingQuery.

    The stream lists files, whatever their headers and dialects; each
    micro-batch is ingested as a batch of its own, and one that is replayed
    replaces what it wrote before.  ``increments.current_tables`` reads the tables.
    """
    listing = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
               .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        listing = listing.option("maxFilesPerTrigger", max_files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.sparkSession, batch, tables, origin=f"{checkpoint}#{batch_id}")

    return (listed(listing.load(source_dir)).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# -- stateless ---------------------------------------------------------------------------------

def stream_row_findings(signin_stream: DataFrame | None, ual_stream: DataFrame | None,
                        files: DataFrame | None = None) -> DataFrame:
    """Row detectors on streaming tables (a static ``files`` table may be joined)."""
    parts = []
    if signin_stream is not None:
        parts += [row_detectors.det_risky_signin(signin_stream, files),
                  row_detectors.det_legacy_auth(signin_stream, files)]
    if ual_stream is not None:
        parts.append(row_detectors.det_ual_suspicious(ual_stream, files))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- campaigns -----------------------------------------------------------------------------------

def stream_campaign(signin_stream: DataFrame, key: str = "ip", window_minutes: int = 15, min_failures: int = 20,
                    min_other: int = 5, watermark: str = "30 minutes") -> DataFrame:
    """Per (key, bucket) counts; use output mode ``update`` and keep the last row per (key, bucket).

    State is two counters and two times per (key, bucket) and an entry per
    distinct other value, gone when the watermark passes the bucket.
    """
    spark = signin_stream.sparkSession
    ship_package(spark)
    use_keyed_state(spark)
    other = "user" if key == "ip" else "ip"
    win = int(window_minutes) * 60
    rows = (failure_rows(signin_stream).select(F.col(key).alias("key"), F.expr(f"ts_epoch div {win}").alias("bucket"),
                                               F.col(other).alias("other"), "ts_epoch", F.timestamp_seconds("ts_epoch").alias("_ts"))
            .withWatermark("_ts", watermark))
    counted = rows.groupBy("key", "bucket").transformWithStateInPandas(
        CampaignCounts(win, int(min_failures), int(min_other)), CAMPAIGN_OUT, "Update", "EventTime")
    return counted.withColumnRenamed("key", key)


# -- success after failures (stateful) ---------------------------------------------------------

def stream_success_after_failures(signin_stream: DataFrame, max_minutes: int = 30, min_fails: int = 5, *,
                                  watermark: str) -> DataFrame:
    """Streaming twin of ``det_success_after_failures`` (append mode).

    ``watermark`` is how late a row may come; later ones are dropped and
    counted by :func:`dropped_rows`.  State per user holds events not yet passed by the watermark and the live
    failure epochs, so memory is bounded by one window of failures plus the
    allowed lateness.  The batch twin also gates users on whole-history
    counts, which a stream cannot know in advance; results agree whenever a
    user's failures and successes are classified alike by both outcome
    flavours (result types that start with a digit or are empty).
    """
    ship_package(signin_stream.sparkSession)
    use_keyed_state(signin_stream.sparkSession)
    W = int(max_minutes) * 60
    rows = (signin_stream.filter((nz("user") != "") & F.col("ts_epoch").isNotNull())
            .withColumn("f", P.signin_failure())
            .withColumn("_s", ~F.col("f") & P.signin_success())
            .filter(F.col("f") | F.col("_s"))
            .select("user", "ts_epoch", "file_id", "rownum", "f", nz("ip").alias("ip"),
                    F.timestamp_seconds("ts_epoch").alias("_ts"))
            .withWatermark("_ts", watermark))
    return rows.groupBy("user").transformWithStateInPandas(SuccessAfterFailures(W, int(min_fails)), SAF_OUT, "Append", "EventTime")


# -- durable campaign sink ---------------------------------------------------------------------

def write_campaign_updates(campaign_stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append every micro-batch of an update-mode campaign stream to a Parquet update log
    (partitioned by batch id); ``latest_campaigns`` reads the current value per (key, bucket).
    Replays after a failure rewrite the same batch partition, so the log stays idempotent."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    w = campaign_stream.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation",
                                                                                          checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def dropped_rows(query) -> int:
    """Rows that came later than the watermark allows, over the progress reports that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def latest_campaigns(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Current campaign rows: the last update of each (key, bucket) (empty when nothing was logged)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*")
    logged = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not logged:
        return spark.createDataFrame([], f"{key} string, bucket long, fails long, n_other long, min_ts long, "
                                         "max_ts long")
    log = spark.read.parquet(path)
    w = Window.partitionBy(key, "bucket").orderBy(F.desc("batch_id"))
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch_id")
