"""Streams: packages scanned as they arrive, decisions counted as they are made."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.sources import packages

DECISIONS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def decision_stream(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accepted and skipped decisions per window; decisions later than the watermark are left out. Works on a stream and on a table alike."""
    action = F.when(F.col("event_type").isin("purchase", "signup"), "accepted").when(F.col("event_type") == "error", "skipped")
    d = events.withColumn("action", action).where("action is not null")
    if d.isStreaming:  # a watermark wants a time with a zone
        d = d.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.window("ts", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def incremental_scan(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Parses the packages that arrived or changed since the last call into `out`; `scanned` reads it.

    Arrivals come through a stream whose checkpoint remembers them; a batch that is run again replaces what it has written. The stream doesn't see a file a second time, so after it the files' times and sizes are
    compared with those of their latest scan, in a table keyed by path, and those that differ are scanned again, and no others. What a scan gives is written before the rows that say so, so a scan that breaks off doesn't count.
    Unreadable packages end up in the quarantine, until they are replaced.
    """
    files = spark.readStream.format("binaryFile").schema(packages.FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)

    def parse(batch: DataFrame, name: str) -> None:
        packages.scan_packages(batch).write.mode("overwrite").parquet(f"{out}/scans/batch={name}")
        batch.select("path", "modificationTime", "length").write.mode("overwrite").parquet(f"{out}/files/batch={name}")

    query = files.writeStream.foreachBatch(lambda batch, number: parse(batch, f"new{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    now = packages.package_files(spark, path)
    known = latest_files(spark, out).select("path", F.col("modificationTime").alias("time"), F.col("length").alias("size"))
    changed = now.join(known, "path").where("modificationTime <> time or length <> size").select("path", "modificationTime", "length")
    if not changed.isEmpty():
        parse(now.join(changed.select("path"), "path", "left_semi"), f"changed{uuid.uuid4().hex[:12]}")


def latest_files(spark: SparkSession, out: str) -> DataFrame:
    """path, modificationTime, length and batch of the latest scan of each package."""
    seen = spark.read.schema("path string, modificationTime timestamp, length long, batch string").parquet(f"{out}/files")
    return seen.groupBy("path").agg(F.max(F.struct("modificationTime", "length", "batch")).alias("f")).select("path", "f.*")


def scanned(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the latest scan of each package: runs, paragraphs, comments and quarantine; and files."""
    latest = latest_files(spark, out)
    scans = spark.read.schema(packages.SCANNED + ", batch string").parquet(f"{out}/scans").join(latest.select("path", "batch"), ["path", "batch"], "left_semi")
    return packages.tables_of(scans.drop("batch")) | {"files": latest}


def stale_figures(figures: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Projects whose scanned figures no longer hold, because their page count is another one or they were never scanned. figures: project, page_count; page_counts: project, page_count."""
    return page_counts.select("project", "page_count").join(figures.select("project", "page_count").distinct(), ["project", "page_count"], "left_anti")
