"""What the operators of this subpackage share: tables, scratch folders, words and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A word for decontamination, after A-Z are lower-cased: ASCII letters and digits and all beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows at most in the batches that Python gets. Rows hold whole texts and their word hashes, so Spark's own limit of 10,000 makes batches of a hundred MB.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch to BATCH_ROWS, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name that driver and executors can all reach: below spark.checkpoint.dir, or, where that is unset, below the checkpoint folder that the session was given.

    A session without either gets a folder of this machine only if it runs here alone (a local master, as in tests); on a cluster that raises, for executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        hadoop = context._jsc.sc().getCheckpointDir()
        if hadoop.isDefined():
            base = hadoop.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: later readers don't compute it again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores behind it as make it differ from those taken (in any case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of `value` over all rows before a row in an order without ties. Rows are dealt out by ranges of the order; one task sees one range, and one the ranges' totals."""
    ranges = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.withColumn("_base", before("_total", Window.orderBy("_range"))).select("_range", "_base")
    return ranges.withColumn("_own", before("_value", Window.partitionBy("_range").orderBy(*order))).join(bases, "_range").withColumn(name, F.col("_own") + F.col("_base")).select(*df.columns, name)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in order; of null, none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(text: Column, pattern: str = WORD) -> Column:
    """64-bit hashes of a text's words in order, computed in the JVM."""
    return F.transform(words(text, pattern), lambda w: F.xxhash64(w))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart: rows with one key have the same id and the same text, so they share their results."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")), text.isNull())


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each row's begin (and the last end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else column.values
    return values.to_numpy(zero_copy_only=False), offsets - (offsets[0] if len(offsets) else 0)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def spread(a: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) ^ (a.astype(np.uint64) >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many consecutive values, by doubling: a window of n is made of two (overlapping, at the last step) of n/2 or more."""
    size, out = 1, h.astype(np.uint64)
    while size < length and len(out):
        step = min(size, length - size)
        out = mix(out[:-step], out[step:]) if len(out) > step else out[:0]
        size += step
    return out
