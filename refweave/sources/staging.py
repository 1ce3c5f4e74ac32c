"""Results that several branches of a query read, written once to a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read back, so that its branches don't compute it again. Without that setting, a session on one machine uses a temporary folder; a cluster is asked for the setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-staged-')}"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
