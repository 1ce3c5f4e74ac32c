"""A training corpus from raw documents: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import decontaminate, mixing, neardup, quality, tokens
from refweave.llm.common import scratch, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go whole."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, shard after shard, each shard in its own shuffled order: the files hold the mix's order."""
    mixed = mixing.mixture(docs)
    shard, order = mixed.columns[-2:]
    return mixed.repartitionByRange(shard, order).sortWithinPartitions(shard, order).drop(shard, order)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, in the order of the mix where the documents are read from its files; a row per document in them, with its place."""
    import public_tokenizers

    folder, order = scratch(spark, "corpus-tokens"), []
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ["file", "row"]
    except AnalysisException:  # no file's rows: in order of their ids
        pass
    tokens.write_tokens(docs, folder, tokens.Format(public_tokenizers.path("byte_bpe_50k.json"), end_id=0, width=2), order=order)
    return tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_stage), ("near-dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token output", token_stage)]

#: Near-dedup and tokenising can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
