"""Bulk rewrites of texts: markers, maps, renames, entries, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_ids(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Old library ids in a text replaced by new ones, with the number of replacements."""
    out, n = F.col(column), F.lit(0)
    for old, new in mapping.items():
        n = n + (F.char_length(F.col(column)) - F.char_length(F.replace(F.col(column), F.lit(old), F.lit("")))) / len(old)
        out = F.replace(out, F.lit(old), F.lit(new))
    return rows.withColumns({"patched": out, "n_patched": n.cast("int")})


def reorder_bibliography(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entry texts with their new number, in the new order. entries: doc_id, num, text; mapping: doc_id, old, new."""
    j = entries.join(mapping.withColumnRenamed("old", "num"), ["doc_id", "num"])
    text = F.concat(F.col("new").cast("string"), F.lit(". "), F.regexp_replace("text", r"^\s*\d+[.)]?\s*", ""))
    return j.select("doc_id", "num", "new", text.alias("text"), F.row_number().over(Window.partitionBy("doc_id").orderBy("new", "num", "text")).alias("place"))


def replace_markers(paragraphs: DataFrame, markers: DataFrame) -> DataFrame:
    """Paragraphs rebuilt from their pieces, markers replaced. paragraphs: doc_id, para_idx, text; markers: doc_id, para_idx, start (1-based), raw, replacement (null: left as it is)."""
    m = markers.groupBy("doc_id", "para_idx").agg(F.array_sort(F.collect_list(F.struct("start", "raw", "replacement"))).alias("ms"))
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def build(text: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            piece = F.substring(text, s["at"], x["start"] - s["at"])
            return F.struct((x["start"] + F.char_length(x["raw"])).alias("at"), F.concat(s["out"], piece, F.coalesce(x["replacement"], x["raw"])).alias("out"))

        return F.aggregate("ms", state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"], F.char_length(text))))

    j = paragraphs.join(m, ["doc_id", "para_idx"], "left")
    return j.select("doc_id", "para_idx", F.when(F.col("ms").isNull(), F.col("text")).otherwise(build(F.col("text"))).alias("text"))


def batch_rename(rows: DataFrame, column: str, pairs: list[tuple[str, str]], ignore_case: bool = True, whole_words: bool = True) -> DataFrame:
    """Ordered find-and-replace pairs over all texts, literally; each pair is counted on the text as changed so far."""
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)
    out, counts = F.col(column), []
    for old, new in pairs:
        p = ("(?i)" if ignore_case else "") + (rf"\b{quote(old)}\b" if whole_words else quote(old))
        counts.append(F.regexp_count(out, F.lit(p)).cast("string"))
        out = F.regexp_replace(out, F.lit(p), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return rows.withColumns({"renamed": out, "counts": F.array_join(F.array(*counts), ",")})
