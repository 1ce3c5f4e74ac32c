"""Sinks: reference formats, reports and lists as text rows, written by Spark's text and CSV writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _tag(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), xml_escaped(value), F.lit(f"</{name}>"))).otherwise("")


def library_xml(records: DataFrame) -> DataFrame:
    """A `<record>` line per record. records: rec_id, authors, title, journal, year, volume, pages."""
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author>"), xml_escaped(a), F.lit("</author>"))), "")
    body = F.concat(F.lit("<record><rec-number>"), F.col("rec_id").cast("string"), F.lit("</rec-number><contributors><authors>"), authors, F.lit("</authors></contributors><titles>"), _tag("title", F.col("title")), _tag("secondary-title", F.col("journal")), F.lit("</titles><dates>"), _tag("year", F.col("year")), F.lit("</dates>"), _tag("volume", F.col("volume")), _tag("pages", F.col("pages")), F.lit("</record>"))
    return records.select("rec_id", body.alias("value"))


def _lines(pairs: list[tuple[str, Column]], authors: Column, author_tag: str, after: int) -> Column:
    rows = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(t), v)) for t, v in pairs]
    names = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.concat(F.lit(author_tag), a))
    return F.array_join(F.array_compact(F.concat(F.array(*rows[:after]), names, F.array(*rows[after:]))), "\n")


def ris(records: DataFrame) -> DataFrame:
    """RIS text per record, once per distinct record; pages are cut at the hyphen. records: rec_id, type, authors, title, journal, year, volume, issue, pages, doi."""
    c = F.col
    kind = F.when(c("type") == "Book", "BOOK").when(c("type") == "Book Section", "CHAP").otherwise("JOUR")
    page = lambda i: F.regexp_extract("pages", r"^([^-–]*)(?:[-–](.*))?$", i)
    text = _lines([("TY  - ", kind), ("TI  - ", c("title")), ("JO  - ", c("journal")), ("PY  - ", c("year")), ("VL  - ", c("volume")), ("IS  - ", c("issue")), ("SP  - ", page(1)), ("EP  - ", page(2)), ("DO  - ", c("doi"))], c("authors"), "AU  - ", 1)
    return records.dropDuplicates(["rec_id"]).select("rec_id", F.concat(text, F.lit("\nER  - ")).alias("value"))


def enw(records: DataFrame) -> DataFrame:
    c = F.col
    text = _lines([("%0 ", c("type")), ("%T ", c("title")), ("%J ", c("journal")), ("%D ", c("year")), ("%V ", c("volume")), ("%N ", c("issue")), ("%P ", c("pages")), ("%R ", c("doi"))], c("authors"), "%A ", 1)
    return records.dropDuplicates(["rec_id"]).select("rec_id", text.alias("value"))


#: The columns of the report, in order.
REPORT = ["Input", "Status", "Source", "Authors", "Title", "Journal", "Year", "Volume", "Issue", "Pages", "DOI", "PMID", "Included"]


def report(rows: DataFrame) -> DataFrame:
    """The report's columns, empty where rows lack them or hold null; further columns are left out."""
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in REPORT])


def placeholder_list(placeholders: DataFrame) -> DataFrame:
    """`[[REF n]] -> text` lines in order of number."""
    return placeholders.select("num", F.concat(F.lit("[[REF "), F.col("num").cast("string"), F.lit("]] -> "), "text").alias("value"))


def missing_references(texts: DataFrame) -> DataFrame:
    """Reference texts on one line, without end-of-line hyphens, each once."""
    one = F.trim(F.regexp_replace(F.regexp_replace("text", r"-\s*\n\s*", ""), r"\s+", " "))
    return texts.select(one.alias("value")).distinct()


def write_lines(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """value as text files, one folder per value of `partition` if that is given."""
    out = rows.select(*([partition] if partition else []), "value").write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).text(path)
