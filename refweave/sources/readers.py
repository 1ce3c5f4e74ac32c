"""Readers: Word packages, library exports, catalogue dumps, sheets, scan caches. Each gives a canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.sources import packages

def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Runs of Word packages; unreadable packages give one row with an error. The other tables of packages are in read_package_tables."""
    return packages.scan_packages(packages.package_files(spark, path)).where("kind in ('run', 'error')").select(*packages.RUN)


def package_health(runs: DataFrame) -> DataFrame:
    """Runs per package and part, and the quarantine of unreadable packages."""
    return runs.groupBy("path", "part").agg(F.count("run_idx").alias("runs"), F.first("error").alias("error"))


def _bare(xml: Column) -> Column:
    """The text of an element with its style children's, entities decoded."""
    t = F.regexp_replace(xml, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def read_library_xml(spark: SparkSession, path: str) -> DataFrame:
    """library from an XML export; records without a title are dropped."""
    style = "string"
    schema = f"`rec-number` long, contributors struct<authors: struct<author: array<{style}>>>, titles struct<title: {style}, `secondary-title`: {style}>, dates struct<year: {style}>, volume {style}, pages {style}, abstract {style}, `foreign-keys` struct<key: array<struct<`_VALUE`: string, `_db-id`: string>>>"
    x = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)
    authors = F.transform(F.coalesce("contributors.authors.author", F.array().cast("array<string>")), _bare)
    out = x.select(
        F.col("rec-number").alias("rec_id"), authors.alias("authors"), F.regexp_extract(F.try_element_at(authors, F.lit(1)), r"^([^,]+)", 1).alias("surname"), F.regexp_extract(_bare(F.col("dates.year")), r"(\d{4})", 1).alias("year"), _bare(F.col("titles.title")).alias("title"), _bare(F.col("titles.secondary-title")).alias("journal"),
        _bare(F.col("volume")).alias("volume"), _bare(F.col("pages")).alias("pages"), _bare(F.col("abstract")).alias("abstract"), F.col("foreign-keys.key")[0]["_db-id"].alias("db_id"),
    )
    return out.where("coalesce(title, '') <> ''").withColumn("corpus", F.concat_ws(" ", "title", "abstract", "journal", "year"))


def read_db_id(spark: SparkSession, path: str) -> DataFrame:
    """The first library id (20 to 45 letters and digits) of each export file."""
    t = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.regexp_extract("value", r'db-id="([A-Za-z0-9]{20,45})"', 1).alias("db_id"))
    return t.where("db_id <> ''")


def sniff_columns(columns: list[str], first: tuple[str, ...], second: tuple[str, ...]) -> tuple[str | None, str | None]:
    """The first column whose lower-case name holds one of the hints, for each of the two."""
    find = lambda hints, used=None: next((c for c in columns if c != used and any(h in c.lower() for h in hints)), None)
    a = find(first)
    return a, find(second, a)


def read_naming_sheet(spark: SparkSession, path: str, rename: bool = False) -> DataFrame:
    """(number, label), or with `rename` (old, new), from a sheet with any headers; blank rows and renames to the same are dropped."""
    sheet = spark.read.option("header", "true").csv(path)
    # What headers hold.
    hints = (("old", "current", "find", "original", "from"), ("new", "replace", "final", "to", "updated")) if rename else (("num", "#"), ("name", "caption", "title", "new", "label"))
    a, b = sniff_columns(sheet.columns, *hints)
    if a is None or b is None:
        raise ValueError(f"no columns found in {sheet.columns}")
    out = sheet.select(F.trim(F.col(f"`{a}`")).alias("old" if rename else "number"), F.trim(F.col(f"`{b}`")).alias("new" if rename else "label"))
    x, y = out.columns
    kept = out.where(f"coalesce({x}, '') <> '' and coalesce({y}, '') <> ''")
    return kept.where(f"{x} <> {y}") if rename else kept


# Article types of the catalogue and what they are called here. Others are journal articles.
CATALOG_TYPES = {
    "journal-article": "Journal Article", "proceedings-article": "Conference Paper", "book-chapter": "Book Section", "book": "Book", "book-part": "Book Section", "monograph": "Book", "reference-book": "Book", "edited-book": "Edited Book",
    "report": "Report", "dataset": "Dataset", "dissertation": "Thesis", "posted-content": "Journal Article",
}
_DATES = "struct<`date-parts`: array<array<int>>>"
ARTICLE = f"DOI string, type string, title array<string>, `container-title` array<string>, author array<struct<family: string, given: string, name: string>>, issued {_DATES}, `published-print` {_DATES}, `published-online` {_DATES}, volume string, issue string, page string, ISSN array<string>"


def read_catalog_articles(spark: SparkSession, path: str) -> DataFrame:
    """catalog from an article JSON dump (a record per line): print year before issued before online; first title and container."""
    x = spark.read.schema(ARTICLE).json(path)
    year = lambda c: F.col(f"`{c}`.`date-parts`")[0][0]
    types = F.create_map(*[F.lit(v) for kv in CATALOG_TYPES.items() for v in kv])
    name = F.transform(F.coalesce("author", F.array().cast("array<struct<family:string,given:string,name:string>>")), lambda a: F.coalesce(F.concat_ws(", ", a["family"], a["given"]), a["name"]))
    return x.select(
        F.lit("articles").alias("source"), F.lower("DOI").alias("doi"), F.coalesce(F.try_element_at(types, F.col("type")), F.lit("Journal Article")).alias("type"), F.filter(F.transform(F.arrays_zip(name.alias("n"), F.col("author").alias("a")), lambda z: F.when(z["n"] != "", z["n"]).otherwise(z["a"]["name"])), lambda n: n.isNotNull()).alias("authors"),
        F.col("title")[0].alias("title"), F.col("container-title")[0].alias("journal"), F.coalesce(year("published-print"), year("issued"), year("published-online")).cast("string").alias("year"), "volume", "issue", F.col("page").alias("pages"), F.try_element_at("ISSN", F.lit(1)).alias("issn"),
    )


DOCSUM = "uid string, title string, authors array<struct<name: string>>, articleids array<struct<idtype: string, value: string>>, fulljournalname string, source string, issn string, essn string, pubdate string, epubdate string, sortpubdate string, volume string, issue string, pages string"


def read_catalog_docsums(spark: SparkSession, path: str) -> DataFrame:
    """catalog from document summaries (a record per line): `Family II` becomes `Family, II`; the year is the first of 4 digits in the dates."""
    x = spark.read.schema(DOCSUM).json(path)
    authors = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: F.regexp_replace(a["name"], r"^(.+)\s+([A-Z]{1,3})$", "$1, $2"))
    doi = F.filter("articleids", lambda a: a["idtype"] == "doi")
    year = F.regexp_extract(F.concat_ws(" ", "pubdate", "epubdate", "sortpubdate"), r"\b(\d{4})\b", 1)
    return x.select(F.lit("summaries").alias("source"), F.lower(F.try_element_at(doi, F.lit(1))["value"]).alias("doi"), F.col("uid").alias("pmid"), authors.alias("authors"), F.regexp_replace("title", r"\.$", "").alias("title"), F.coalesce(F.nullif("fulljournalname", F.lit("")), "source").alias("journal"), year.alias("year"), "volume", "issue", "pages", F.coalesce(F.nullif("issn", F.lit("")), "essn").alias("issn"))


ARTICLE_XML = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Pagination: struct<MedlinePgn: string>, AuthorList: struct<Author: array<struct<LastName: string, Initials: string>>>, "
    "Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<Volume: string, Issue: string, PubDate: struct<Year: string, MedlineDate: string>>>>>, PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"
)


def read_catalog_article_xml(spark: SparkSession, path: str, most_authors: int = 6, abstract_chars: int = 600) -> DataFrame:
    """catalog from article XML: the first `most_authors` authors with a last name, each with initials; the journal's title, else its abbreviation; the year, else the first four characters of the date in words.

    Elements inside titles and abstracts lose their tags; missing ones are empty; records that aren't XML are left out.
    """
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "DROPMALFORMED").schema(ARTICLE_XML).load(path)
    a, j = "MedlineCitation.Article", "MedlineCitation.Article.Journal"
    or_empty = lambda c: F.coalesce(_bare(F.col(c)), F.lit(""))
    first_of = lambda one, other: F.coalesce(F.nullif(F.trim(one), F.lit("")), other, F.lit(""))
    ids = F.coalesce("PubmedData.ArticleIdList.ArticleId", F.array().cast("array<struct<_IdType:string,_VALUE:string>>"))
    of_kind = lambda k: F.coalesce(F.try_element_at(F.filter(ids, lambda i: i["_IdType"] == k), F.lit(1))["_VALUE"], F.lit(""))
    authors = F.slice(F.coalesce(f"{a}.AuthorList.Author", F.array().cast("array<struct<LastName:string,Initials:string>>")), 1, most_authors)
    named = F.transform(F.filter(authors, lambda n: F.coalesce(n["LastName"], F.lit("")) != ""), lambda n: F.trim(F.concat_ws(" ", n["LastName"], n["Initials"])))
    abstract = F.array_join(F.transform(F.coalesce(f"{a}.Abstract.AbstractText", F.array().cast("array<string>")), _bare), " ")
    return x.select(
        F.lit("articles").alias("source"), of_kind("doi").alias("doi"), or_empty("MedlineCitation.PMID").alias("pmid"), of_kind("pmc").alias("pmc"), named.alias("authors"), or_empty(f"{a}.ArticleTitle").alias("title"), first_of(F.col(f"{j}.Title"), F.col(f"{j}.ISOAbbreviation")).alias("journal"),
        first_of(F.col(f"{j}.JournalIssue.PubDate.Year"), F.substring(f"{j}.JournalIssue.PubDate.MedlineDate", 1, 4)).alias("year"), or_empty(f"{j}.JournalIssue.Volume").alias("volume"), or_empty(f"{j}.JournalIssue.Issue").alias("issue"), or_empty(f"{a}.Pagination.MedlinePgn").alias("pages"), F.substring(abstract, 1, abstract_chars).alias("abstract"),
    )


SCAN = "page_count int, figures array<struct<source: string, page_num: int, fig_type: string, fig_num: string, label: string, caption: string, caption_y: int, include: boolean, crop_top: int, crop_bot: int>>"


def read_scan_cache(spark: SparkSession, path: str, page_counts: DataFrame) -> DataFrame:
    """figures from scan caches that are still valid: those with the current page count. page_counts: project, page_count; a cache belongs to the project its file is named after."""
    x = spark.read.schema(SCAN).option("multiLine", "true").json(path).withColumn("project", F.regexp_extract(F.input_file_name(), r"([^/]+)\.scan\.json$", 1))
    return x.join(page_counts, ["project", "page_count"], "left_semi").select("project", F.explode("figures").alias("f")).select("project", "f.*")
