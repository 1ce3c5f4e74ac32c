"""Citations against a library and a bibliography: listings, coverage, sets, renumbering and bulk remaps.

All operators are keyed by doc_id. Windows are per document; what joins a document's rows to the library is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def citation_listing(citations: DataFrame) -> DataFrame:
    """Each reference in order of appearance with its record's count in the document and the document's totals."""
    doc = Window.partitionBy("doc_id")
    # ranks in place of a set: no document's records are held at every of its rows
    ranked = citations.select("doc_id", "group_order", "ref_pos", "recnum", F.dense_rank().over(doc.orderBy("recnum")).alias("r"))
    counted = ranked.select("*", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "recnum")).alias("n_in_doc"))
    distinct = F.max("r").over(doc) - F.max(F.col("recnum").isNull().cast("int")).over(doc)
    return counted.select("doc_id", "group_order", "ref_pos", "recnum", "n_in_doc", F.max("group_order").over(doc).cast("long").alias("n_groups"), F.count(F.lit(1)).over(doc).alias("n_citations"), distinct.cast("long").alias("n_distinct"))


def live(library: DataFrame) -> DataFrame:
    """Records that aren't in the trash."""
    return library.where("coalesce(trash_state, 0) = 0")


def missing_from_library(citations: DataFrame, library: DataFrame) -> DataFrame:
    """Cited records that the library lacks or has in its trash, with the number of their citations."""
    return citations.join(live(library).select("rec_id"), "rec_id", "left_anti").groupBy("doc_id", "recnum").agg(F.count(F.lit(1)).alias("n"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def remap_recnums(missing: DataFrame, library: DataFrame, prefix: int = 25) -> DataFrame:
    """Missing records (recnum, author, year, title) to library records of the same first author and year.

    One candidate: it. Several: the first whose normalised title begins alike, else the first in library order. None: not_found.
    """
    lib = live(library).select(normalised(F.col("surname")).alias("k"), F.col("year").alias("y"), F.substring(normalised(F.col("title")), 1, prefix).alias("t"), F.col("rec_id").alias("new_id"))
    # what is asked of the records of an author and year are counts and minima, so a record missing meets one row, however many there are
    titled = lib.groupBy("k", "y", "t").agg(F.count("new_id").alias("n"), F.min("new_id").alias("alike"))
    named = titled.groupBy("k", "y").agg(F.sum("n").alias("candidates"), F.min("alike").alias("first"))
    asked = missing.select("recnum", "author", "year", "title").distinct().withColumn("k", normalised(F.col("author"))).withColumn("st", F.substring(normalised(F.col("title")), 1, prefix))
    best = asked.withColumn("y", F.col("year")).join(named, ["k", "y"], "left").join(titled.drop("n").withColumnRenamed("t", "st"), ["k", "y", "st"], "left")
    how = F.when(F.coalesce("candidates", F.lit(0)) == 0, "not_found").when(F.col("candidates") == 1, "only").when(F.col("alike").isNotNull(), "title").otherwise("first")
    return best.select("recnum", "author", "year", "title", F.coalesce("alike", "first").alias("new_id"), how.alias("how"))


def rebuild_lookup(broken: DataFrame, library: DataFrame) -> DataFrame:
    """Broken citations with their record, or an error."""
    lib = live(library).select("rec_id", F.col("title").alias("found_title"), F.col("surname").alias("found_author"))
    return broken.join(lib, "rec_id", "left").select("doc_id", "pos", "recnum", "found_author", "found_title", F.when(F.col("found_title").isNull(), F.concat(F.lit("record "), "recnum", F.lit(" not in library"))).alias("error"))


def coverage(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Per document and number: cited / uncited / no_entry, with how often it is cited. entries and cited: doc_id, num (cited with repeats)."""
    n = cited.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"))
    e = entries.select("doc_id", "num", F.lit(True).alias("has")).distinct()
    state = F.when(F.col("has").isNull(), "no_entry").when(F.col("n").isNull(), "uncited").otherwise("cited")
    return e.join(n, ["doc_id", "num"], "full_outer").select("doc_id", "num", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def uncovered_samples(entries: DataFrame, cited: DataFrame, paragraphs: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, num, n_locations, samples: cited numbers without an entry, in how many paragraphs each is cited, and the first 120 characters of the first `k` of them. entries: doc_id, num; cited: doc_id, num, para_idx; paragraphs: doc_id, para_idx, text."""
    at = cited.select("doc_id", "num", "para_idx").distinct().join(entries.select("doc_id", "num").distinct(), ["doc_id", "num"], "left_anti")
    n = at.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n_locations"))
    first = at.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "num").orderBy("para_idx"))).where(F.col("place") <= k)
    said = first.join(paragraphs.select("doc_id", "para_idx", F.substring(F.trim("text"), 1, 120).alias("text")), ["doc_id", "para_idx"], "left")
    shown = F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))))
    return n.join(said.groupBy("doc_id", "num").agg(shown["text"].alias("samples")), ["doc_id", "num"])


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy("doc_id", id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conversion_summary(resolutions: DataFrame) -> DataFrame:
    """Per document over markers and their references' states."""
    markers = resolutions.groupBy("doc_id", "marker_id").agg(F.bool_and(F.col("state") == "resolved").alias("done"))
    done = markers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("placeholders"), F.count_if("done").alias("fully_done"))
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    refs = resolutions.groupBy("doc_id").agg(of("resolved", "suggested").alias("applied"), of("suggested").alias("to_verify"), of("missing").alias("unresolved"), of("dangling").alias("dangling"))
    return done.join(refs, "doc_id")


def recnum_inspector(citations: DataFrame, expected_db: str) -> DataFrame:
    """First-seen author and year per record; what stands in instructions wins over blobs; blob-only records are hidden; library id ok, empty or wrong."""
    first = F.min(F.struct("hidden", "pos", "author", "cited_year", "db_id"))
    g = citations.groupBy("doc_id", "recnum").agg(first.alias("f"), F.bool_and("hidden").alias("hidden"))
    state = F.when(F.col("f.db_id") == "", "empty").when(F.col("f.db_id") == expected_db, "ok").otherwise("wrong")
    return g.select("doc_id", "recnum", F.col("f.author").alias("author"), F.col("f.cited_year").alias("year"), "hidden", state.alias("db_state"))


def embedded_library(citations: DataFrame) -> DataFrame:
    """The first record embedded for each number, numbered in numeric order; numbers that aren't digits come last."""
    first = citations.groupBy("doc_id", "recnum").agg(F.min_by(F.struct("author", "cited_year", "title"), "pos").alias("f"))
    by = Window.partitionBy("doc_id").orderBy(F.coalesce(F.expr("try_cast(recnum AS INT)"), F.lit(9999)), "recnum")
    return first.select("doc_id", F.row_number().over(by).alias("place"), "recnum", "f.author", F.col("f.cited_year").alias("year"), "f.title")


def broken_by_recnum(broken: DataFrame) -> DataFrame:
    return broken.groupBy("doc_id", "recnum").agg(F.min_by("author", "pos").alias("author"), F.min_by("cited_year", "pos").alias("year"), F.count(F.lit(1)).alias("n"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that right lacks."""
    return left.subtract(right)


def renumber_appearance(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, old, new: numbers by first appearance; uncited entries follow after the last new number in their old order."""
    first = cited.groupBy("doc_id", F.col("num").alias("old")).agg(F.min("pos").alias("at"))
    every = entries.select("doc_id", F.col("num").alias("old")).distinct().join(first, ["doc_id", "old"], "full_outer")
    order = Window.partitionBy("doc_id").orderBy(F.col("at").asc_nulls_last(), "old")
    return every.select("doc_id", "old", F.row_number().over(order).alias("new"), F.col("at").isNotNull().alias("cited"))


def renumber_alphabetical(entries: DataFrame) -> DataFrame:
    """doc_id, old, new by the lower-case last word of the first author; ties in bibliography order; of duplicate numbers the last wins."""
    last = entries.groupBy("doc_id", "num").agg(F.max(F.struct("pos", "author")).alias("e"))
    key = F.lower(F.element_at(F.split(F.trim("e.author"), r"\s+"), -1))
    order = Window.partitionBy("doc_id").orderBy(key, "e.pos")
    return last.select("doc_id", F.col("num").alias("old"), F.row_number().over(order).alias("new"))


def continuous_numbers(resolved: DataFrame) -> DataFrame:
    """A number for each resolved record by first appearance."""
    first = resolved.groupBy("doc_id", "rec_id").agg(F.min("pos").alias("at"))
    return first.select("doc_id", "rec_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("number"))


def apply_recnum_map(citations: DataFrame, mapping: DataFrame) -> DataFrame:
    """All citations with their records remapped at once, so no remap feeds another. mapping: old, new (unique by old; checked small or joined by shuffle, as Spark sees fit)."""
    return citations.join(mapping.select(F.col("old").alias("recnum"), "new"), "recnum", "left").withColumn("mapped", F.coalesce("new", "recnum"))


def parse_map_lines(lines: DataFrame) -> DataFrame:
    """`old -> new` lines; blank lines and comments skipped; others are errors."""
    t = F.trim("line")
    hit = F.regexp_extract(t, r"^(\d+)\s*->\s*(\d+)$", 1)
    return lines.where((t != "") & ~t.startswith("#")).select("line_no", F.nullif(hit, F.lit("")).alias("old"), F.nullif(F.regexp_extract(t, r"^(\d+)\s*->\s*(\d+)$", 2), F.lit("")).alias("new"), (hit == "").alias("error"))


def expanded_numbers(text: Column, max_span: int | None = 200) -> Column:
    """`1,3-5` to 1, 3, 4, 5. A range is expanded if its end exceeds its start, by less than max_span if that is given; else its ends stand."""
    pieces = F.filter(F.split(F.regexp_replace(text, "[–—]", "-"), "[,;]"), lambda p: p.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$"))
    ends = F.transform(pieces, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int")))  # one number, or two

    def one(e: Column) -> Column:
        a, b = e[0], e[F.size(e) - 1]
        fits = (b > a) if max_span is None else (b > a) & (b - a < max_span)
        return F.when(fits, F.sequence(a, b)).otherwise(F.filter(e, lambda x: x.isNotNull()))

    return F.flatten(F.transform(ends, one))


def number_listing(spans: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Citations by number, in order: doc_id, group_order, display, place, num, label (the number and its entry, or #number), n_in_doc, and the document's groups, citations and references.

    spans: doc_id, group_order, display (as `3, 5-7`); spans without a number are no groups. bibliography: doc_id, num, text (one per number).
    """
    rows = spans.select("doc_id", "group_order", F.trim("display").alias("display"), F.posexplode(expanded_numbers(F.col("display"), None)).alias("place", "num"))
    doc = Window.partitionBy("doc_id")
    ranked = rows.select("*", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "num")).alias("n_in_doc"), F.dense_rank().over(doc.orderBy("group_order")).alias("g"), F.count(F.lit(1)).over(doc).alias("n_citations"), F.dense_rank().over(doc.orderBy("num")).alias("r"))
    counted = ranked.select("*", F.max("g").over(doc).cast("long").alias("n_groups"), F.max("r").over(doc).cast("long").alias("n_references"))
    entry = bibliography.select("doc_id", F.col("num").cast("int").alias("num"), F.col("text").alias("entry"))
    label = F.when(F.col("entry").isNull(), F.concat(F.lit("#"), F.col("num").cast("string"))).otherwise(F.concat_ws(" — ", F.col("num").cast("string"), "entry"))
    # a bibliography can be unnested from few rows, by whose size Spark would take it for small
    return counted.join(entry.hint("merge"), ["doc_id", "num"], "left").select("doc_id", "group_order", "display", "place", "num", label.alias("label"), "n_in_doc", "n_groups", "n_citations", "n_references")


def top_k_per_key(scored: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def label_parts(label: Column) -> Column:
    """Sorting key of labels such as 2.10: integers, with 999 for what isn't a number."""
    return F.transform(F.split(label, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)))


def applied_number_map(text: Column, numbers: Column) -> Column:
    """A number list rewritten through a map<string,string>; what the map lacks stays, and so do the separators."""
    pieces = F.regexp_extract_all(text, F.lit(r"\d+|[^\d]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(numbers, x), x)), "")
