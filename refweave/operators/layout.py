"""Page geometry and book structure: sizes, columns, reading order, captions, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.operators.folding import ordered_fold


def median_sizes(spans: DataFrame) -> DataFrame:
    """Spans with their document's upper median size, and whether they are superscript: by flag bit 0 or at most 0.85 of the median."""
    doc = Window.partitionBy("doc_id")
    ranked = spans.withColumns({"rn": F.row_number().over(doc.orderBy("size", "span")), "n": F.count(F.lit(1)).over(doc)})
    median = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("size"))).over(doc)
    return ranked.withColumn("median", median).select("doc_id", "span", "size", "median", ((F.col("flags").bitwiseAND(1) == 1) | (F.col("size") <= 0.85 * F.col("median"))).alias("superscript"))


def dominant_sizes(spans: DataFrame) -> DataFrame:
    """Per block: the most frequent size (the greatest on ties), any bold, the fonts."""
    n = spans.groupBy("doc_id", "block", "size").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("doc_id", "block").agg(F.max(F.struct("n", "size"))["size"].alias("size"))
    rest = spans.groupBy("doc_id", "block").agg(F.bool_or(F.col("flags").bitwiseAND(16) == 16).alias("bold"), F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"))
    return top.join(rest, ["doc_id", "block"])


def classify_blocks(blocks: DataFrame, body: float = 10.0) -> DataFrame:
    """kind and column of layout blocks: header, footer, caption, small, label, list, heading or text; column -1 (full width), 0 or 1. blocks: doc_id, block, x0, x1, y0, y1, page_width, page_height, size, text."""
    wide = (F.col("x1") - F.col("x0")) > 0.62 * F.col("page_width")
    column = F.when(wide, -1).when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, 0).otherwise(1)
    t = F.trim("text")
    kind = F.when(F.col("y1") < 0.06 * F.col("page_height"), "header").when(F.col("y0") > 0.94 * F.col("page_height"), "footer").when(t.rlike(r"^(?:Fig|Figure|Table)\.?\s+\d"), "caption").when(F.col("size") < 9, "small").when(t.rlike(r"^[A-H]$"), "label")
    kind = kind.when(F.size(F.regexp_extract_all("text", F.lit(r"Type [IVX]+\."), F.lit(0))) >= 2, "list").when(F.col("size") >= body * 1.4, "heading1").when(F.col("size") >= body * 1.15, "heading2").otherwise("text")
    return blocks.select("doc_id", "block", column.alias("column"), kind.alias("kind"))


def reading_order(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Text lines of pages in reading order: doc_id, page, column, line, text.

    A page is in one column if more than max(4, 4 %) of its words span the middle band; words then go by column, top and left edge; a word joins a line
    when its top is within the tolerance of the line's first word. The fold goes through each page and column once.
    """
    c, band = F.col("page_width") / 2, F.col("page_width") * 0.05
    spans = (F.col("x0") < c - band) & (F.col("x1") > c + band)
    page = Window.partitionBy("doc_id", "page")
    marked = words.withColumns({"n_span": F.count_if(spans).over(page), "n": F.count(F.lit(1)).over(page)})
    column = F.when(F.col("n_span") > F.greatest(F.lit(4.0), 0.04 * F.col("n")), 0).when((F.col("x0") + F.col("x1")) / 2 < c, 0).otherwise(1)

    def step(state: tuple, row: tuple) -> tuple:
        anchor, line, k = state
        top, text = row[3], row[5]
        if anchor is None or abs(top - anchor) > tolerance:
            anchor, line = top, line + 1
        return (anchor, line, k + 1), (line, k, text)

    rows = marked.withColumn("column", column).select("doc_id", "page", "column", "top", "x0", "text")
    folded = ordered_fold(rows, ["doc_id", "page", "column"], ["top", "x0", "text"], (None, 0, 0), step, "line int, k int, text string")
    words = F.array_sort(F.collect_list(F.struct("k", "text")))
    return folded.groupBy("doc_id", "page", "column", "line").agg(F.array_join(words["text"], " ").alias("text"))


def collect_captions(lines: DataFrame, most: int = 13, gap: float = 26.0) -> DataFrame:
    """A label line and up to `most` lines after it, until the next label or a vertical gap. lines: doc_id, line, top, text."""
    order = Window.partitionBy("doc_id").orderBy("line")
    label = F.col("text").rlike(r"^(?:Fig|Figure|Table)\.?\s+\d")
    marked = lines.withColumns({"is_label": label, "far": F.coalesce(F.abs(F.col("top") - F.lag("top").over(order)) > gap, F.lit(False))})
    marked = marked.withColumn("cap", F.sum(F.col("is_label").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("cap > 0")
    inside = Window.partitionBy("doc_id", "cap").orderBy("line")
    marked = marked.withColumns({"k": F.row_number().over(inside) - 1, "stopped": F.max((F.col("far") & ~F.col("is_label")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    kept = marked.where((F.col("k") <= most) & (F.col("stopped") == 0))
    text = F.array_sort(F.collect_list(F.struct("line", "text")))
    return kept.groupBy("doc_id", "cap").agg(F.array_join(text["text"], " ").alias("caption"), F.count(F.lit(1)).alias("n_lines"))


def chapter_bounds(toc: DataFrame, last_page: DataFrame) -> DataFrame:
    """book_id, chapter, title, start, end: the first outline entry of each `N - title` of level 4 or less; a chapter ends before the next one starts, the last on the last page. toc: book_id, level, title, page; last_page: book_id, last."""
    number = F.regexp_extract("title", r"^\s*(\d+)\s*[-–]\s*", 1)
    entries = toc.where((F.col("level") <= 4) & (number != "")).withColumn("chapter", number.cast("int"))
    first = entries.groupBy("book_id", "chapter").agg(F.min(F.struct("page", "title")).alias("e")).select("book_id", "chapter", "e.title", F.col("e.page").alias("start"))
    nxt = F.lead("start").over(Window.partitionBy("book_id").orderBy("start", "chapter"))
    return first.withColumn("next", nxt).join(last_page, "book_id").select("book_id", "chapter", "title", "start", F.greatest(F.col("start"), F.coalesce(F.col("next") - 1, F.col("last"))).alias("end"))


def trim_unlabelled_tail(pages: DataFrame) -> DataFrame:
    """Pages of a chapter up to the last labelled one. pages: book_id, chapter, page, label ('' for none)."""
    last = F.max(F.when(F.col("label") != "", F.col("page"))).over(Window.partitionBy("book_id", "chapter"))
    return pages.withColumn("_last", last).where("page <= _last").drop("_last")


def chapter_ranges(pages: DataFrame) -> DataFrame:
    """Per chapter: pages, body and reference pages, and the printed base of its `.eN` labels."""
    ref = F.col("label").rlike(r"^\d+\.e\d+$")
    g = trim_unlabelled_tail(pages).withColumn("ref", ref).groupBy("book_id", "chapter").agg(
        F.min("page").alias("start"), F.max("page").alias("end"), F.count_if(~F.col("ref")).alias("n_body"), F.count_if("ref").alias("n_ref"), F.min(F.when(F.col("ref"), F.col("page"))).alias("ref_start"), F.min_by(F.regexp_extract("label", r"^(\d+)\.e", 1), F.when(F.col("ref"), F.col("page"))).alias("base"),
    )
    return g.withColumn("base", F.when(F.col("n_ref") > 0, F.col("base"))).withColumn("printed", F.when(F.col("n_ref") > 0, F.concat(F.col("base"), F.lit(".e1-"), F.col("base"), F.lit(".e"), F.col("n_ref").cast("string"))))


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Body blocks joined to the one before unless that ends a sentence (trailing digits aside) or the block starts bold. blocks: doc_id, block, text, bold."""
    order = Window.partitionBy("doc_id").orderBy("block")
    ended = F.regexp_replace(F.lag("text").over(order), r"\d+$", "").rlike(r"[.!?:)]\s*$")
    starts = F.coalesce(ended | F.col("bold"), F.lit(True))
    numbered = blocks.withColumn("para", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_sort(F.collect_list(F.struct("block", "text")))
    return numbered.groupBy("doc_id", "para").agg(F.array_join(text["text"], " ").alias("text"))


def inline_footnotes(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """Marker characters replaced by the reference numbers of the same page's footnote. marks: doc_id, page, pos, mark; notes: doc_id, page, mark, numbers."""
    return marks.join(notes, ["doc_id", "page", "mark"]).select("doc_id", "page", "pos", F.concat(F.lit("["), "numbers", F.lit("]")).alias("inlined"))


def figure_order(figures: DataFrame, by: str = "label") -> DataFrame:
    """Figures with their place: by page and caption, or by group, chapter, number and letter of the label."""
    num = lambda i: F.coalesce(F.regexp_extract("fig_num", r"^(\d*)\.?(\d*)([A-Za-z]?)", i).try_cast("int"), F.lit(0))
    group = F.when(F.col("fig_type") == "Fig", 0).when(F.col("fig_type") == "Table", 1).when(F.col("fig_type") == "Video", 3).otherwise(2)
    keys = [F.col("page_num"), F.col("caption_y"), F.col("label")] if by == "page" else [group, num(1), num(2), F.regexp_extract("fig_num", r"([A-Za-z]?)$", 1), F.col("page_num"), F.col("caption_y")]
    return figures.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)))
