"""Queries over page geometry, books, rewrites, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.operators import citations as cit
from refweave.operators import layout as op
from refweave.operators import rewriting as rw
from refweave.plans.kit import BASE, CITATIONS, LIBRARY, Plans, citations, library, table, when_of
from refweave.sources import writers
from refweave.streaming import streams

P = Plans()

_SPANS = f"WITH {CITATIONS}, spans AS (SELECT doc_id, pos AS span, group_order AS block, 6.0 + rec_id % 7 AS size, (supp % 4 = 0)::INT + 16 * (supp % 3 = 0)::INT AS flags, author AS font FROM citations)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).select("doc_id", F.col("pos").alias("span"), F.col("group_order").alias("block"), (6.0 + F.col("rec_id") % 7).alias("size"), ((F.col("supp") % 4 == 0).cast("int") + 16 * (F.col("supp") % 3 == 0).cast("int")).alias("flags"), F.col("author").alias("font"))


@P.add(f"{_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, span) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM spans), m AS (SELECT doc_id, size AS median FROM r WHERE rn = n // 2 + 1) SELECT doc_id, span, size::DOUBLE AS size, median::DOUBLE AS median, flags % 2 = 1 OR size <= 0.85 * median AS superscript FROM spans JOIN m USING (doc_id)")
def median_size(spark: SparkSession, sf: str) -> DataFrame:
    return op.median_sizes(_spans(spark, sf))


@P.add(f"{_SPANS}, n AS (SELECT doc_id, block, size, count(*) AS n FROM spans GROUP BY ALL), t AS (SELECT doc_id, block, arg_max(size, struct_pack(a := n, b := size)) AS size FROM n GROUP BY ALL) SELECT doc_id, block, any_value(t.size)::DOUBLE AS size, bool_or(flags >= 16) AS bold, string_agg(DISTINCT font, ',' ORDER BY font) AS fonts FROM spans s JOIN t USING (doc_id, block) GROUP BY doc_id, block")
def dominant_size(spark: SparkSession, sf: str) -> DataFrame:
    return op.dominant_sizes(_spans(spark, sf))


_BLOCK_TEXT = "CASE supp % 7 WHEN 0 THEN 'Fig. 3 ' || author WHEN 1 THEN 'B' WHEN 2 THEN 'Type I. x Type II. y' WHEN 3 THEN author || '.' WHEN 4 THEN author || ' 12' ELSE author || ' and so' END"


@P.add(f"""WITH {CITATIONS}, b AS (SELECT doc_id, pos AS block, (rec_id % 300)::DOUBLE AS x0, (rec_id % 300 + 40 + supp % 300)::DOUBLE AS x1, (rec_id % 800)::DOUBLE AS y0, (rec_id % 800 + 12)::DOUBLE AS y1, 600.0 AS pw, 800.0 AS ph, 8.0 + supp % 8 AS size, {_BLOCK_TEXT} AS text FROM citations)
SELECT doc_id, block, CASE WHEN x1 - x0 > 0.62 * pw THEN -1 WHEN (x0 + x1) / 2 < pw / 2 THEN 0 ELSE 1 END AS "column", CASE WHEN y1 < 0.06 * ph THEN 'header' WHEN y0 > 0.94 * ph THEN 'footer' WHEN starts_with(text, 'Fig. 3') THEN 'caption' WHEN size < 9 THEN 'small' WHEN text = 'B' THEN 'label' WHEN text = 'Type I. x Type II. y' THEN 'list' WHEN size >= 14 THEN 'heading1' WHEN size >= 11.5 THEN 'heading2' ELSE 'text' END AS kind FROM b""")
def block_classify(spark: SparkSession, sf: str) -> DataFrame:
    b = citations(spark, sf).selectExpr("doc_id", "pos AS block", "double(rec_id % 300) AS x0", "double(rec_id % 300 + 40 + supp % 300) AS x1", "double(rec_id % 800) AS y0", "double(rec_id % 800 + 12) AS y1", "600.0D AS page_width", "800.0D AS page_height", "8.0D + supp % 8 AS size", f"{_BLOCK_TEXT} AS text")
    return op.classify_blocks(b)


_WORDS = """WITH RECURSIVE words AS (SELECT l_orderkey AS page, 36.0 + l_partkey % 540 AS x0, 36.0 + l_partkey % 540 + 20 + l_suppkey % 30 AS x1, 10.0 * floor(l_quantity / 5) + l_linenumber AS top, l_returnflag || l_suppkey AS text FROM lineitem),
p AS (SELECT *, sum((x0 < 306 - 30.6 AND x1 > 306 + 30.6)::INT) OVER (PARTITION BY page) AS ns, count(*) OVER (PARTITION BY page) AS n FROM words), c AS (SELECT *, CASE WHEN ns > greatest(4, 0.04 * n) THEN 0 WHEN (x0 + x1) / 2 < 306 THEN 0 ELSE 1 END AS col FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY page, col ORDER BY top, x0, text) AS i FROM c), f AS (SELECT page, col, i, text, top AS anchor, 1 AS line FROM k WHERE i = 1 UNION ALL SELECT k.page, k.col, k.i, k.text, CASE WHEN abs(k.top - anchor) > 3 THEN k.top ELSE anchor END, line + (abs(k.top - anchor) > 3)::INT FROM f JOIN k ON k.page = f.page AND k.col = f.col AND k.i = f.i + 1)
SELECT 0 AS doc_id, page, col AS "column", line, string_agg(text, ' ' ORDER BY i) AS text FROM f GROUP BY page, col, line"""


@P.add(_WORDS)
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "lineitem").select(
        F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("page"), F.lit(612.0).alias("page_width"), (36.0 + F.col("l_partkey") % 540).alias("x0"), (56.0 + F.col("l_partkey") % 540 + F.col("l_suppkey") % 30).alias("x1"),
        (10.0 * F.floor(F.col("l_quantity") / 5) + F.col("l_linenumber")).alias("top"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("text"),
    )
    return op.reading_order(w)


@P.add(f"""WITH {CITATIONS}, l AS (SELECT doc_id, pos AS line, (pos * 10 + CASE WHEN supp % 6 = 0 THEN 40 ELSE 0 END)::DOUBLE AS top, CASE WHEN rec_id % 3 = 0 THEN 'Table ' || supp || ' ' || author ELSE author END AS text FROM citations),
m AS (SELECT *, regexp_matches(text, '^Table') AS is_label, coalesce(abs(top - lag(top) OVER (PARTITION BY doc_id ORDER BY line)) > 26, false) AS far FROM l), c AS (SELECT *, sum(is_label::INT) OVER (PARTITION BY doc_id ORDER BY line) AS cap FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cap ORDER BY line) - 1 AS k, max((far AND NOT is_label)::INT) OVER (PARTITION BY doc_id, cap ORDER BY line) AS stopped FROM c WHERE cap > 0)
SELECT doc_id, cap, string_agg(text, ' ' ORDER BY line) AS caption, count(*) AS n_lines FROM k WHERE k <= 13 AND stopped = 0 GROUP BY ALL""")
def caption_collect(spark: SparkSession, sf: str) -> DataFrame:
    l = citations(spark, sf).select("doc_id", F.col("pos").alias("line"), (F.col("pos") * 10 + F.when(F.col("supp") % 6 == 0, 40).otherwise(0)).cast("double").alias("top"), F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("Table "), F.col("supp").cast("string"), F.lit(" "), "author")).otherwise(F.col("author")).alias("text"))  # noqa: E741
    return op.collect_captions(l)


_TOC = """WITH o AS (SELECT o_custkey % 50 AS book_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS page, o_orderkey, o_custkey FROM orders), toc AS (SELECT book_id, (1 + o_orderkey % 5)::INT AS level, (o_orderkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN ' - ' ELSE ' ' END || 'Chapter ' || o_custkey AS title, page FROM o WHERE o_orderkey % 7 = 0), last_page AS (SELECT book_id, max(page) AS last FROM o GROUP BY ALL),
e AS (SELECT book_id, regexp_extract(title, '^\\s*(\\d+)\\s*[-–]\\s*', 1)::INT AS chapter, title, page FROM toc WHERE level <= 4 AND regexp_matches(title, '^\\s*(\\d+)\\s*[-–]')), f AS (SELECT book_id, chapter, arg_min(title, struct_pack(a := page, b := title)) AS title, min(page) AS start FROM e GROUP BY ALL),
bounds AS (SELECT book_id, chapter, title, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY book_id ORDER BY start, chapter) - 1, last)) AS "end" FROM f JOIN last_page USING (book_id)),
pages AS (SELECT b.book_id, b.chapter, o.page, CASE WHEN o.o_orderkey % 4 = 0 THEN '' WHEN o.o_orderkey % 4 = 1 THEN (o.page + 7) || '.e' || (o.o_custkey % 9) ELSE (o.page + 7)::VARCHAR END AS label FROM bounds b JOIN o ON o.book_id = b.book_id AND o.page BETWEEN b.start AND b."end"),
kept AS (SELECT * FROM (SELECT *, max(page) FILTER (label <> '') OVER (PARTITION BY book_id, chapter) AS l FROM pages) WHERE page <= l)"""


def _outline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("book_id"), "o_orderkey", "o_custkey")
    o = o.withColumn("page", F.row_number().over(Window.partitionBy("book_id").orderBy("o_orderkey")))
    title = F.concat((F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " - ").otherwise(" "), F.lit("Chapter "), F.col("o_custkey").cast("string"))
    toc = o.where("o_orderkey % 7 = 0").select("book_id", (1 + F.col("o_orderkey") % 5).alias("level"), title.alias("title"), "page")
    return o, op.chapter_bounds(toc, o.groupBy("book_id").agg(F.max("page").alias("last")))


def _book_pages(spark: SparkSession, sf: str) -> DataFrame:
    o, b = _outline(spark, sf)
    label = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, F.concat((F.col("page") + 7).cast("string"), F.lit(".e"), (F.col("o_custkey") % 9).cast("string"))).otherwise((F.col("page") + 7).cast("string"))
    each = b.select("book_id", "chapter", F.explode(F.sequence("start", "end")).alias("page"))
    return each.join(o, ["book_id", "page"]).select("book_id", "chapter", "page", label.alias("label"))


@P.add(f'{_TOC} SELECT book_id, chapter, title, start, "end" FROM bounds')
def chapter_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _outline(spark, sf)[1]


@P.add(f"{_TOC} SELECT book_id, chapter, page, label FROM kept")
def trim_unlabelled_tail(spark: SparkSession, sf: str) -> DataFrame:
    return op.trim_unlabelled_tail(_book_pages(spark, sf))


@P.add(rf"""{_TOC}, r AS (SELECT *, regexp_matches(label, '^\d+\.e\d+$') AS ref FROM kept), g AS (SELECT book_id, chapter, min(page) AS start, max(page) AS "end", count(*) FILTER (NOT ref) AS n_body, count(*) FILTER (ref) AS n_ref, min(page) FILTER (ref) AS ref_start, arg_min(regexp_extract(label, '^(\d+)\.e', 1), page) FILTER (ref) AS base FROM r GROUP BY ALL)
SELECT *, base || '.e1-' || base || '.e' || n_ref AS printed FROM g""")
def chapter_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return op.chapter_ranges(_book_pages(spark, sf))


@P.add(rf"""WITH {CITATIONS}, b AS (SELECT doc_id, pos AS block, {_BLOCK_TEXT} AS text, supp % 5 = 0 AS bold FROM citations), s AS (SELECT *, coalesce(regexp_matches(regexp_replace(lag(text) OVER (PARTITION BY doc_id ORDER BY block), '\d+$', ''), '[.!?:)]\s*$') OR bold, true) AS starts FROM b),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY block) AS para FROM s) SELECT doc_id, para, string_agg(text, ' ' ORDER BY block) AS text FROM p GROUP BY ALL""")
def merge_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return op.merge_continuations(citations(spark, sf).select("doc_id", F.col("pos").alias("block"), F.expr(_BLOCK_TEXT).alias("text"), (F.col("supp") % 5 == 0).alias("bold")))


@P.add(f"WITH {CITATIONS}, n AS (SELECT doc_id, group_order AS page, CASE supp % 3 WHEN 0 THEN '*' WHEN 1 THEN '†' ELSE '‡' END AS mark, string_agg(recnum, ',' ORDER BY pos) AS numbers FROM citations WHERE flag = 'A' GROUP BY ALL) SELECT c.doc_id, c.group_order AS page, c.pos, '[' || numbers || ']' AS inlined FROM citations c JOIN n ON n.doc_id = c.doc_id AND n.page = c.group_order AND n.mark = CASE c.supp % 3 WHEN 0 THEN '*' WHEN 1 THEN '†' ELSE '‡' END WHERE c.flag <> 'A'")
def footnote_inline(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).withColumns({"page": F.col("group_order"), "mark": when_of(F.col("supp") % 3, {0: "*", 1: "†"}, F.lit("‡"))})
    notes = c.where("flag = 'A'").groupBy("doc_id", "page", "mark").agg(F.array_sort(F.collect_list(F.struct("pos", "recnum"))).alias("r")).select("doc_id", "page", "mark", F.array_join("r.recnum", ",").alias("numbers"))
    return op.inline_footnotes(c.where("flag <> 'A'").select("doc_id", "page", "pos", "mark"), notes)


@P.add(f"""WITH {CITATIONS}, f AS (SELECT doc_id, pos, CASE rec_id % 4 WHEN 0 THEN 'Fig' WHEN 1 THEN 'Table' WHEN 2 THEN 'Video' ELSE 'Box' END AS fig_type, (supp % 3 + 1) || '.' || (rec_id % 12) || CASE WHEN supp % 5 = 0 THEN 'B' ELSE '' END AS fig_num, supp % 4 AS page_num, pos AS caption_y FROM citations)
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE fig_type WHEN 'Fig' THEN 0 WHEN 'Table' THEN 1 WHEN 'Video' THEN 3 ELSE 2 END, split_part(fig_num, '.', 1)::INT, regexp_extract(fig_num, '\\.(\\d+)', 1)::INT, regexp_extract(fig_num, '([A-Z]?)$', 1), page_num, caption_y) AS place FROM f""")
def figure_order(spark: SparkSession, sf: str) -> DataFrame:
    f = citations(spark, sf).select(
        "doc_id", "pos", when_of(F.col("rec_id") % 4, {0: "Fig", 1: "Table", 2: "Video"}, F.lit("Box")).alias("fig_type"), F.concat((F.col("supp") % 3 + 1).cast("string"), F.lit("."), (F.col("rec_id") % 12).cast("string"), F.when(F.col("supp") % 5 == 0, "B").otherwise("")).alias("fig_num"), (F.col("supp") % 4).alias("page_num"), F.col("pos").alias("caption_y"),
    )
    return op.figure_order(f).select("doc_id", "pos", "place")


@P.add(f"""{BASE}, t AS (SELECT doc_id, pos, supp, 'db-id="' || CASE supp % 3 WHEN 0 THEN 'oldA' WHEN 1 THEN 'oldB' ELSE 'same' END || '" oldA' AS t FROM citations) SELECT doc_id, pos, replace(replace(t, 'oldA', 'newX'), 'oldB', 'newX') AS patched, 1 + (supp % 3 < 2)::INT AS n_patched FROM t""")
def patch_db_id(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).select("doc_id", "pos", F.concat(F.lit('db-id="'), when_of(F.col("supp") % 3, {0: "oldA", 1: "oldB"}, F.lit("same")), F.lit('" oldA')).alias("t"))
    return rw.patch_ids(c, "t", {"oldA": "newX", "oldB": "newX"}).drop("t")


@P.add(f"""{BASE}, e AS (SELECT doc_id, pos AS num, pos || '. ' || author || ' ' || cited_year AS text, author FROM citations), m AS (SELECT doc_id, num, row_number() OVER (PARTITION BY doc_id ORDER BY lower(author), num) AS new FROM e)
SELECT doc_id, num, new, new || '. ' || author || ' ' || substr(text, length(text) - 3) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY new) AS place FROM e JOIN m USING (doc_id, num)""")
def reorder_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    entries = c.select("doc_id", F.col("pos").alias("num"), F.concat(F.col("pos").cast("string"), F.lit(". "), "author", F.lit(" "), "cited_year").alias("text"))
    return rw.reorder_bibliography(entries, cit.renumber_alphabetical(c.select("doc_id", F.col("pos").alias("num"), "pos", "author")))


@P.add(f"""{BASE} SELECT doc_id, pos AS para_idx, 'See ' || CASE WHEN supp % 4 = 0 THEN '[' || supp || ']' ELSE '{{' || author || ', ' || cited_year || ' #' || recnum || '}}' END || ' and {{' || 'Ring, 1999 #1}}' || ' in ' || author || '.' AS text FROM citations""")
def replace_markers(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    first, second = F.concat(F.lit("["), F.col("supp").cast("string"), F.lit("]")), F.lit("[[REF 9]]")
    paras = c.select("doc_id", F.col("pos").alias("para_idx"), F.concat(F.lit("See "), first, F.lit(" and "), second, F.lit(" in "), "author", F.lit(".")).alias("text"))
    good = F.when(F.col("supp") % 4 != 0, F.concat(F.lit("{"), "author", F.lit(", "), "cited_year", F.lit(" #"), "recnum", F.lit("}")))
    m1 = c.select("doc_id", F.col("pos").alias("para_idx"), F.lit(5).alias("start"), first.alias("raw"), good.alias("replacement"))
    m2 = c.select("doc_id", F.col("pos").alias("para_idx"), (F.lit(10) + F.char_length(first)).alias("start"), second.alias("raw"), F.lit("{Ring, 1999 #1}").alias("replacement"))
    return rw.replace_markers(paras, m1.union(m2))


@P.add(r"""WITH t AS (SELECT doc_id, text AS t0, regexp_replace(text, '(?i)\bthe\b', 'le$1', 'g') AS t1 FROM documents), u AS (SELECT *, regexp_replace(t1, '(?i)\ble\$1\b', 'LA', 'g') AS t2, len(regexp_extract_all(t0, '(?i)\bthe\b')) AS n1, len(regexp_extract_all(t1, '(?i)\ble\$1\b')) AS n2 FROM t)
SELECT doc_id, md5(t2) AS renamed_md5, n1 || ',' || n2 AS counts FROM u""")
def batch_rename(spark: SparkSession, sf: str) -> DataFrame:
    out = rw.batch_rename(table(spark, sf, "documents").select("doc_id", "text"), "text", [("the", "le$1"), ("le$1", "LA")])
    return out.select("doc_id", F.md5(F.col("renamed").cast("binary")).alias("renamed_md5"), "counts")


_RECORDS = f"""WITH {LIBRARY}, records AS (SELECT *, CASE rec_id % 3 WHEN 0 THEN [surname, 'Other & Co'] WHEN 1 THEN [surname] ELSE []::VARCHAR[] END AS authors, CASE rec_id % 4 WHEN 0 THEN 'Book' WHEN 1 THEN 'Book Section' ELSE 'Journal Article' END AS type, CASE WHEN rec_id % 5 > 0 THEN rec_id || '-' || (rec_id + 9) ELSE rec_id::VARCHAR END AS pages, CASE WHEN rec_id % 2 = 0 THEN '10.1/' || rec_id END AS doi, CASE WHEN rec_id % 6 = 0 THEN '' ELSE (rec_id % 12)::VARCHAR END AS issue FROM library)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("rec_id")
    return library(spark, sf).withColumns({
        "authors": F.when(r % 3 == 0, F.array("surname", F.lit("Other & Co"))).when(r % 3 == 1, F.array("surname")).otherwise(F.array().cast("array<string>")), "type": when_of(r % 4, {0: "Book", 1: "Book Section"}, F.lit("Journal Article")),
        "pages": F.when(r % 5 > 0, F.concat(r.cast("string"), F.lit("-"), (r + 9).cast("string"))).otherwise(r.cast("string")), "doi": F.when(r % 2 == 0, F.concat(F.lit("10.1/"), r.cast("string"))), "issue": F.when(r % 6 == 0, "").otherwise((r % 12).cast("string")),
    })


@P.add(f"""{_RECORDS} SELECT rec_id, array_to_string(list_filter(['TY  - ' || CASE type WHEN 'Book' THEN 'BOOK' WHEN 'Book Section' THEN 'CHAP' ELSE 'JOUR' END] || list_transform(authors, lambda a: 'AU  - ' || a) || ['TI  - ' || title, 'JO  - ' || journal, 'PY  - ' || year, 'VL  - ' || volume, CASE WHEN issue <> '' THEN 'IS  - ' || issue END, 'SP  - ' || split_part(pages, '-', 1), CASE WHEN contains(pages, '-') THEN 'EP  - ' || split_part(pages, '-', 2) END, 'DO  - ' || doi, 'ER  - '], lambda x: x IS NOT NULL), chr(10)) AS value FROM records""")
def format_ris(spark: SparkSession, sf: str) -> DataFrame:
    return writers.ris(_records(spark, sf))


@P.add(f"""{_RECORDS} SELECT rec_id, array_to_string(list_filter(['%0 ' || type] || list_transform(authors, lambda a: '%A ' || a) || ['%T ' || title, '%J ' || journal, '%D ' || year, '%V ' || volume, CASE WHEN issue <> '' THEN '%N ' || issue END, '%P ' || pages, '%R ' || doi], lambda x: x IS NOT NULL), chr(10)) AS value FROM records""")
def format_enw(spark: SparkSession, sf: str) -> DataFrame:
    return writers.enw(_records(spark, sf))


@P.add(f"""{_RECORDS} SELECT rec_id, '<record><rec-number>' || rec_id || '</rec-number><contributors><authors>' || array_to_string(list_transform(authors, lambda a: '<author>' || replace(a, '&', '&amp;') || '</author>'), '') || '</authors></contributors><titles><title>' || title || '</title><secondary-title>' || journal || '</secondary-title></titles><dates><year>' || year || '</year></dates><volume>' || volume || '</volume><pages>' || pages || '</pages></record>' AS value FROM records""")
def write_library_xml(spark: SparkSession, sf: str) -> DataFrame:
    return writers.library_xml(_records(spark, sf))


@P.add(f"""{_RECORDS} SELECT title AS "Input", CASE WHEN doi IS NULL THEN 'notfound' ELSE 'found' END AS "Status", '' AS "Source", array_to_string(authors, '; ') AS "Authors", title AS "Title", journal AS "Journal", year AS "Year", volume AS "Volume", issue AS "Issue", pages AS "Pages", coalesce(doi, '') AS "DOI", '' AS "PMID", CASE WHEN doi IS NULL THEN 'no' ELSE 'yes' END AS "Included" FROM records""")
def write_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    found = F.col("doi").isNotNull()
    r = _records(spark, sf).select(
        F.col("title").alias("Input"), F.when(found, "found").otherwise("notfound").alias("Status"), F.array_join("authors", "; ").alias("Authors"), F.col("title").alias("Title"), F.col("journal").alias("Journal"), F.col("year").alias("Year"), F.col("volume").alias("Volume"),
        F.col("issue").alias("Issue"), F.col("pages").alias("Pages"), F.col("doi").alias("DOI"), F.when(found, "yes").otherwise("no").alias("Included"), "rec_id",
    )
    return writers.report(r)


@P.add(f"{BASE} SELECT rec_id AS num, '[[REF ' || rec_id || ']] -> ' || title AS value FROM library ORDER BY num")
def placeholder_list(spark: SparkSession, sf: str) -> DataFrame:
    return writers.placeholder_list(library(spark, sf).select(F.col("rec_id").alias("num"), F.col("title").alias("text"))).orderBy("num")


@P.add("SELECT DISTINCT trim(regexp_replace(regexp_replace(text, '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g')) AS value FROM documents")
def missing_reference_list(spark: SparkSession, sf: str) -> DataFrame:
    return writers.missing_references(table(spark, sf, "documents"))


@P.add("SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_type = 'error' THEN 'skipped' ELSE 'accepted' END AS action, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY ALL")
def decision_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's batch twin: the same function over the table."""
    return streams.decision_stream(table(spark, sf, "events"))


QUERIES, ORACLES = P.queries, P.oracles
