"""Queries that read markers, captions and bibliographies out of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import text as tx
from refweave.operators import extraction as op
from refweave.plans.kit import CITATIONS, Plans, citations, table

P = Plans()

_S = "CAST({} AS STRING)".format
#: Paragraphs of every kind, from a citation row; the same text in both dialects.
_TEXT = f"""CASE rec_id % 8
WHEN 0 THEN 'The ' || author || ' holds [' || {_S('supp % 30 + 1')} || '] here. Then (' || {_S('supp % 9 + 1')} || '-' || {_S('supp % 9 + 4')} || ') too.'
WHEN 1 THEN 'As shown [[REF ' || {_S('supp % 20 + 1')} || ', ' || {_S('supp % 20 + 3')} || ']] in ' || author || '.'
WHEN 2 THEN 'Work by (' || upper(substr(author, 1, 1)) || substr(author, 2) || ', ' || cited_year || '; Other ' || rec_year || '; none) and (' || cited_year || ').'
WHEN 3 THEN 'Cited {{' || author || ', ' || cited_year || ' #' || recnum || '}} and {{Ring, 1999 #' || {_S('supp')} || '}}.'
WHEN 4 THEN 'This needs [citation needed]. Next XXX is here! And [ ] is ' || author || '. End.'
WHEN 5 THEN 'Figure ' || {_S('supp % 5 + 1')} || '.' || {_S('rec_id % 7')} || '. The ' || title
WHEN 6 THEN 'See Figures 2.1 and 2.' || {_S('supp % 9')} || ' or Table ' || {_S('supp % 4 + 1')} || ' for ' || author || {_S('supp % 50 + 1')} || ', ok.'
ELSE 'Video ' || {_S('supp % 3 + 1')} || ' ' || author || '  with  gaps B' END"""
_RUN = f"CASE rec_id % 5 WHEN 0 THEN {_S('supp % 40 + 1')} WHEN 1 THEN ', ' WHEN 2 THEN author WHEN 3 THEN author || ' mm' ELSE {_S('supp % 9 + 1')} || '-' || {_S('supp % 9 + 3')} END"
_REF = f"""{_S('pos')} || '. ' || upper(substr(author, 1, 1)) || substr(author, 2) || CASE WHEN supp % 3 = 0 THEN ' AB, Other C' ELSE ' D' END || '. ' || title || '. J ' || author || '. ' || cited_year || ';' || {_S('supp')} || '(' || {_S('supp % 12 + 1')} || '):' || {_S('rec_id')} || '-' || {_S('rec_id + 9')} || '.'"""
_BIB_TEXT = f"CASE WHEN pos = 1 THEN 'Body text with nothing' WHEN pos = 2 THEN 'References' WHEN supp % 13 = 0 THEN 'Section ' || author WHEN supp % 17 = 0 THEN '1. Restart AB. A long enough title here 1980.' ELSE {_REF} END"
#: Each document's paragraphs in one stream of lines.
_CTE = f"""WITH {CITATIONS}, paragraphs AS (SELECT *, pos AS para_idx, {_TEXT} AS text FROM citations), runs AS (SELECT doc_id, group_order AS para_idx, ref_pos AS run_idx, {_RUN} AS text, CASE WHEN supp % 2 = 0 THEN 'superscript' END AS vert_align, CASE WHEN supp % 3 > 0 THEN 'yellow' END AS highlight,
  CASE supp % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' WHEN 2 THEN 'moveFrom' WHEN 3 THEN 'moveTo' ELSE 'none' END AS tracked, CASE WHEN supp % 7 = 0 THEN ' ADDIN EN.CITE ' END AS instr FROM citations),
bib AS (SELECT doc_id, pos AS para_idx, {_BIB_TEXT} AS text FROM citations)"""


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).select("doc_id", F.col("pos").alias("para_idx"), F.expr(_TEXT).alias("text"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).selectExpr(
        "doc_id", "group_order AS para_idx", "ref_pos AS run_idx", f"{_RUN} AS text", "CASE WHEN supp % 2 = 0 THEN 'superscript' END AS vert_align", "CASE WHEN supp % 3 > 0 THEN 'yellow' END AS highlight",
        "CASE supp % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' WHEN 2 THEN 'moveFrom' WHEN 3 THEN 'moveTo' ELSE 'none' END AS tracked", "CASE WHEN supp % 7 = 0 THEN ' ADDIN EN.CITE ' END AS instr",
    )


def _bib(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).select("doc_id", F.col("pos").alias("para_idx"), F.expr(_BIB_TEXT).alias("text"))


def _hits(source: str, pattern: str, extra: str = "") -> str:
    """SQL rows of hits: doc_id, para_idx, n, start, hit."""
    p = pattern.replace("'", "''")
    return f"""h0 AS (SELECT doc_id, para_idx, text, regexp_extract_all(text, '{p}') AS hs, string_split_regex(text, '{p}') AS ps FROM {source}),
h AS (SELECT doc_id, para_idx, text, n - 1 AS n, hs[n] AS hit, 1 + list_sum(list_transform(ps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:n - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS n FROM h0))"""


@P.add(rf"""{_CTE}, {_hits('paragraphs', op.MISSING)}, s AS (SELECT doc_id, para_idx, n, start, hit AS marker, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss, text FROM h)
SELECT doc_id, para_idx, n, start::INT AS start, marker, coalesce(list_extract(list_filter(ss, lambda x, i: list_sum(list_transform(ss[1:i], lambda y: length(y) + 1)) >= start), 1), text) AS sentence FROM s""")
def missing_markers(spark: SparkSession, sf: str) -> DataFrame:
    return op.missing_markers(_paragraphs(spark, sf))


_TEMP = r"\{[^{},]+,\s*\d{4}\s*#\d+\}"


@P.add(rf"""{_CTE}, {_hits('paragraphs', _TEMP)} SELECT doc_id, para_idx, n, start::INT AS start, regexp_extract(hit, '\{{([^,]+),', 1) AS author, regexp_extract(hit, ',\s*(\d{{4}})', 1) AS year, regexp_extract(hit, '#(\d+)', 1) AS recnum FROM h""")
def temp_citations(spark: SparkSession, sf: str) -> DataFrame:
    return op.temp_citations(_paragraphs(spark, sf))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).select("doc_id", (F.col("supp") % 15 + 1).alias("num"))


@P.add(rf"""{_CTE}, {_hits('paragraphs', r'\[\[REF\s+[\d,\s–-]+\]\]|\[\d[\d,\s–-]*\]|\(\d[\d,\s–-]*\)')}, k AS (SELECT doc_id, para_idx, n, start::INT AS start, hit AS raw, CASE WHEN starts_with(hit, '[[') THEN 'ref' WHEN starts_with(hit, '[') THEN 'bracket' ELSE 'paren' END AS kind,
  CASE WHEN contains(hit, '-') THEN range(regexp_extract(hit, '(\d+)', 1)::INT, regexp_extract(hit, '-(\d+)', 1)::INT + 1) ELSE list_transform(regexp_extract_all(hit, '\d+'), lambda x: x::INT) END AS nums FROM h),
known AS (SELECT DISTINCT doc_id, supp % 15 + 1 AS num FROM citations)
SELECT doc_id, para_idx, n, start, kind, raw, array_to_string(nums, ',') AS nums FROM k WHERE kind = 'ref' OR EXISTS (SELECT 1 FROM known WHERE known.doc_id = k.doc_id AND list_contains(k.nums, known.num))""")
def numbered_markers(spark: SparkSession, sf: str) -> DataFrame:
    return op.numbered_markers(_paragraphs(spark, sf), _known(spark, sf)).withColumn("nums", F.array_join(F.col("nums").cast("array<string>"), ","))


@P.add(rf"""{_CTE}, t AS (SELECT doc_id, para_idx, n - 1 AS n, hs[n] AS raw FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS n FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '\([^()]*\b(?:18|19|20)\d\d[^()]*\)') AS hs FROM paragraphs))),
q AS (SELECT doc_id, para_idx, n, k - 1 AS k, trim(ps[k]) AS hint FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, string_split(raw[2:-2], ';') AS ps FROM t)))
SELECT doc_id, para_idx, n, k, regexp_extract(hint, '([A-Z][A-Za-z''-]+)', 1) AS surname, regexp_extract(hint, '\b((?:18|19|20)\d\d)', 1) AS year, hint FROM q WHERE regexp_matches(hint, '\d')""")
def typed_citations(spark: SparkSession, sf: str) -> DataFrame:
    return op.typed_citations(_paragraphs(spark, sf))


@P.add(rf"""{_CTE}, r AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx), '') AS before FROM runs)
SELECT doc_id, para_idx, run_idx, text FROM r WHERE vert_align = 'superscript' AND regexp_matches(text, '^[\d,;\s–-]*\d[\d,;\s–-]*$') AND NOT regexp_matches(before, '(?:^|[\s\d])(?:mm|cm|m|km|kg|s|[a-zA-Z])$')""")
def superscript_citations(spark: SparkSession, sf: str) -> DataFrame:
    return op.superscript_citations(_runs(spark, sf))


@P.add(rf"""{_CTE}, f AS (SELECT *, sum((highlight IS NULL AND NOT regexp_matches(text, '^[\s,;–-]*$'))::INT) OVER (PARTITION BY doc_id, para_idx ORDER BY run_idx) AS g FROM runs)
SELECT doc_id, para_idx, min(run_idx) FILTER (highlight IS NOT NULL) AS first_run, max(run_idx) FILTER (highlight IS NOT NULL) AS last_run, string_agg(text, '|' ORDER BY run_idx) FILTER (highlight IS NOT NULL) AS texts FROM f GROUP BY doc_id, para_idx, g HAVING count(highlight) > 0""")
def highlight_groups(spark: SparkSession, sf: str) -> DataFrame:
    return op.highlight_groups(_runs(spark, sf))


_CAP = rf"""c AS (SELECT doc_id, para_idx, regexp_extract(text, '{op.CAPTION}', 1) AS t, regexp_extract(text, '{op.CAPTION}', 2) AS fig_num, regexp_extract(text, '{op.CAPTION}', 3) AS caption FROM paragraphs WHERE regexp_matches(text, '{op.CAPTION}')),
k AS (SELECT *, CASE WHEN t IN ('Figure', 'Fig') THEN 'Fig' ELSE t END AS fig_type FROM c), figures AS (SELECT doc_id, arg_min(para_idx, para_idx) AS para_idx, fig_type, fig_num, fig_type || ' ' || fig_num AS label, arg_min(caption, para_idx) AS caption FROM k GROUP BY doc_id, fig_type, fig_num)"""


@P.add(f"{_CTE}, {_CAP} SELECT doc_id, para_idx, fig_type, fig_num, label, caption FROM figures")
def caption_scan(spark: SparkSession, sf: str) -> DataFrame:
    return op.caption_scan(_paragraphs(spark, sf))


_STYLE = "CASE supp % 6 WHEN 0 THEN 'Caption' WHEN 1 THEN 'Figure caption' ELSE 'Normal' END"


@P.add(rf"""{_CTE}, f AS (SELECT doc_id, para_idx, trim(text) AS t, {_STYLE} AS style, supp % 5 = 0 AS has_image, lower(replace(regexp_extract(text, '{op.FIGURE}', 1), '.', '')) AS w FROM paragraphs)
SELECT doc_id, para_idx, CASE WHEN w IN ('fig', 'figure') THEN 'Figure' WHEN w <> '' THEN upper(w[1]) || w[2:] WHEN has_image THEN 'Image' ELSE 'Caption' END AS fig_type, regexp_extract(t, '{op.FIGURE}', 2) AS fig_num, substr(t, 1, 250) AS caption, has_image, style FROM f WHERE w <> '' OR has_image OR contains(lower(style), 'caption')""")
def figure_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return op.figure_paragraphs(citations(spark, sf).select("doc_id", F.col("pos").alias("para_idx"), F.expr(_TEXT).alias("text"), F.expr(_STYLE).alias("style"), (F.col("supp") % 5 == 0).alias("has_image")))


_SPARSE = f"CASE WHEN supp % 4 = 0 THEN '' ELSE {_TEXT} END"


@P.add(rf"""{_CTE}, a AS (SELECT doc_id, pos AS para_idx, supp % 5 = 0 AS has_image, coalesce(list(trim({_SPARSE})) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), []) AS ahead FROM citations),
b AS (SELECT *, coalesce(list_position(list_transform(ahead[1:7], lambda x: regexp_matches(x, '{op.LABEL}') OR length(x) > 20), true), 0) AS hit FROM a WHERE has_image), c AS (SELECT *, CASE WHEN hit > 0 THEN ahead[hit] ELSE '' END AS f FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(f, '{op.LABEL}') THEN ahead[hit + 1:hit + 5] ELSE [] END AS rest FROM c), e AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: x = '' OR regexp_matches(x, '{op.LABEL}')), true), 0) AS stop FROM d)
SELECT doc_id, para_idx, regexp_replace(trim(regexp_replace(array_to_string([f] || CASE WHEN stop > 0 THEN rest[1:stop - 1] ELSE rest END, ' '), '\s+', ' ', 'g')), '(?:\s+[A-Z]){{2,}}$', '') AS caption FROM e""")
def image_captions(spark: SparkSession, sf: str) -> DataFrame:
    return op.image_captions(citations(spark, sf).select("doc_id", F.col("pos").alias("para_idx"), F.expr(_SPARSE).alias("text"), (F.col("supp") % 5 == 0).alias("has_image")))


_LONG = "CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 300) || ' Table 4 ' || substr(text, 301) ELSE text END"


@P.add(rf"""WITH o AS (SELECT doc_id, regexp_replace(trim(regexp_replace({_LONG}, '\s+', ' ', 'g')), '{op.NEXT_LABEL}', '\1') AS c FROM documents), s AS (SELECT *, regexp_extract(substr(c, 1, 600), '^(.*)\. ', 1) AS s FROM o)
SELECT doc_id, CASE WHEN length(c) <= 600 THEN c WHEN length(s) > 60 THEN s || '.' ELSE substr(c, 1, 600) END AS caption FROM s""")
def caption_cut(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", op.cut_caption(F.expr(_LONG)).alias("caption"))


@P.add(f"{_CTE}, {_CAP} SELECT fig_type, count(*) AS n, grouping(fig_type) AS is_total FROM figures GROUP BY ROLLUP (fig_type)")
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op.caption_scan(_paragraphs(spark, sf)).rollup("fig_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("fig_type").cast("long").alias("is_total"))


@P.add(f"{_CTE}, {_CAP} SELECT doc_id, label, 'PDF page ' || para_idx || ', printed ' || fig_num AS place FROM figures WHERE fig_type = 'Video'")
def video_index(spark: SparkSession, sf: str) -> DataFrame:
    return op.video_index(op.caption_scan(_paragraphs(spark, sf)))


@P.add(f"{_CTE}, {_CAP} SELECT * FROM figures WHERE contains(lower(caption), 'ring') OR contains(lower(label), 'ring')")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return op.keyword_filter(op.caption_scan(_paragraphs(spark, sf)), ["caption", "label"], "Ring")


@P.add(rf"""{_CTE}, t AS (SELECT doc_id, para_idx, n - 1 AS n, hs[n] AS callout FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS n FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '{op.CALLOUT}') AS hs FROM paragraphs)))
SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_in_doc FROM t""")
def callouts(spark: SparkSession, sf: str) -> DataFrame:
    return op.callouts(_paragraphs(spark, sf))


@P.add(f"{_CTE} SELECT doc_id, para_idx, run_idx, text, tracked FROM runs WHERE tracked NOT IN ('del', 'moveFrom')")
def effective_runs(spark: SparkSession, sf: str) -> DataFrame:
    return op.effective_runs(_runs(spark, sf)).select("doc_id", "para_idx", "run_idx", "text", "tracked")


@P.add("SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part FROM lineitem WHERE l_orderkey BETWEEN 45 AND 92 OR l_orderkey = 100 OR l_orderkey BETWEEN 400 AND 500")
def page_filter(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))  # noqa: E741
    return op.page_filter(l, "45-92, 100,400-9999,x", 500)


@P.add(r"""WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '\s+[A-H]$', '')) AS ls, string_split(text, chr(10)) AS raw FROM documents)
SELECT doc_id, i - 1 AS line, ls[i] AS cleaned, length(raw[i]) - length(ls[i]) AS removed FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.withColumn("cleaned", tx.cleaned(F.col("raw"))).select("doc_id", "line", "cleaned", (F.char_length("raw") - F.char_length("cleaned")).alias("removed"))


@P.add(f"""{_CTE}, e AS (SELECT doc_id, pos AS num, {_REF} AS text FROM citations WHERE flag <> 'R'), c AS (SELECT doc_id, supp % 6 + 1 AS num, pos FROM citations), w AS (SELECT doc_id, num, list_sort(list(DISTINCT pos)) AS at_ FROM c GROUP BY ALL)
SELECT doc_id, num, text, at_ IS NOT NULL AS cited, array_to_string(at_[1:2], ',') AS places FROM e LEFT JOIN w USING (doc_id, num) WHERE contains(lower(text), 'bolt')""")
def reference_search(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    entries = c.where("flag <> 'R'").selectExpr("doc_id", "pos AS num", f"{_REF} AS text")
    return op.reference_search(c.selectExpr("doc_id", "supp % 6 + 1 AS num", "pos"), entries, "bolt")


_HEADER = f"CASE supp % 4 WHEN 0 THEN 'Chapter ' || {_S('supp')} || ' The book ' || {_S('rec_id')} WHEN 1 THEN {_S('supp')} || '.e' || {_S('pos')} || ' Fig 3.2' WHEN 2 THEN 'No number here' ELSE {_S('rec_id % 900')} || ' Title of Table 4' END"


@P.add(rf"""{_CTE}, x AS (SELECT doc_id, pos AS page, regexp_replace({_HEADER}, '(?i)\b(?:chapter|fig(?:ure)?|table)\.?\s+\d+(?:\.\d+)?', '', 'g') AS t FROM citations)
SELECT doc_id, page, CASE WHEN regexp_matches(t, '\b\d+\.e\d+\b') THEN regexp_extract(t, '\b(\d+\.e\d+)\b', 1) ELSE regexp_extract(t, '(?:^|\s)(\d{{1,4}})(?:\s|$)', 1) END AS label FROM x""")
def printed_page_labels(spark: SparkSession, sf: str) -> DataFrame:
    return op.printed_labels(citations(spark, sf).selectExpr("doc_id", "pos AS page", f"{_HEADER} AS header"))


@P.add(f"{_CTE} SELECT doc_id, CASE WHEN count(instr) > 0 THEN 'record' ELSE 'superscript' END AS mode FROM runs GROUP BY doc_id")
def citation_mode(spark: SparkSession, sf: str) -> DataFrame:
    return op.citation_mode(_runs(spark, sf))


@P.add(f"{_CTE} SELECT doc_id, CASE max(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN instr IS NULL THEN 1 ELSE 2 END) WHEN 0 THEN 'span' WHEN 1 THEN 'superscript' ELSE 'record' END AS mode FROM runs GROUP BY doc_id")
def document_modes(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return op.document_modes(runs.where("doc_id % 3 <> 0"), runs.select("doc_id"))


_RUN_STYLE = "CASE supp % 5 WHEN 0 THEN 'CitSup' WHEN 1 THEN 'EndnoteReference' WHEN 2 THEN 'Strong' END"


@P.add(rf"""{_CTE}, r AS (SELECT doc_id, {_RUN} AS text FROM citations WHERE supp % 2 = 0 OR supp % 5 IN (0, 1)), x AS (SELECT doc_id, unnest(string_split_regex(text, '[,;\s–-]+')) AS num FROM r WHERE regexp_matches(text, '^[\d,;\s–-]+$')) SELECT DISTINCT doc_id, num FROM x WHERE num <> ''""")
def run_cited_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.run_numbers(citations(spark, sf).select("doc_id", F.expr(_RUN).alias("text"), F.expr("CASE WHEN supp % 2 = 0 THEN 'superscript' END").alias("vert_align"), F.expr(_RUN_STYLE).alias("style")))


@P.add(rf"""{_CTE}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z.,)](\d{{1,3}}(?:[,–-]\d{{1,3}})*)(?:[^\d.]|$)', 1)) AS x FROM paragraphs) SELECT DISTINCT doc_id, unnest(string_split_regex(x, '[,–-]'))::INT AS num FROM x""")
def body_cited_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.body_numbers(_paragraphs(spark, sf))


_ENTRY = r"^(\d{1,3})[.)]?\s+(.{15,})$"


@P.add(rf"""{_CTE}, r AS (SELECT doc_id, regexp_extract(text, '{_ENTRY}', 1)::INT AS num, para_idx, regexp_extract(text, '{_ENTRY}', 2) AS body FROM bib WHERE regexp_matches(text, '{_ENTRY}')), l AS (SELECT doc_id, num, arg_max(body, para_idx) AS body FROM r GROUP BY ALL)
SELECT doc_id, num, regexp_extract(body, '^((?:(?:van|von|de|der|den|du|la|le|di|da)\s+)*[A-Za-zÀ-ž''-]+)', 1) AS surname, coalesce(list_extract(regexp_extract_all(body, '\b(?:18|19|20)\d\d\b'), -1), '') AS year, body FROM l""")
def bibliography_flat(spark: SparkSession, sf: str) -> DataFrame:
    return op.flat_bibliography(_bib(spark, sf))


_SECT = r"""o AS (SELECT *, max((lower(trim(text)) = 'references')::INT) OVER (PARTITION BY doc_id ORDER BY para_idx) AS open FROM bib), p AS (SELECT *, regexp_matches(text, '^\d{1,3}[.\s]') AS entry FROM o WHERE open = 1 AND lower(trim(text)) <> 'references'),
q AS (SELECT *, coalesce(last_value(CASE WHEN NOT entry AND length(text) < 45 AND NOT regexp_matches(text, '\d{4}') THEN regexp_replace(lower(text), '[^a-z]', '', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM p),
sectioned AS (SELECT doc_id, section, regexp_extract(text, '^(\d{1,3})', 1)::INT AS num, trim(regexp_replace(text, '^\d{1,3}[.\s]\s*', '')) AS body FROM q WHERE entry)"""


@P.add(f"{_CTE}, {_SECT} SELECT * FROM sectioned")
def bibliography_sectioned(spark: SparkSession, sf: str) -> DataFrame:
    return op.sectioned_bibliography(_bib(spark, sf))


@P.add(f"{_CTE}, {_SECT}, k AS (SELECT * FROM sectioned WHERE length(body) > 15) SELECT *, CASE WHEN (SELECT count(DISTINCT section) FROM k x WHERE x.doc_id = k.doc_id) > 1 THEN section || '.' || num ELSE num::VARCHAR END AS label FROM k")
def bibliography_labels(spark: SparkSession, sf: str) -> DataFrame:
    return op.bibliography_labels(op.sectioned_bibliography(_bib(spark, sf)))


_SEQ = r"""cand AS (SELECT doc_id, para_idx, n, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS k FROM (SELECT doc_id, para_idx, regexp_extract(text, '^[ \t]*(\d{1,3})[a-z]?[.)]?\s+[A-Za-z]', 1)::INT AS n FROM bib WHERE regexp_matches(text, '^[ \t]*(\d{1,3})[a-z]?[.)]?\s+[A-Za-z]'))),
fold AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS para_idx, 0 AS num, 1 AS sec, 1 AS want, false AS took FROM (SELECT DISTINCT doc_id FROM cand) UNION ALL
SELECT c.doc_id, c.k, c.para_idx, c.n, CASE WHEN c.n = 1 AND f.want > 1 AND f.want <= 4000 THEN f.sec + 1 ELSE f.sec END, CASE WHEN f.want <= 4000 AND (c.n = 1 OR c.n BETWEEN f.want AND f.want + 8) THEN c.n + 1 ELSE f.want END, f.want <= 4000 AND (c.n = 1 OR c.n BETWEEN f.want AND f.want + 8) FROM fold f JOIN cand c ON c.doc_id = f.doc_id AND c.k = f.k + 1)"""
_CTE_R = _CTE.replace("WITH ", "WITH RECURSIVE ", 1)


@P.add(f"{_CTE_R}, {_SEQ} SELECT doc_id, para_idx, sec AS section, num FROM fold WHERE took")
def bibliography_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return op.sequence_bibliography(_bib(spark, sf))


@P.add(f"""{_CTE_R}, {_SEQ}, a AS (SELECT doc_id, para_idx, sec AS section, num FROM fold WHERE took), m AS (SELECT b.doc_id, b.para_idx, b.text, a.section, a.num, sum((a.num IS NOT NULL)::INT) OVER (PARTITION BY b.doc_id ORDER BY b.para_idx) AS entry FROM bib b LEFT JOIN a ON a.doc_id = b.doc_id AND a.para_idx = b.para_idx)
SELECT doc_id, entry, max(section) AS section, max(num) AS num, string_agg(text, ' ' ORDER BY para_idx) AS body FROM m WHERE entry > 0 GROUP BY doc_id, entry""")
def entry_spans(spark: SparkSession, sf: str) -> DataFrame:
    bib = _bib(spark, sf)
    return op.entry_spans(op.sequence_bibliography(bib), bib)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bib(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("t"))
    return rows.select("doc_id", F.array_join("t.text", "\n").alias("text"))


@P.add(rf"""{_CTE}, r AS (SELECT doc_id, para_idx, regexp_extract(text, '^\s*(\d{{1,3}})[.)]\s*(.{{8,200}}?)\s*$', 1)::INT AS num, regexp_extract(text, '^\s*(\d{{1,3}})[.)]\s*(.{{8,200}}?)\s*$', 2) AS body FROM bib WHERE regexp_matches(text, '^\s*(\d{{1,3}})[.)]\s*(.{{8,200}}?)\s*$')) SELECT doc_id, num, arg_min(body, para_idx) AS body FROM r GROUP BY ALL""")
def bibliography_lines(spark: SparkSession, sf: str) -> DataFrame:
    return op.bibliography_lines(_lines(spark, sf))


@P.add(rf"""{_CTE}, k AS (SELECT doc_id, para_idx, text, sum(regexp_matches(text, '^\d{{1,3}}\.\s')::INT) OVER (PARTITION BY doc_id ORDER BY para_idx) AS entry FROM bib) SELECT doc_id, entry, string_agg(text, ' ' ORDER BY para_idx) AS body FROM k WHERE entry > 0 GROUP BY ALL""")
def bibliography_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    return op.wrapped_bibliography(_bib(spark, sf).selectExpr("doc_id", "para_idx AS line_no", "text AS line"))


_LIST = f"CASE WHEN pos = 1 THEN CASE supp % 4 WHEN 0 THEN 'Growth plates' WHEN 1 THEN 'CHAPTER 4' WHEN 2 THEN 'Care for the Fracture' ELSE 'General, ' END WHEN supp % 13 = 0 THEN 'Section ' || author WHEN supp % 11 = 0 THEN '1012.e' || {_S('pos')} WHEN supp % 7 = 0 THEN '  wrapped ' || author || ' ' ELSE {_REF} END"


@P.add(rf"""{_CTE}, k AS (SELECT doc_id, line_no, s, sum(regexp_matches(s, '^\d{{1,3}}[a-z]?\.\s+')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM (SELECT doc_id, pos AS line_no, trim({_LIST}) AS s FROM citations) WHERE s <> '' AND NOT regexp_matches(s, '{op.FURNITURE}'))
SELECT doc_id, line_no, 'section' AS kind, s AS body FROM k WHERE entry = 0 AND length(s) < 45 AND NOT regexp_matches(s, '\d') AND regexp_matches(s, '^\p{{Lu}}') AND len(string_split_regex(s, '\s+')) <= 6 AND NOT regexp_matches(s, '[.,;]$') AND NOT regexp_matches(lower(s), '{op.NO_TITLE}')
UNION ALL SELECT doc_id, min(line_no), 'entry', string_agg(regexp_replace(s, '^(\d{{1,3}}[a-z]?)\.\s+', '\1. '), ' ' ORDER BY line_no) FROM k WHERE entry > 0 GROUP BY doc_id, entry""")
def bibliography_titled(spark: SparkSession, sf: str) -> DataFrame:
    return op.titled_bibliography(citations(spark, sf).select("doc_id", F.col("pos").alias("line_no"), F.expr(_LIST).alias("line")))


_SHAPE = r"^(.+?)\.\s+(.+?)\.\s+([^.]+)\.\s+(\d{4});(\d+)(?:\(([^)]*)\))?:(\d+)(?:-(\d+))?"


@P.add(rf"""{_CTE}, b AS (SELECT substr({_REF}, strpos({_REF}, ' ') + 1) AS body FROM citations), p AS (SELECT {', '.join(f"regexp_extract(body, '{_SHAPE}', {i + 1}) AS {c}" for i, c in enumerate(('authors', 'title', 'journal', 'year', 'volume', 'issue', 'spage', 'epage')))} FROM b),
k AS (SELECT *, len(list_filter(string_split_regex(authors, ',\s*'), lambda a: a <> '')) AS n_authors, regexp_extract(authors, '^([^\s,]+)', 1) AS surname, substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 40) AS title_key FROM p),
g AS (SELECT surname, year, title_key, min(struct_pack(authors, n_authors, title, journal, volume, issue, spage, epage)) AS r, count(*) AS n FROM k GROUP BY ALL)
SELECT surname, year, title_key, r.authors AS authors, r.n_authors AS n_authors, r.title AS title, r.journal AS journal, r.volume AS volume, r.issue AS issue, r.spage AS spage, r.epage AS epage, n FROM g""")
def parse_reference(spark: SparkSession, sf: str) -> DataFrame:
    return op.parse_reference(citations(spark, sf).select(F.expr(f"substr({_REF}, instr({_REF}, ' ') + 1)").alias("body")))


@P.add(rf"""{_CTE}, b AS (SELECT doc_id, pos AS num, substr({_REF}, strpos({_REF}, ' ') + 1) AS body FROM citations)
SELECT doc_id, num, regexp_replace(lower(regexp_extract(body, '^([^\d,]*?)\s+[A-Z]{{1,3}}(?:,|\.|\s|$)', 1)), '[\s''.-]', '', 'g') AS surname, coalesce(list_extract(regexp_extract_all(body, '\b(?:18|19|20)\d\d\b'), -1), '') AS year FROM b""")
def reference_key(spark: SparkSession, sf: str) -> DataFrame:
    return op.reference_key(citations(spark, sf).select("doc_id", F.col("pos").alias("num"), F.expr(f"substr({_REF}, instr({_REF}, ' ') + 1)").alias("body")))


@P.add(rf"""{_CTE}, t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_agg(text, chr(10) || chr(10) ORDER BY para_idx) ELSE string_agg(text, chr(10) ORDER BY para_idx) END AS text FROM bib GROUP BY doc_id), b AS (SELECT doc_id, bs[i] AS block, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n{{2,}}') AS bs FROM t)))
SELECT doc_id, pos, regexp_replace(trim(block), '^\d+[.)]\s*', '') AS body, regexp_extract(regexp_replace(trim(block), '^\d+[.)]\s*', ''), '\b((?:18|19|20)\d\d)', 1) AS year FROM b WHERE length(trim(block)) >= 20""")
def read_reference_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bib(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("t"))
    return op.reference_list(rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_join("t.text", "\n\n")).otherwise(F.array_join("t.text", "\n")).alias("text")))


# Every third document has a heading in the place of its second paragraph, and only those begin without a number.
_HEADED = "CASE WHEN doc_id % 3 = 0 AND para_idx = 2 THEN 'References' WHEN doc_id % 3 = 0 AND para_idx < 2 THEN 'No list yet' ELSE text END"


@P.add(rf"""{_CTE}, b AS (SELECT doc_id, para_idx, trim({_HEADED}) AS t FROM bib), m AS (SELECT *, regexp_matches(t, '(?i)^(?:references?|bibliography)$') AS heading, regexp_matches(t, '^\d+[.)]\s+.+') AS numbered FROM b WHERE t <> ''),
s AS (SELECT *, max((heading OR numbered)::INT) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started FROM m), k AS (SELECT doc_id, para_idx, CASE WHEN numbered THEN regexp_extract(t, '^\d+[.)]\s+(.+)', 1) ELSE t END AS body FROM s WHERE started = 1 AND NOT heading)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS pos, body, regexp_extract(body, '\b((?:19|20)\d\d)\b', 1) AS year FROM k""")
def read_reference_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return op.reference_paragraphs(_bib(spark, sf).select("doc_id", "para_idx", F.expr(_HEADED).alias("text")))


@P.add(rf"""{_CTE}, r AS (SELECT doc_id, para_idx, trim(text) AS body, regexp_extract(trim(text), '^(\d+[a-z]?)[.)]\s+.+', 1) AS num FROM bib WHERE regexp_matches(trim(text), '^(\d+[a-z]?)[.)]\s+.+')) SELECT doc_id, num, arg_max(body, para_idx) AS body FROM r GROUP BY ALL""")
def bibliography_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return op.numbered_entries(_bib(spark, sf))


@P.add(rf"""WITH p AS (SELECT page_id AS doc_id, html FROM pages), m AS (SELECT doc_id, unnest(regexp_extract_all(html, '<[a-zA-Z]+')) AS t FROM p) SELECT doc_id, t AS tag, count(*) AS n FROM m GROUP BY ALL""")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit("<[a-zA-Z]+"), F.lit(0))).alias("tag"))
    return tags.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLES = P.queries, P.oracles
