"""Queries over field codes, run damage and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.operators import fields as op
from refweave.plans.kit import CITATIONS, Plans, citations, table

P = Plans()

_S = "CAST({} AS STRING)".format
_CITE = f"'<EndNote><Cite><Author>' || author || ' & Co</Author><Year>' || cited_year || '</Year><RecNum>' || recnum || '</RecNum></Cite></EndNote>'"
_COLUMNS = {
    "para_idx": "group_order", "n_begin": "CASE WHEN rec_id % 3 = 0 THEN 1 ELSE 0 END", "n_sep": "CASE WHEN supp % 2 = 0 THEN 1 ELSE 0 END", "n_end": "CASE WHEN rec_id % 3 = 1 THEN 1 ELSE 0 END",
    "text": f"CASE rec_id % 4 WHEN 0 THEN {_S('supp % 40')} WHEN 1 THEN ', ' WHEN 2 THEN author || '; by ' || cited_year || '. So it is: yes' ELSE {_S('supp % 9')} END",
    "instr": "CASE supp % 6 WHEN 0 THEN ' ADDIN EN.CITE ' WHEN 1 THEN ' ADDIN EN.CITE.DATA ' WHEN 2 THEN ' ADDIN EN.CITE <RecNum>' || recnum || '</RecNum>' END",
    "vert_align": "CASE WHEN supp % 2 = 0 THEN 'superscript' END", "style": "CASE supp % 3 WHEN 0 THEN 'citsup' WHEN 1 THEN 'crossref' END", "xml_id": "rec_id % 12", "note_ref": "CASE WHEN supp % 8 = 0 THEN supp END", "comment_mark": "CASE WHEN supp % 7 = 0 THEN 'commentReference' END", "tracked": "CASE supp % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'ins' ELSE 'none' END",
}
_BLOB_WHEN = "supp % 4 = 3"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    blob = F.when(F.expr(_BLOB_WHEN), F.base64(F.encode(F.expr(_CITE), "utf-8")))
    return c.select("doc_id", "pos", "recnum", *[F.expr(e).alias(k) for k, e in _COLUMNS.items()], blob.alias("fld_data"))


_CTE = f"WITH {CITATIONS}, runs AS (SELECT doc_id, pos, recnum, {', '.join(f'{e} AS {k}' for k, e in _COLUMNS.items())}, CASE WHEN {_BLOB_WHEN} THEN to_base64(encode({_CITE})) END AS fld_data, CASE WHEN {_BLOB_WHEN} THEN {_CITE} END AS blob_text FROM citations)"
_DEPTH = """s AS (SELECT *, sum(n_begin - n_end) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM runs), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS depth FROM s),
o AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM d), k AS (SELECT *, sum((before = 0 AND depth > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block_idx FROM o)"""


@P.add(f"{_CTE}, {_DEPTH} SELECT doc_id, block_idx, min(pos) AS first_run, max(pos) AS last_run, string_agg(text, '' ORDER BY pos) AS display, arg_max(depth, pos) > 0 AS unterminated FROM k WHERE depth > 0 OR before > 0 GROUP BY doc_id, block_idx")
def field_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return op.field_blocks(_runs(spark, sf))


@P.add(f"""WITH {CITATIONS}, p AS (SELECT doc_id, group_order AS block_idx, pos AS part, {_CITE} AS payload FROM citations) SELECT doc_id, block_idx, payload, min(part) AS part FROM p GROUP BY ALL""")
def block_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each citation's payload cut into three base64 chunks, at places that aren't character or block bounds of the payload."""
    b = citations(spark, sf).select("doc_id", F.col("group_order").alias("block_idx"), F.col("pos").alias("part"), F.encode(F.expr(_CITE), "utf-8").alias("b"))
    cut = lambda k, a, n: F.struct(F.lit(k).alias("k"), F.base64(F.expr(f"substring(b, {a}, {n})")).alias("data"))
    chunks = b.select("doc_id", "block_idx", "part", F.explode(F.array(cut(0, 1, 7), cut(1, 8, 31), cut(2, 39, 100000))).alias("c")).select("doc_id", "block_idx", "part", "c.k", "c.data")
    return op.block_payloads(chunks)


@P.add(f"""{_CTE}, c AS (SELECT *, coalesce(sum((instr IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cite_idx FROM runs),
g AS (SELECT doc_id, cite_idx, trim(coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (instr IS NULL), '')) AS whole FROM c GROUP BY ALL HAVING count(instr) > 0), l AS (SELECT *, list_filter(string_split_regex(whole, '[.;:]'), lambda x: trim(x) <> '') AS ps FROM g)
SELECT doc_id, cite_idx, right(array_to_string(list_transform(ps[greatest(1, len(ps) - 1):], lambda x: trim(x)), '. '), 300) AS claim FROM l""")
def claims(spark: SparkSession, sf: str) -> DataFrame:
    return op.claims(_runs(spark, sf).withColumn("is_cite", F.col("instr").isNotNull()))


@P.add(rf"""{_CTE}, c AS (SELECT *, regexp_matches(text, '^\s*\d+\s*$') AS num, regexp_matches(text, '^[\s,;–-]+$') AS sep FROM runs), i AS (SELECT *, sum((NOT num AND NOT sep)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c)
SELECT doc_id, min(pos) AS first_run, max(pos) AS last_run, string_agg(trim(text), ',' ORDER BY pos) AS numbers FROM i WHERE num GROUP BY doc_id, island""")
def number_run_groups(spark: SparkSession, sf: str) -> DataFrame:
    return op.run_groups(_runs(spark, sf))


def _variant(number: str, separators: str) -> str:
    return rf"""SELECT doc_id, min(pos) AS first_run, max(pos) AS last_run, string_agg(trim(text), ',' ORDER BY pos) AS numbers FROM (SELECT *, sum((NOT num AND NOT sep)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM
 (SELECT *, regexp_matches(text, '^\s*\d+\s*$') AND coalesce({number}, false) AS num, regexp_matches(text, '^{separators}$') AS sep FROM cued)) WHERE num GROUP BY doc_id, island"""


@P.add(rf"""{_CTE}, cued AS (SELECT *, coalesce(bool_or(regexp_matches(text, '\b(?:References?|See)\b')) OVER (PARTITION BY doc_id, para_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cue FROM (SELECT * REPLACE (CASE WHEN style IS NULL AND supp9 THEN 'See also ' || text ELSE text END AS text) FROM (SELECT *, length(recnum) % 3 = 0 AS supp9 FROM runs)))
SELECT 'style' AS variant, * FROM ({_variant("style = 'citsup'", r"\s*[,;]\s*")}) UNION ALL SELECT 'superscript', * FROM ({_variant("vert_align = 'superscript'", r"[\s,;–-]+")}) UNION ALL SELECT 'cue', * FROM ({_variant("style = 'crossref' OR cue", r"[\s,;–-]+")})""")
def number_run_group_variants(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).withColumn("text", F.expr("CASE WHEN style IS NULL AND length(recnum) % 3 = 0 THEN 'See also ' || text ELSE text END"))
    found = {"style": op.styled_groups(runs), "superscript": op.superscript_groups(runs), "cue": op.cued_groups(runs)}
    one, two, three = (df.select(F.lit(k).alias("variant"), "*") for k, df in found.items())
    return one.union(two).union(three)


@P.add(f"""WITH {CITATIONS}, m AS (SELECT doc_id, pos, rec_id % 12 AS id FROM citations), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) > 1 AS again, max(id) OVER (PARTITION BY doc_id) AS top FROM m)
SELECT doc_id, pos, id AS old, CASE WHEN again THEN top + sum(again::INT) OVER (PARTITION BY doc_id ORDER BY pos) ELSE id END AS new FROM a""")
def dedupe_ids(spark: SparkSession, sf: str) -> DataFrame:
    return op.dedupe_ids(citations(spark, sf).select("doc_id", "pos", (F.col("rec_id") % 12).alias("id")))


@P.add(f"""{_CTE}, b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM runs), c AS (SELECT *, CASE WHEN ends_with(before, '3') AND starts_with(text, '4') THEN 1 WHEN ends_with(before, '7') AND starts_with(text, '1') THEN 1 WHEN ends_with(before, 'yes') AND starts_with(text, ', ') THEN 2 ELSE 0 END AS cut FROM b)
SELECT doc_id, pos, text, substr(text, cut + 1) AS fixed FROM c WHERE cut > 0""")
def concatenated_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.concatenated_numbers(_runs(spark, sf), [("3", "4"), ("7", "1"), ("yes", ", ")])


_ORPHANS = r"""h AS (SELECT *, bool_or(coalesce(contains(instr, 'EN.CITE'), false)) OVER (PARTITION BY doc_id, para_idx) AS has FROM d), orphans AS (SELECT doc_id, pos, text FROM h WHERE depth = 0 AND n_end = 0 AND has AND vert_align = 'superscript' AND regexp_matches(text, '^[\d,\s]*\d[\d,\s]*$'))"""


@P.add(f"{_CTE}, {_DEPTH}, {_ORPHANS} SELECT * FROM orphans")
def orphan_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.orphan_numbers(_runs(spark, sf))


_HEALTH = r"""x AS (SELECT *, nullif(regexp_extract(instr, '<RecNum>(\d+)</RecNum>', 1), '') AS v, nullif(regexp_extract(blob_text, '<RecNum>(\d+)</RecNum>', 1), '') AS b FROM runs),
health AS (SELECT doc_id, count(*) FILTER (contains(instr, 'EN.CITE')) AS total_fields, count(*) FILTER (contains(instr, 'EN.CITE.DATA')) AS data_fields, count(*) FILTER (trim(instr) = 'ADDIN EN.CITE') AS empty_fields, count(fld_data) AS blobs, count(DISTINCT v)::INT AS visible_refs,
  len(list_filter(list(DISTINCT b), lambda y: y IS NOT NULL AND NOT coalesce(list_contains(list(DISTINCT v), y), false)))::INT AS hidden_refs, sum(n_begin)::BIGINT AS begins, sum(n_sep)::BIGINT AS seps, sum(n_end)::BIGINT AS ends, count(*) FILTER (tracked <> 'none') AS tracked_runs FROM x GROUP BY doc_id)"""


def _damage_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Bibliography entries of the damaged documents, by number."""
    return citations(spark, sf).where("flag <> 'R'").select("doc_id", (F.col("supp") % 40).alias("num"))


@P.add(rf"""{_CTE}, {_HEALTH}, ent AS (SELECT DISTINCT doc_id, supp % 40 AS num FROM citations WHERE flag <> 'R'), sup AS (SELECT DISTINCT doc_id, p::BIGINT AS num FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(trim(text), '[,;\s]+')), '\.+$', '') AS p FROM runs WHERE vert_align = 'superscript') WHERE regexp_matches(p, '^\d+$')),
tr AS (SELECT doc_id, count(*) FILTER (tracked = 'ins') AS ins_count, count(*) FILTER (tracked = 'del') AS del_count, count(DISTINCT note_ref) AS note_refs, count(comment_mark) AS comment_marks FROM runs GROUP BY doc_id), du AS (SELECT doc_id, count(*) AS dup_ids FROM (SELECT doc_id, xml_id FROM runs GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id)
SELECT health.*, ins_count, del_count, note_refs, comment_marks, coalesce(dup_ids, 0) AS dup_ids, (SELECT count(*) FROM sup WHERE sup.doc_id = health.doc_id) AS cited_count, (SELECT count(*) FROM ent WHERE ent.doc_id = health.doc_id) AS bib_count,
 (SELECT count(*) FROM ent WHERE ent.doc_id = health.doc_id AND NOT EXISTS (SELECT 1 FROM sup WHERE sup.doc_id = ent.doc_id AND sup.num = ent.num)) AS lost_in_merge, begins = seps AND seps = ends AS balanced FROM health JOIN tr USING (doc_id) LEFT JOIN du USING (doc_id)""")
def merge_damage(spark: SparkSession, sf: str) -> DataFrame:
    return op.merge_damage(_runs(spark, sf), _damage_entries(spark, sf))


@P.add(f"{_CTE}, {_HEALTH} SELECT doc_id, total_fields, total_fields - data_fields - empty_fields AS working, empty_fields, blobs, visible_refs, hidden_refs FROM health")
def citation_health_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op.health_counts(_runs(spark, sf)).select("doc_id", "total_fields", (F.col("total_fields") - F.col("data_fields") - F.col("empty_fields")).alias("working"), "empty_fields", "blobs", "visible_refs", "hidden_refs")


@P.add(f"""{_CTE}, {_DEPTH}, {_ORPHANS}, {_HEALTH}, comment_docs AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'), bf AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM runs),
z AS (SELECT h.*, coalesce((SELECT count(*) FROM orphans o WHERE o.doc_id = h.doc_id), 0) AS orphans, coalesce((SELECT count(*) FROM bf WHERE bf.doc_id = h.doc_id AND ends_with(prev, '3') AND starts_with(text, '4')), 0) AS garbled,
 coalesce((SELECT count(*) FROM (SELECT xml_id FROM runs r WHERE r.doc_id = h.doc_id GROUP BY xml_id HAVING count(*) > 1)), 0) AS dup_ids, CASE WHEN EXISTS (SELECT 1 FROM comment_docs c WHERE c.doc_id = h.doc_id) THEN 0 ELSE (SELECT count(comment_mark) FROM runs r WHERE r.doc_id = h.doc_id) END AS orphan_comments FROM health h),
i AS (SELECT doc_id, 'broken_fields' AS issue_id, 'error' AS severity, empty_fields + data_fields AS n, true AS fixable FROM z UNION ALL SELECT doc_id, 'hidden_refs', 'error', hidden_refs, true FROM z UNION ALL SELECT doc_id, 'orphan_superscripts', 'warning', orphans, true FROM z
 UNION ALL SELECT doc_id, 'garbled_figs', 'warning', garbled, true FROM z UNION ALL SELECT doc_id, 'dup_ids', 'error', dup_ids, true FROM z UNION ALL SELECT doc_id, 'orphan_comments', 'warning', orphan_comments, true FROM z UNION ALL SELECT doc_id, 'unbalanced_fields', 'error', CASE WHEN begins <> ends OR begins <> seps THEN greatest(1, abs(begins - ends)) ELSE 0 END, false FROM z)
SELECT doc_id, issue_id, severity, n::BIGINT AS n, fixable FROM i WHERE n > 0""")
def health_check(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    per = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    dup = runs.groupBy("doc_id", "xml_id").count().where("count > 1")
    comment_docs = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))  # documents that have a comment part
    comments = op.orphan_comments(runs.where("comment_mark is not null").select("doc_id"), comment_docs)
    counts = op.health_counts(runs).join(per(op.orphan_numbers(runs), "orphans"), "doc_id", "left").join(per(op.concatenated_numbers(runs, [("3", "4")]), "garbled"), "doc_id", "left").join(per(dup, "dup_ids"), "doc_id", "left").join(comments, "doc_id", "left")
    return op.health_issues(counts.fillna(0))


_ESCAPED = "' ADDIN EN.CITE ' || replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')".format
_REC = r"regexp_extract_all({}, '<RecNum>(\d+)</RecNum>', 1)".format


@P.add(f"""{_CTE}, a AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, CASE trim(instr) WHEN 'ADDIN EN.CITE' THEN 'A' WHEN 'ADDIN EN.CITE.DATA' THEN 'B' END AS kind FROM runs),
w AS (SELECT e.doc_id, e.pos, e.kind, e.at_, (SELECT min(b.pos) FROM a b WHERE b.doc_id = e.doc_id AND b.pos > e.pos AND b.fld_data IS NOT NULL) AS np, (SELECT max(b.pos) FROM a b WHERE b.doc_id = e.doc_id AND b.pos < e.pos AND b.fld_data IS NOT NULL) AS lp FROM a e WHERE kind IS NOT NULL),
ah AS (SELECT w.doc_id, w.pos, w.kind AS pattern, np AS blob_pos, b.blob_text AS payload FROM w JOIN a b ON b.doc_id = w.doc_id AND b.pos = np WHERE b.at_ - w.at_ <= 2000 QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.kind, np ORDER BY w.pos) = 1),
bh AS (SELECT w.doc_id, w.pos, 'B-reverse' AS pattern, lp AS blob_pos, b.blob_text AS payload FROM w JOIN a b ON b.doc_id = w.doc_id AND b.pos = lp WHERE w.kind = 'B' AND w.at_ - b.at_ <= 500 AND NOT EXISTS (SELECT 1 FROM ah WHERE ah.doc_id = w.doc_id AND ah.pos = w.pos AND pattern = 'B') QUALIFY row_number() OVER (PARTITION BY w.doc_id, lp ORDER BY w.pos) = 1),
f AS (SELECT * FROM ah UNION ALL SELECT * FROM bh), shown AS (SELECT doc_id, unnest({_REC('instr')}) AS rec FROM runs WHERE instr IS NOT NULL UNION SELECT doc_id, unnest({_REC('payload')}) FROM f),
c AS (SELECT doc_id, rec, min(pos) AS pos FROM (SELECT doc_id, pos, unnest({_REC('blob_text')}) AS rec FROM runs WHERE blob_text IS NOT NULL) GROUP BY doc_id, rec), cc AS (SELECT DISTINCT doc_id, pos FROM c WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.doc_id = c.doc_id AND shown.rec = c.rec))
SELECT doc_id, pos, pattern, blob_pos, {_ESCAPED('payload')} AS instr FROM f UNION ALL SELECT doc_id, pos, 'C', pos, {_ESCAPED('blob_text')} FROM cc JOIN runs USING (doc_id, pos)""")
def restore_fields(spark: SparkSession, sf: str) -> DataFrame:
    return op.restore_fields(_runs(spark, sf))


@P.add(f"{_CTE}, {_DEPTH} SELECT doc_id, min(pos) + 0.5::DOUBLE AS pos, 'separate' AS kind FROM k WHERE depth > 0 OR before > 0 GROUP BY doc_id, block_idx HAVING sum(n_sep) = 0")
def insert_separators(spark: SparkSession, sf: str) -> DataFrame:
    return op.insert_separators(_runs(spark, sf))


_ACC = "acc AS (SELECT doc_id, pos, recnum, text, 'none' AS tracked FROM runs WHERE tracked <> 'del' OR coalesce(contains(instr, 'EN.CITE'), false) OR fld_data IS NOT NULL)"


@P.add(f"{_CTE}, {_ACC} SELECT * FROM acc")
def accept_changes(spark: SparkSession, sf: str) -> DataFrame:
    return op.accept_changes(_runs(spark, sf)).select("doc_id", "pos", "recnum", "text", "tracked")


@P.add(f"""{_CTE}, {_ACC}, l AS (SELECT DISTINCT doc_id, recnum FROM runs EXCEPT SELECT doc_id, recnum FROM acc)
SELECT b.doc_id, b.n AS before, coalesce(a.n, 0) AS after, coalesce((SELECT string_agg(recnum, ',' ORDER BY recnum) FROM l WHERE l.doc_id = b.doc_id), '') AS lost FROM (SELECT doc_id, count(*) AS n FROM runs GROUP BY ALL) b LEFT JOIN (SELECT doc_id, count(*) AS n FROM acc GROUP BY ALL) a USING (doc_id)""")
def post_merge_report(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return op.merge_report(runs, op.accept_changes(runs))


@P.add(f"""WITH {CITATIONS}, p AS (SELECT doc_id, group_order, '<EndNote>' || string_agg('<Cite><Author>' || author || '</Author><Year>' || cited_year || '</Year><RecNum>' || recnum || '</RecNum>' || CASE WHEN ref_pos = 1 THEN '<DisplayText>(' || author || ' &amp; ' || cited_year || ')</DisplayText>' ELSE '' END || '</Cite>', '' ORDER BY ref_pos) || '</EndNote>' AS payload FROM citations GROUP BY ALL)
SELECT doc_id, group_order, payload, to_base64(encode(payload)) AS blob FROM p""")
def build_field_payload(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).withColumns({"year": F.col("cited_year"), "display": F.concat(F.lit("("), "author", F.lit(" & "), "cited_year", F.lit(")"))})
    return op.build_payloads(c)


@P.add(f"{_CTE} SELECT doc_id, pos FROM runs WHERE tracked <> 'none' AND doc_id NOT IN (SELECT doc_id FROM runs WHERE instr = ' ADDIN EN.CITE ')")
def drop_orphan_comments(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return op.drop_orphan_comments(runs.where("tracked <> 'none'").select("doc_id", "pos"), runs.where("instr = ' ADDIN EN.CITE '").select("doc_id").distinct())


QUERIES, ORACLES = P.queries, P.oracles
