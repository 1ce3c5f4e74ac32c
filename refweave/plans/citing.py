"""Queries over citations, library and bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.operators import citations as op
from refweave.plans.kit import BASE, Plans, citations, library, table, when_of

P = Plans()


@P.add(f"{BASE} SELECT doc_id, group_order, ref_pos, recnum, count(*) OVER (PARTITION BY doc_id, recnum) AS n_in_doc, max(group_order) OVER (PARTITION BY doc_id) AS n_groups, count(*) OVER (PARTITION BY doc_id) AS n_citations, (SELECT count(DISTINCT recnum) FROM citations x WHERE x.doc_id = c.doc_id) AS n_distinct FROM citations c")
def citation_listing(spark: SparkSession, sf: str) -> DataFrame:
    return op.citation_listing(citations(spark, sf))


@P.add(f"{BASE} SELECT doc_id, recnum, count(*) AS n FROM citations WHERE rec_id NOT IN (SELECT rec_id FROM library WHERE trash_state = 0) GROUP BY ALL")
def missing_from_library(spark: SparkSession, sf: str) -> DataFrame:
    return op.missing_from_library(citations(spark, sf), library(spark, sf))


@P.add(rf"""{BASE}, m AS (SELECT DISTINCT recnum, author, cited_year AS year, title, regexp_replace(lower(author), '[^a-z0-9]', '', 'g') AS k, substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 25) AS st FROM citations WHERE rec_id NOT IN (SELECT rec_id FROM library WHERE trash_state = 0)),
j AS (SELECT m.*, l.rec_id AS new_id, st = substr(regexp_replace(lower(l.title), '[^a-z0-9]', '', 'g'), 1, 25) AS alike FROM m LEFT JOIN library l ON l.trash_state = 0 AND k = regexp_replace(lower(l.surname), '[^a-z0-9]', '', 'g') AND m.year = l.year)
SELECT recnum, author, year, title, coalesce(min(new_id) FILTER (alike), min(new_id)) AS new_id, CASE WHEN count(new_id) = 0 THEN 'not_found' WHEN count(new_id) = 1 THEN 'only' WHEN bool_or(alike) THEN 'title' ELSE 'first' END AS how FROM j GROUP BY recnum, author, year, title""")
def remap_recnums(spark: SparkSession, sf: str) -> DataFrame:
    lib = library(spark, sf)
    missing = citations(spark, sf).join(op.live(lib).select("rec_id"), "rec_id", "left_anti").withColumnRenamed("cited_year", "year")
    return op.remap_recnums(missing, lib)


@P.add(f"{BASE} SELECT c.doc_id, c.pos, c.recnum, l.surname AS found_author, l.title AS found_title, CASE WHEN l.title IS NULL THEN 'record ' || c.recnum || ' not in library' END AS error FROM citations c LEFT JOIN library l ON c.rec_id = l.rec_id AND trash_state = 0 WHERE c.flag = 'R'")
def rebuild_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return op.rebuild_lookup(citations(spark, sf).where("flag = 'R'"), library(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).where("flag <> 'R'").select("doc_id", (F.col("rec_id") % 60).alias("num"), "pos", "author")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).where("status = 'O' OR flag = 'R'").select("doc_id", (F.col("rec_id") % 60).alias("num"), "pos")


_BIB = f"{BASE}, entries AS (SELECT doc_id, rec_id % 60 AS num, pos, author FROM citations WHERE flag <> 'R'), cited AS (SELECT doc_id, rec_id % 60 AS num, pos FROM citations WHERE status = 'O' OR flag = 'R')"


@P.add(f"""{_BIB}, e AS (SELECT DISTINCT doc_id, num FROM entries), n AS (SELECT doc_id, num, count(*) AS n FROM cited GROUP BY ALL)
SELECT coalesce(e.doc_id, n.doc_id) AS doc_id, coalesce(e.num, n.num) AS num, CASE WHEN e.num IS NULL THEN 'no_entry' WHEN n.n IS NULL THEN 'uncited' ELSE 'cited' END AS state, coalesce(n.n, 0) AS n FROM e FULL JOIN n ON e.doc_id = n.doc_id AND e.num = n.num""")
def citation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return op.coverage(_entries(spark, sf), _cited(spark, sf))


@P.add(f"""{_BIB}, a AS (SELECT DISTINCT doc_id, num, pos FROM cited WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_id = cited.doc_id AND e.num = cited.num)), t AS (SELECT a.doc_id, a.num, a.pos, substr(trim(c.title || ' by ' || c.author), 1, 120) AS text FROM a JOIN citations c ON c.doc_id = a.doc_id AND c.pos = a.pos)
SELECT doc_id, num, count(*) AS n_locations, array_to_string(list(text ORDER BY pos)[1:2], '|') AS samples FROM t GROUP BY ALL""")
def coverage_samples(spark: SparkSession, sf: str) -> DataFrame:
    paragraphs = citations(spark, sf).select("doc_id", F.col("pos").alias("para_idx"), F.concat("title", F.lit(" by "), "author").alias("text"))
    return op.uncovered_samples(_entries(spark, sf), _cited(spark, sf).withColumnRenamed("pos", "para_idx"), paragraphs).withColumn("samples", F.array_join("samples", "|"))


@P.add(f"{BASE} SELECT doc_id, recnum, count(*) AS n FROM citations GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return op.duplicate_ids(citations(spark, sf), "recnum")


_STATES = "CASE WHEN flag = 'R' THEN 'resolved' WHEN flag = 'A' THEN 'suggested' WHEN status = 'O' THEN 'missing' ELSE 'dangling' END"


def _resolutions(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).select("doc_id", F.col("group_order").alias("marker_id"), "rec_id", "pos", F.expr(_STATES).alias("state"))


@P.add(f"""{BASE}, r AS (SELECT doc_id, group_order AS marker_id, {_STATES} AS state FROM citations), m AS (SELECT doc_id, marker_id, bool_and(state = 'resolved') AS done FROM r GROUP BY ALL)
SELECT * FROM (SELECT doc_id, count(*) AS placeholders, count(*) FILTER (done) AS fully_done FROM m GROUP BY ALL) JOIN (SELECT doc_id, count(*) FILTER (state IN ('resolved', 'suggested')) AS applied, count(*) FILTER (state = 'suggested') AS to_verify, count(*) FILTER (state = 'missing') AS unresolved, count(*) FILTER (state = 'dangling') AS dangling FROM r GROUP BY ALL) USING (doc_id)""")
def conversion_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.conversion_summary(_resolutions(spark, sf))


def _with_db(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).withColumns({"hidden": F.col("flag") == "A", "db_id": when_of(F.col("supp") % 3, {0: "lib1", 1: ""}, F.lit("lib2"))})


@P.add(f"""{BASE}, x AS (SELECT *, flag = 'A' AS hidden, CASE supp % 3 WHEN 0 THEN 'lib1' WHEN 1 THEN '' ELSE 'lib2' END AS db_id FROM citations),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, recnum ORDER BY hidden, pos) AS rn, bool_and(hidden) OVER (PARTITION BY doc_id, recnum) AS all_hidden FROM x)
SELECT doc_id, recnum, author, cited_year AS year, all_hidden AS hidden, CASE db_id WHEN '' THEN 'empty' WHEN 'lib1' THEN 'ok' ELSE 'wrong' END AS db_state FROM f WHERE rn = 1""")
def recnum_inspector(spark: SparkSession, sf: str) -> DataFrame:
    return op.recnum_inspector(_with_db(spark, sf), "lib1")


@P.add(f"""{BASE}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, recnum ORDER BY pos) AS rn FROM citations)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rec_id) AS place, recnum, author, cited_year AS year, title FROM f WHERE rn = 1""")
def embedded_library(spark: SparkSession, sf: str) -> DataFrame:
    return op.embedded_library(citations(spark, sf))


@P.add(f"{BASE} SELECT doc_id, recnum, arg_min(author, pos) AS author, arg_min(cited_year, pos) AS year, count(*) AS n FROM citations WHERE flag = 'R' GROUP BY ALL")
def broken_by_recnum(spark: SparkSession, sf: str) -> DataFrame:
    return op.broken_by_recnum(citations(spark, sf).where("flag = 'R'"))


_HID = f"{BASE}, vis AS (SELECT DISTINCT doc_id, recnum FROM citations WHERE flag <> 'A'), hid AS (SELECT DISTINCT doc_id, recnum FROM citations WHERE flag = 'A')"


def _refs(spark: SparkSession, sf: str, where: str) -> DataFrame:
    return citations(spark, sf).where(where).select("doc_id", "recnum")


@P.add(f"{_HID} SELECT * FROM hid EXCEPT SELECT * FROM vis")
def hidden_refs(spark: SparkSession, sf: str) -> DataFrame:
    return op.set_difference(_refs(spark, sf, "flag = 'A'"), _refs(spark, sf, "flag <> 'A'"))


@P.add(f"{BASE} SELECT DISTINCT doc_id, recnum FROM citations EXCEPT SELECT doc_id, recnum FROM citations WHERE status = 'O'")
def lost_refs(spark: SparkSession, sf: str) -> DataFrame:
    return op.set_difference(_refs(spark, sf, "true"), _refs(spark, sf, "status = 'O'"))


@P.add(f"{_BIB} SELECT doc_id, num FROM cited UNION SELECT doc_id, rec_id % 60 FROM citations WHERE flag = 'A'")
def all_cited(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf).select("doc_id", "num").union(citations(spark, sf).where("flag = 'A'").select("doc_id", F.col("rec_id") % 60)).distinct()


@P.add(f"{_BIB} SELECT doc_id, num FROM entries INTERSECT SELECT doc_id, num FROM cited")
def cited_with_entry(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("doc_id", "num").intersect(_cited(spark, sf).select("doc_id", "num"))


@P.add(f"{_BIB}, a AS (SELECT DISTINCT doc_id, num FROM entries), b AS (SELECT DISTINCT doc_id, num FROM cited) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.num, b.num) AS num, CASE WHEN b.num IS NULL THEN 'only_a' WHEN a.num IS NULL THEN 'only_b' ELSE 'common' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.num = b.num")
def common_and_only(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _entries(spark, sf).select("doc_id", "num"), _cited(spark, sf).select("doc_id", "num")
    marked = a.select("*", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("*", F.lit(0), F.lit(1)))
    side = F.when(F.max("b") == 0, "only_a").when(F.max("a") == 0, "only_b").otherwise("common")
    return marked.groupBy("doc_id", "num").agg(side.alias("side"))


@P.add(f"""{_BIB}, f AS (SELECT doc_id, num AS old, min(pos) AS at_ FROM cited GROUP BY ALL), e AS (SELECT DISTINCT doc_id, num AS old FROM entries), j AS (SELECT doc_id, old, at_ FROM e FULL JOIN f USING (doc_id, old))
SELECT doc_id, old, row_number() OVER (PARTITION BY doc_id ORDER BY at_ NULLS LAST, old) AS new, at_ IS NOT NULL AS cited FROM j""")
def renumber_appearance(spark: SparkSession, sf: str) -> DataFrame:
    return op.renumber_appearance(_cited(spark, sf), _entries(spark, sf))


@P.add(f"{_BIB}, l AS (SELECT doc_id, num, arg_max(author, pos) AS author, max(pos) AS pos FROM entries GROUP BY ALL) SELECT doc_id, num AS old, row_number() OVER (PARTITION BY doc_id ORDER BY lower(list_extract(string_split(trim(author), ' '), -1)), pos) AS new FROM l")
def renumber_alphabetical(spark: SparkSession, sf: str) -> DataFrame:
    return op.renumber_alphabetical(_entries(spark, sf))


@P.add(f"{BASE}, f AS (SELECT doc_id, rec_id, min(pos) AS at_ FROM citations WHERE flag = 'R' GROUP BY ALL) SELECT doc_id, rec_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS number FROM f")
def continuous_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return op.continuous_numbers(_resolutions(spark, sf).where("state = 'resolved'"))


@P.add(f"""{BASE}, m AS (SELECT rec_id::VARCHAR AS old, (rec_id + 1)::VARCHAR AS new FROM library WHERE trash_state = 1)
SELECT doc_id, pos, recnum, coalesce(new, recnum) AS mapped, count(new) OVER (PARTITION BY recnum) AS n_of_pair FROM citations LEFT JOIN m ON recnum = old""")
def apply_recnum_map(spark: SparkSession, sf: str) -> DataFrame:
    mapping = library(spark, sf).where("trash_state = 1").select(F.col("rec_id").cast("string").alias("old"), (F.col("rec_id") + 1).cast("string").alias("new"))
    mapped = op.apply_recnum_map(citations(spark, sf), mapping)
    pairs = mapped.groupBy("recnum").agg(F.count("new").alias("n_of_pair"))  # summed before the shuffle, however often a record is cited
    return mapped.select("doc_id", "pos", "recnum", "mapped").join(pairs, "recnum")


@P.add(r"""WITH l AS (SELECT o_orderkey AS line_no, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '# ' || o_custkey WHEN 2 THEN ' ' || o_custkey || ' ->  ' || o_orderkey || ' ' ELSE o_custkey || ' to ' || o_orderkey END AS line FROM orders)
SELECT line_no, nullif(regexp_extract(trim(line), '^(\d+)\s*->\s*(\d+)$', 1), '') AS old, nullif(regexp_extract(trim(line), '^(\d+)\s*->\s*(\d+)$', 2), '') AS new, NOT regexp_matches(trim(line), '^(\d+)\s*->\s*(\d+)$') AS error FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""")
def parse_map_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("# "), cust)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), cust, F.lit(" ->  "), key, F.lit(" "))).otherwise(F.concat(cust, F.lit(" to "), key))
    return op.parse_map_lines(o.select(F.col("o_orderkey").alias("line_no"), line.alias("line")))


def _number_lists(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    a, b, c = (F.col("l_partkey") % 90 + 1).cast("string"), (F.col("l_partkey") % 90 + 1 + F.col("l_suppkey") % 7 - 1).cast("string"), (F.col("l_suppkey") + 1).cast("string")
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(a, F.lit("-"), b, F.lit(","), c)).when(F.col("l_linenumber") % 3 == 1, F.concat(c, F.lit("; "), a, F.lit(" – "), b)).otherwise(F.concat(a, F.lit(",x,"), c))
    return l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), shown.alias("shown"))


_LISTS = r"""WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_partkey % 90 + 1 AS a, l_partkey % 90 + l_suppkey % 7 AS b, l_suppkey + 1 AS c FROM lineitem),
lists AS (SELECT *, CASE line % 3 WHEN 0 THEN a || '-' || b || ',' || c WHEN 1 THEN c || '; ' || a || ' – ' || b ELSE a || ',x,' || c END AS shown, CASE WHEN b > a THEN range(a, b + 1) ELSE [a, b] END AS ab FROM n)"""


@P.add(rf"""{_LISTS} SELECT doc_id, line, part, supp, array_to_string(CASE line % 3 WHEN 0 THEN ab || [c] WHEN 1 THEN [c] || ab ELSE [a, c] END, ' ') AS numbers FROM lists""")
def expand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _number_lists(spark, sf).select("doc_id", "line", "part", "supp", F.array_join(op.expanded_numbers(F.col("shown")).cast("array<string>"), " ").alias("numbers"))


@P.add(rf"""{_LISTS}, x AS (SELECT *, CASE line % 3 WHEN 0 THEN ab || [c] WHEN 1 THEN [c] || ab ELSE [a, c] END AS nums, dense_rank() OVER (PARTITION BY doc_id ORDER BY line, part, supp, shown) AS group_order FROM lists), r AS (SELECT doc_id, group_order, shown, unnest(range(0, len(nums))) AS place, nums FROM (SELECT DISTINCT doc_id, group_order, shown, nums FROM x)),
e AS (SELECT doc_id, group_order, trim(shown) AS display, place, nums[place + 1] AS num FROM r), b AS (SELECT o_orderkey AS doc_id, unnest(range(1, 31)) AS num, 'entry of ' || o_custkey AS text FROM orders)
SELECT e.doc_id, e.group_order::INT AS group_order, display, place::INT AS place, e.num::INT AS num, CASE WHEN b.text IS NULL THEN '#' || e.num ELSE e.num || ' — ' || b.text END AS label, count(*) OVER (PARTITION BY e.doc_id, e.num) AS n_in_doc,
 (SELECT count(DISTINCT group_order) FROM e g WHERE g.doc_id = e.doc_id) AS n_groups, count(*) OVER (PARTITION BY e.doc_id) AS n_citations, (SELECT count(DISTINCT num) FROM e g WHERE g.doc_id = e.doc_id) AS n_references FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.num = e.num""")
def number_listing(spark: SparkSession, sf: str) -> DataFrame:
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line", "part", "supp", "shown"))
    spans = _number_lists(spark, sf).select("doc_id", place.alias("group_order"), F.col("shown").alias("display")).distinct()
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("num"), F.concat(F.lit("entry of "), F.col("o_custkey").cast("string")).alias("text"))
    return op.number_listing(spans, entries)


@P.add(rf"""{_LISTS}, m AS (SELECT *, CASE line % 3 WHEN 0 THEN (CASE WHEN a <= 40 THEN a + 100 ELSE a END) || '-' || (CASE WHEN b BETWEEN 1 AND 40 THEN b + 100 ELSE b END) || ',' || (CASE WHEN c <= 40 THEN c + 100 ELSE c END)
 WHEN 1 THEN (CASE WHEN c <= 40 THEN c + 100 ELSE c END) || '; ' || (CASE WHEN a <= 40 THEN a + 100 ELSE a END) || ' – ' || (CASE WHEN b BETWEEN 1 AND 40 THEN b + 100 ELSE b END) ELSE (CASE WHEN a <= 40 THEN a + 100 ELSE a END) || ',x,' || (CASE WHEN c <= 40 THEN c + 100 ELSE c END) END AS rewritten FROM lists)
SELECT doc_id, line, part, supp, rewritten FROM m""")
def apply_number_map(spark: SparkSession, sf: str) -> DataFrame:
    numbers = F.create_map(*[F.lit(str(x)) for i in range(1, 41) for x in (i, i + 100)])
    return _number_lists(spark, sf).select("doc_id", "line", "part", "supp", op.applied_number_map(F.col("shown"), numbers).alias("rewritten"))


@P.add(f"{BASE}, s AS (SELECT doc_id, rec_id, count(*) AS score FROM citations GROUP BY ALL) SELECT * FROM (SELECT doc_id, rec_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rec_id) AS place FROM s) WHERE place <= 5")
def top_k_per_key(spark: SparkSession, sf: str) -> DataFrame:
    scored = citations(spark, sf).groupBy("doc_id", "rec_id").agg(F.count(F.lit(1)).alias("score"))
    return op.top_k_per_key(scored, "doc_id", "score", "rec_id", 5)


@P.add("""WITH x AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_suppkey % 11 = 0 THEN 'S' || l_linenumber ELSE l_linenumber || '.' || l_suppkey % 25 END AS label FROM lineitem),
y AS (SELECT *, list_transform(string_split(label, '.'), lambda v: coalesce(TRY_CAST(v AS INT), 999)) AS k FROM x) SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY k, label) AS place FROM y""")
def label_order(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    label = F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("S"), F.col("l_linenumber").cast("string"))).otherwise(F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 25).cast("string")))
    x = l.select(F.col("l_orderkey").alias("doc_id"), label.alias("label")).distinct()
    return x.select("doc_id", "label", F.row_number().over(Window.partitionBy("doc_id").orderBy(op.label_parts(F.col("label")), "label")).alias("place"))


@P.add(f"{BASE} SELECT doc_id, group_order, string_agg(recnum, ',' ORDER BY ref_pos) AS recnums FROM citations GROUP BY ALL ORDER BY doc_id, group_order LIMIT 25")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    groups = citations(spark, sf).groupBy("doc_id", "group_order").agg(F.array_sort(F.collect_list(F.struct("ref_pos", "recnum"))).alias("r"))
    return groups.select("doc_id", "group_order", F.array_join("r.recnum", ",").alias("recnums")).orderBy("doc_id", "group_order").limit(25)


@P.add("""WITH d AS (SELECT user_id AS doc_id, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'accepted' WHEN event_type = 'error' THEN 'skipped' END AS action FROM events)
SELECT doc_id, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'skipped') AS skipped, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (action = 'accepted'), '') AS accepted_ids FROM d WHERE action IS NOT NULL GROUP BY doc_id""")
def decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id", when_of(F.col("event_type"), {"purchase": "accepted", "signup": "accepted", "error": "skipped"}).alias("action")).where("action IS NOT NULL")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == "accepted", F.col("event_id")))), lambda x: x.cast("string")), ",")
    return e.groupBy("doc_id").agg(F.count_if(F.col("action") == "accepted").alias("accepted"), F.count_if(F.col("action") == "skipped").alias("skipped"), ids.alias("accepted_ids"))


QUERIES, ORACLES = P.queries, P.oracles
