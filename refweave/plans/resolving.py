"""Queries that match references, lists, paragraphs, claims and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.functions import text as tx
from refweave.operators import matching as op
from refweave.operators import transplant as tp
from refweave.plans.kit import BASE, CITATIONS, LIBRARY, Plans, citations, library, table
from refweave.sources.staging import staged

P = Plans()

_TYPO = "CASE WHEN supp % 5 = 0 THEN substr(author, 1, 1) || substr(author, 3) WHEN supp % 7 = 0 THEN author || 'x' ELSE author END"
_HINT = "title || ' ' || author || ' ' || CAST(supp % 30 AS STRING) || ', ' || CAST(rec_id + supp % 3 AS STRING)"
#: Further columns of the library's records.
_MORE = {"authors": "array(surname, CASE WHEN rec_id % 2 = 0 THEN 'standard' ELSE 'Promo, P.' END)", "pages": "CAST(rec_id AS STRING) || '-' || CAST(rec_id + 9 AS STRING)"}
_LIB = "lib AS (SELECT *, [surname, CASE WHEN rec_id % 2 = 0 THEN 'standard' ELSE 'Promo, P.' END] AS authors, rec_id || '-' || (rec_id + 9) AS pages FROM library WHERE trash_state = 0)"


def _lib(spark: SparkSession, sf: str) -> DataFrame:
    return library(spark, sf).where("trash_state = 0").select("*", *[F.expr(e).alias(k) for k, e in _MORE.items()])


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return citations(spark, sf).selectExpr("doc_id * 100 + pos AS ref_id", f"{_TYPO} AS surname", "CASE WHEN supp % 11 = 0 THEN '1899' ELSE cited_year END AS year", f"{_HINT} AS hint")


_REFS = f"{BASE}, refs AS (SELECT doc_id * 100 + pos AS ref_id, {_TYPO} AS surname, CASE WHEN supp % 11 = 0 THEN '1899' ELSE cited_year END AS year, {_HINT} AS hint FROM citations)"
_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))".format
_OVER = lambda a, b: f"len(list_intersect({_TERMS(a)}, {_TERMS(b)}))"
_LIKE = "(1.0 - levenshtein(lower(r.surname), lower(l.surname)) / greatest(length(r.surname), length(l.surname), 1)::DOUBLE)"


def _content(hint: str, rec: str, authors: bool) -> str:
    numbers = f"regexp_extract_all({hint}, '\\d+')"
    hits = f"(coalesce(list_contains({numbers}, {rec}.volume), false)::INT + len(list_filter(regexp_extract_all({rec}.pages, '\\d+'), lambda p: list_contains({numbers}, p))))"
    over = f"{_OVER(f'{rec}.title', hint)} + {_OVER(f'{rec}.journal', hint)}" + (f" + 0.6 * {_OVER(f"array_to_string({rec}.authors, ' ')", hint)}" if authors else "")
    return f"round(({over} + 0.5 * least({hits}, 2))::DOUBLE, 6)"


_BEST = "CASE WHEN cs IS NULL THEN 'none' WHEN len(cs) = 1 THEN 'exact' WHEN -cs[1].s >= 2 AND cs[2].s - cs[1].s >= 1.5 THEN 'exact' WHEN -cs[1].s >= 1 AND cs[1].s < cs[2].s THEN 'near' ELSE 'ambiguous' END"


@P.add(f"""{_REFS}, {_LIB}, id AS (SELECT DISTINCT surname, year, hint FROM refs), nm AS (SELECT r.surname, l.surname AS ln FROM (SELECT DISTINCT surname FROM id) r, (SELECT DISTINCT surname FROM lib) l WHERE {_LIKE} >= 0.85 OR starts_with(lower(l.surname), substr(lower(r.surname), 1, 4)) OR starts_with(lower(r.surname), substr(lower(l.surname), 1, 4))),
c AS (SELECT r.surname, r.year, r.hint, l.rec_id, {_content('r.hint', 'l', True)} AS score FROM id r JOIN nm ON nm.surname = r.surname JOIN lib l ON r.year = l.year AND l.surname = nm.ln),
k AS (SELECT surname, year, hint, min(rec_id) AS first, list(struct_pack(s := -score, rec_id := rec_id) ORDER BY -score, rec_id) AS cs FROM c GROUP BY ALL), k2 AS (SELECT *, {_BEST} AS match_kind FROM k),
n2 AS (SELECT surname, year, hint, CASE WHEN match_kind = 'ambiguous' THEN first ELSE cs[1].rec_id END AS rec_id, CASE WHEN len(cs) = 1 THEN 1.0 WHEN match_kind = 'ambiguous' THEN 0.0 ELSE -cs[1].s END::DOUBLE AS score, match_kind FROM k2),
names AS (SELECT lower(surname) AS surname, min(rec_id) AS rec_id FROM lib GROUP BY ALL), rest AS (SELECT id.* FROM id ANTI JOIN k2 USING (surname, year, hint)),
f AS (SELECT r.surname, l.surname AS ln, l.rec_id, {_LIKE} + CASE WHEN substr(lower(r.surname), 1, 5) = substr(l.surname, 1, 5) THEN 0.2 ELSE 0 END + 0.2 AS score FROM (SELECT DISTINCT surname FROM rest) r JOIN names l ON {_LIKE} >= 0.8 OR substr(lower(r.surname), 1, 5) = substr(l.surname, 1, 5)),
g AS (SELECT r.surname, r.year, r.hint, f.rec_id, f.score + CASE WHEN contains(lower(r.hint), substr(f.ln, 1, 4)) THEN 0.3 ELSE 0 END AS score FROM rest r JOIN f USING (surname)), best AS (SELECT surname, year, hint, arg_min(rec_id, struct_pack(a := -score, b := rec_id)) AS rec_id, max(score) AS score FROM g WHERE score >= 0.9 GROUP BY ALL),
found AS (SELECT * FROM n2 UNION ALL SELECT surname, year, hint, rec_id, score, 'near' FROM best)
SELECT ref_id, rec_id, coalesce(score, 0.0) AS score, coalesce(match_kind, 'none') AS match_kind FROM refs LEFT JOIN found USING (surname, year, hint)""")
def match_library(spark: SparkSession, sf: str) -> DataFrame:
    return op.match_library(_refs(spark, sf), _lib(spark, sf))


@P.add(f"""{BASE}, {_LIB}, i AS (SELECT doc_id * 100 + pos AS ident, author AS surname, cited_year AS year, {_HINT} AS hint FROM citations), c AS (SELECT ident, rec_id, {_content('hint', 'l', False)} AS score FROM i JOIN lib l ON i.surname = l.surname AND i.year = l.year),
k AS (SELECT ident, list(struct_pack(s := -score, rec_id := rec_id) ORDER BY -score, rec_id) AS cs FROM c GROUP BY ident) SELECT i.ident, cs[1].rec_id AS rec_id, -cs[1].s AS score, {_BEST} AS match_kind FROM i LEFT JOIN k USING (ident)""")
def resolve_cited_record(spark: SparkSession, sf: str) -> DataFrame:
    i = citations(spark, sf).selectExpr("doc_id * 100 + pos AS ident", "author AS surname", "cited_year AS year", f"{_HINT} AS hint")
    return op.resolve_cited(i, _lib(spark, sf))


def _groups(spark: SparkSession, sf: str, where: str) -> DataFrame:
    return citations(spark, sf).where(where).selectExpr("doc_id * 100 + group_order AS group_id", "author || ' ' || CAST(rec_id % 40 AS STRING) AS ident")


@P.add(f"""{BASE}, g AS (SELECT doc_id % 2 AS side, doc_id * 100 + group_order AS group_id, string_agg(DISTINCT author || ' ' || (rec_id % 40), '|' ORDER BY author || ' ' || (rec_id % 40)) AS ids FROM citations GROUP BY ALL)
SELECT t.group_id, min(s.group_id) AS source_id, t.ids FROM g t JOIN g s ON t.ids = s.ids WHERE t.side = 0 AND s.side = 1 GROUP BY t.group_id, t.ids""")
def group_exact_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return op.group_reuse(_groups(spark, sf, "doc_id % 2 = 0"), _groups(spark, sf, "doc_id % 2 = 1"))


_LISTS = r"""WITH a AS (SELECT item_id AS id, text FROM benchmark), b AS (SELECT 1000000 + item_id AS id, array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 3 <> 0), ' ') AS text FROM benchmark WHERE item_id % 4 <> 0)"""


def _list_a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


def _list_b(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").where("item_id % 4 <> 0")
    return b.select((F.lit(1000000) + F.col("item_id")).alias("id"), F.array_join(F.filter(F.split("text", " "), lambda x, i: (i + 1) % 3 != 0), " ").alias("text"))


def _tfidf(name: str, fit: str, apply: str) -> str:
    """CTEs: {name}(id, term, w) of the texts `apply`, in the vocabulary fitted on `fit`."""
    grams = lambda s: f"SELECT id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1) AS ws FROM {s})"
    # words of one character split a pair's neighbours in neither reading, for both drop them first
    return f"""{name}_t AS (SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM ({grams(fit)}) GROUP BY term ORDER BY cf DESC, term LIMIT 50000), {name}_f AS (SELECT id, term, count(*) AS tf FROM ({grams(apply)}) GROUP BY ALL),
{name}_w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {fit})) / (1 + df)) + 1) AS w FROM {name}_f JOIN {name}_t USING (term)), {name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_w)"""


@P.add(f"{_LISTS}, {_tfidf('v', 'a', 'a')} SELECT id, term, round(w, 6) AS w FROM v")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return op.tfidf_weights(_list_a(spark, sf)).withColumn("w", F.round("w", 6))


@P.add(f"""{_LISTS}, ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_tfidf('v', 'ab', 'ab')}, s AS (SELECT x.id AS a_id, y.id AS b_id, round(sum(x.w * y.w), 6) AS score FROM v x JOIN v y USING (term) WHERE x.id < 1000000 AND y.id >= 1000000 GROUP BY ALL),
m AS (SELECT a_id, arg_min(b_id, struct_pack(p := -score, q := b_id)) AS b_id, max(score) AS score FROM s GROUP BY a_id), r AS (SELECT a.id AS a_id, CASE WHEN score >= 0.08 THEN b_id END AS b_id, coalesce(score, 0.0) AS score, CASE WHEN score >= 0.28 THEN 'matched' WHEN score >= 0.08 THEN 'review' ELSE 'only_a' END AS status FROM a LEFT JOIN m ON a.id = a_id)
SELECT * FROM r UNION ALL SELECT NULL, id, 0.0, 'only_b' FROM b WHERE id NOT IN (SELECT b_id FROM r WHERE status = 'matched')""")
def compare_reference_lists(spark: SparkSession, sf: str) -> DataFrame:
    return op.compare_lists(_list_a(spark, sf), _list_b(spark, sf))


# Every line of every document is a query.
_SENT = "q AS (SELECT doc_id * 10000 + i - 1 AS id, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE length(ls[i]) >= 15)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _paras(spark, sf).where("length(text) >= 15").select(F.col("para_id").alias("id"), "text")


@P.add(f"""{_LISTS}, {_SENT}, {_tfidf('dv', 'a', 'a')}, {_tfidf('qv', 'a', 'q')}, s AS (SELECT x.id AS q_id, y.id AS d_id, round(sum(x.w * y.w), 6) AS score FROM qv x JOIN dv y USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS place FROM s) WHERE place <= 5""")
def top_matches(spark: SparkSession, sf: str) -> DataFrame:
    return op.top_matches(_lines(spark, sf), _list_a(spark, sf))


@P.add(f"""{_LISTS}, {_SENT}, {_tfidf('dv', 'a', 'a')}, {_tfidf('qv', 'a', 'q')}, s AS (SELECT x.id AS q_id, y.id AS d_id, round(sum(x.w * y.w), 6) AS score FROM qv x JOIN dv y USING (term) GROUP BY ALL), k AS (SELECT q_id, max(score) AS best, arg_min(d_id, struct_pack(a := -score, b := d_id)) AS d_id FROM s GROUP BY q_id)
SELECT id AS q_id, coalesce(best, 0.0) AS score, CASE WHEN best >= 0.12 THEN '[item ' || d_id || ']' ELSE 'review' END AS label FROM q LEFT JOIN k ON id = q_id""")
def insert_author_label(spark: SparkSession, sf: str) -> DataFrame:
    q = _lines(spark, sf)
    best = op.top_matches(q, _list_a(spark, sf), 1)
    out = q.select(F.col("id").alias("q_id")).join(best, "q_id", "left")
    return out.select("q_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score") >= 0.12, F.concat(F.lit("[item "), F.col("d_id").cast("string"), F.lit("]"))).otherwise("review").alias("label"))


@P.add(f"""{_LISTS}, even AS (SELECT * FROM b WHERE id % 2 = 0), odd AS (SELECT * FROM b WHERE id % 2 = 1), {_tfidf('ev', 'even', 'even')}, {_tfidf('eq', 'even', 'a')}, {_tfidf('ov', 'odd', 'odd')}, {_tfidf('oq', 'odd', 'a')},
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS place FROM (SELECT x.id AS q_id, y.id AS d_id, round(sum(x.w * y.w), 6) AS score FROM eq x JOIN ev y USING (term) GROUP BY ALL)) WHERE place <= 3 AND score >= 0.1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS place FROM (SELECT x.id AS q_id, y.id AS d_id, round(sum(x.w * y.w), 6) AS score FROM oq x JOIN ov y USING (term) GROUP BY ALL)) WHERE place <= 3 AND score >= 0.1 AND q_id NOT IN (SELECT q_id FROM e))
SELECT q_id, d_id, score, place, 'first' AS source FROM e UNION ALL SELECT q_id, d_id, score, place, 'second' FROM o UNION ALL SELECT id, NULL, 0.0, 0, 'notfound' FROM a WHERE id NOT IN (SELECT q_id FROM e UNION SELECT q_id FROM o)""")
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    b = _list_b(spark, sf)
    return op.catalog_lookup(_list_a(spark, sf), b.where("id % 2 = 0"), b.where("id % 2 = 1"))


@P.add(f"""{_LISTS}, {LIBRARY}, cat AS (SELECT rec_id AS id, title AS text FROM library WHERE year BETWEEN '1960' AND '1985' AND journal = 'ECONOMY'), q AS (SELECT 0::BIGINT AS id, 'small blue ring economy' AS text UNION ALL SELECT 1, 'hot gear'), {_tfidf('dv', 'cat', 'cat')}, {_tfidf('qv', 'cat', 'q')}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS place FROM (SELECT x.id AS q_id, y.id AS d_id, round(sum(x.w * y.w), 6) AS score FROM qv x JOIN dv y USING (term) GROUP BY ALL)) WHERE place <= 20""")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    cat = library(spark, sf).where("year BETWEEN '1960' AND '1985' AND journal = 'ECONOMY'").select(F.col("rec_id").alias("id"), F.col("title").alias("text"))
    q = spark.createDataFrame([(0, "small blue ring economy"), (1, "hot gear")], "id long, text string")
    return op.top_matches(q, cat, 20)


@P.add(f"""{BASE}, a AS (SELECT author AS surname, cited_year AS year, count(*) AS n_a FROM citations WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT author AS surname, cited_year AS year, count(*) AS n_b FROM citations WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.surname, b.surname) AS surname, coalesce(a.year, b.year) AS year, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN n_b IS NULL THEN 'missing' WHEN n_a IS NULL THEN 'extra' ELSE 'both' END AS status FROM a FULL JOIN b ON a.surname = b.surname AND a.year = b.year""")
def audit_bibliographies(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).selectExpr("author AS surname", "cited_year AS year", "doc_id")
    return op.audit_keys(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


_P80 = """p AS (SELECT doc_id * 10000 + i AS para_id, doc_id, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS sig FROM (SELECT doc_id, ls[i] AS text, i - 1 AS i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE length(text) >= 15),
o80 AS (SELECT substr(sig, 1, 80) AS k, min(para_id) AS old_id FROM p WHERE doc_id % 2 = 0 GROUP BY ALL), o50 AS (SELECT substr(sig, 1, 50) AS k, min(para_id) AS old_id FROM p WHERE doc_id % 2 = 0 GROUP BY ALL),
matched AS (SELECT n.para_id, CASE WHEN o80.old_id IS NOT NULL THEN o80.old_id WHEN length(sig) > 40 THEN o50.old_id END AS old_id FROM p n LEFT JOIN o80 ON substr(sig, 1, 80) = o80.k LEFT JOIN o50 ON substr(sig, 1, 50) = o50.k WHERE doc_id % 2 = 1)"""


def _paras(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("doc_id") * 10000 + F.col("i")).alias("para_id"), "text")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    p = _paras(spark, sf)
    return op.match_paragraphs(p.where("doc_id % 2 = 1"), p.where("doc_id % 2 = 0"))


@P.add(f"WITH {_P80} SELECT para_id, old_id, CASE WHEN old_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM matched")
def match_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)


# Runs that cite: which paragraphs have them follows from the paragraph's length, in the old and the new version by different rules.
_RUNS80 = """oc AS (SELECT para_id, i AS run_idx, '[' || (length(text) % 50 + i) || ']' AS text FROM (SELECT para_id, text, unnest(range(0, 1 + length(text) % 2)) AS i FROM p WHERE doc_id % 2 = 0 AND length(text) % 3 > 0)), nc AS (SELECT para_id FROM p WHERE doc_id % 2 = 1 AND length(text) % 5 = 0),
nr AS (SELECT para_id, length(text) % 4 AS last FROM p WHERE doc_id % 2 = 1), st AS (SELECT m.para_id, m.old_id, CASE WHEN m.old_id IS NULL THEN 'unmatched' WHEN m.para_id IN (SELECT para_id FROM nc) THEN 'already' WHEN m.old_id IN (SELECT para_id FROM oc) THEN 'restored' ELSE 'plain' END AS status FROM matched m)"""


def _citing_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of the new paragraphs, those of them that cite, and the citing runs of the old ones."""
    p = _paras(spark, sf).where("length(text) >= 15")
    new, old = p.where("doc_id % 2 = 1"), p.where("doc_id % 2 = 0")
    cites = old.where("length(text) % 3 > 0").select("para_id", "text", F.explode(F.expr("sequence(0, length(text) % 2)")).alias("run_idx"))
    runs = new.select("para_id", F.explode(F.expr("sequence(0, length(text) % 4)")).alias("run_idx"))
    return runs, new.where("length(text) % 5 = 0").select("para_id"), cites.select("para_id", "run_idx", F.concat(F.lit("["), F.expr("length(text) % 50 + run_idx").cast("string"), F.lit("]")).alias("text"))


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    _, new_cites, old_cites = _citing_runs(spark, sf)
    return op.restore_status(_matched(spark, sf), new_cites, old_cites)


@P.add(f"WITH {_P80}, {_RUNS80} SELECT para_id // 10000 AS doc_id, count(old_id) AS matched, count(*) FILTER (status = 'restored') AS restored, count(*) FILTER (status = 'already') AS already, count(*) FILTER (status = 'unmatched') AS unmatched FROM st GROUP BY ALL")
def restore_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _statuses(spark, sf).groupBy(F.floor(F.col("para_id") / 10000).alias("doc_id")).agg(F.count("old_id").alias("matched"), n("restored"), n("already"), n("unmatched"))


@P.add(f"WITH {_P80}, {_RUNS80} SELECT st.para_id, (nr.last + row_number() OVER (PARTITION BY st.para_id ORDER BY oc.run_idx))::BIGINT AS run_idx, oc.text FROM st JOIN nr ON nr.para_id = st.para_id JOIN oc ON oc.para_id = st.old_id WHERE status = 'restored'")
def copy_citations(spark: SparkSession, sf: str) -> DataFrame:
    runs, _, old_cites = _citing_runs(spark, sf)
    return op.copied_runs(_statuses(spark, sf), runs, old_cites).withColumn("run_idx", F.col("run_idx").cast("long"))


@P.add(f"""{BASE}, e AS (SELECT doc_id, pos, CASE WHEN rec_id % 4 = 0 THEN author END AS heading, supp % 6 AS num FROM citations), s AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM e),
bib AS (SELECT doc_id, section, num, min(body) AS body FROM (SELECT doc_id, CASE WHEN supp % 2 = 0 THEN '' ELSE author END AS section, supp % 6 AS num, title AS body FROM citations) GROUP BY ALL)
SELECT s.doc_id, s.pos, s.num, s.section, coalesce(o.body, f.body) AS body FROM s LEFT JOIN bib o ON o.doc_id = s.doc_id AND o.section = s.section AND o.num = s.num LEFT JOIN bib f ON f.doc_id = s.doc_id AND f.section = '' AND f.num = s.num WHERE heading IS NULL""")
def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).withColumn("num", F.col("supp") % 6)
    bib = c.select("doc_id", F.when(F.col("supp") % 2 == 0, "").otherwise(F.col("author")).alias("section"), "num", "title").groupBy("doc_id", "section", "num").agg(F.min("title").alias("body"))
    return op.section_lookup(c.where("rec_id % 4 <> 0").select("doc_id", "pos", "num"), c.where("rec_id % 4 = 0").select("doc_id", "pos", F.col("author").alias("section")), bib)


_SH = """cw AS (SELECT item_id AS claim_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark), tw AS (SELECT doc_id AS text_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
cs AS (SELECT DISTINCT claim_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT claim_id, w, unnest(range(1, len(w) - 3)) AS i FROM cw)), ts AS (SELECT DISTINCT text_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT text_id, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
n AS (SELECT claim_id, count(*) AS n FROM cs GROUP BY ALL), contained AS (SELECT claim_id, text_id, count(*) AS shared, any_value(n) AS n, round(count(*) / any_value(n), 6) AS containment FROM ts JOIN cs USING (h) JOIN n USING (claim_id) GROUP BY ALL)"""


def _contained(spark: SparkSession, sf: str) -> DataFrame:
    return op.claim_containment(table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@P.add(f"WITH {_SH} SELECT claim_id, text_id, shared, n, containment FROM contained")
def claim_source_match(spark: SparkSession, sf: str) -> DataFrame:
    return _contained(spark, sf)


@P.add(f"WITH {_SH} SELECT item_id AS claim_id, coalesce(max(containment), 0.0) AS published, arg_min(text_id, struct_pack(a := -containment, b := text_id)) AS text_id FROM benchmark LEFT JOIN contained ON item_id = claim_id GROUP BY ALL")
def tier_contained(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a claim's shingles in the text that holds most of them."""
    best = _contained(spark, sf).groupBy("claim_id").agg(F.min(F.struct((-F.col("containment")).alias("s"), "text_id")).alias("b"))
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"))
    return c.join(best, "claim_id", "left").select("claim_id", F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("published"), F.col("b.text_id").alias("text_id"))


@P.add()
def published_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The exact ratio of claims with the published texts that share words in order with them."""
    return op.published_ratio(table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TOPIC = lambda c: f"list_filter({_TERMS(c)}, lambda w: NOT list_contains({_STOPS}, w))"
_SHARE = lambda c, t: f"len(list_intersect({_TOPIC(c)}, {_TERMS(t)})) / greatest(len({_TOPIC(c)}), 1)::DOUBLE"
_PART = "author || ' of ' || cited_year || CASE WHEN supp % 3 = 0 THEN ' economy with these' ELSE ' standard matter which then was' END"
# The published version of a document holds the claims of some of its citations.
_CLAIMS = f"""{BASE}, claims AS (SELECT doc_id, doc_id * 100 + group_order AS claim_id, string_agg({_PART}, ' ' ORDER BY ref_pos) AS claim, list(title ORDER BY ref_pos) AS titles, arg_min(author, ref_pos) AS author, arg_min(rec_year, ref_pos) AS year, arg_min(title, ref_pos) AS title, arg_min(supp, ref_pos) % 4 <> 0 AS kept FROM citations GROUP BY ALL),
t AS (SELECT claim_id, round(coalesce(list_max(list_transform(titles, lambda x: {_SHARE('claim', 'x')})), 0), 6) AS topical FROM claims), asked AS (SELECT claim_id, claim, author, year, list_distinct(regexp_extract_all(lower(title), '[a-z]{{5,}}')[1:4]) AS ws FROM claims), looked AS (SELECT a.author, a.year, a.ws, min(l.rec_id) AS rec_id FROM (SELECT DISTINCT author, year, ws FROM asked) a JOIN library l ON lower(a.author) = lower(l.surname) AND a.year = l.year AND list_has_all(regexp_extract_all(lower(l.title), '[a-z]{{5,}}'), a.ws) GROUP BY ALL),
abs AS (SELECT claim_id, round({_SHARE('claim', "(l.title || ' economy')")}, 6) AS c FROM asked a JOIN looked o ON a.author = o.author AND a.year = o.year AND a.ws = o.ws JOIN library l ON l.rec_id = o.rec_id),
pw AS (SELECT doc_id, string_split(string_agg(lower(claim), ' ' ORDER BY claim_id), ' ') AS w FROM claims WHERE kept GROUP BY doc_id), psh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM pw)),
csh AS (SELECT DISTINCT doc_id, claim_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, claim_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, claim_id, string_split(lower(claim), ' ') AS w FROM claims))), pub AS (SELECT claim_id, round(count(psh.h) / count(*), 6) AS b FROM csh LEFT JOIN psh USING (doc_id, h) GROUP BY claim_id)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).select("*", (F.col("doc_id") * 100 + F.col("group_order")).alias("claim_id"), F.expr(_PART).alias("part"))
    refs = F.collect_list(F.struct("ref_pos", "part", "title", "author", "rec_year", "supp")).over(Window.partitionBy("doc_id", "line"))  # in the order that the rows have already
    g = c.withColumn("r", refs).where("ref_pos = 1").withColumn("r", F.array_sort("r"))
    return g.select("doc_id", "claim_id", F.array_join("r.part", " ").alias("claim"), F.col("r.title").alias("titles"), F.col("r")[0]["author"].alias("author"), F.col("r")[0]["rec_year"].alias("year"), F.col("r")[0]["title"].alias("title"), (F.col("r")[0]["supp"] % 4 != 0).alias("kept"))


@P.add(f"{_CLAIMS} SELECT * FROM t")
def tier_topical(spark: SparkSession, sf: str) -> DataFrame:
    return op.topical(_claims(spark, sf))


def _abstracts(spark: SparkSession, sf: str, claims: DataFrame) -> DataFrame:
    """What the catalogue, which is the library with its titles and a word more for abstracts, has for the claims' first references."""
    catalog = library(spark, sf).select("rec_id", "surname", "year", "title", F.concat("title", F.lit(" economy")).alias("abstract"))
    return op.catalog_abstracts(claims.select(F.col("claim_id").alias("ref_id"), "author", "year", "title"), catalog)


@P.add(f"{_CLAIMS} SELECT * FROM abs")
def tier_abstract(spark: SparkSession, sf: str) -> DataFrame:
    claims = staged(_claims(spark, sf), "claims")
    return op.abstract_share(claims, _abstracts(spark, sf, claims))


_VERDICT = f"""{_CLAIMS}, s AS (SELECT claim_id, topical AS a, coalesce(b, 0) AS b, c FROM t LEFT JOIN pub USING (claim_id) LEFT JOIN abs USING (claim_id)),
v AS (SELECT claim_id, CASE WHEN b > 0.7 AND greatest(a, coalesce(c, 0)) >= 0.12 THEN 'verified' WHEN greatest(a, coalesce(c, 0)) >= 0.25 OR coalesce(c, 0) >= 0.2 THEN 'supported' WHEN greatest(a, coalesce(c, 0)) >= 0.1 OR b > 0.7 THEN 'plausible' ELSE 'review' END AS verdict FROM s)"""


def _published(claims: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("claim_id", "claim")))
    return claims.where("kept").groupBy("doc_id").agg(F.array_join(parts["claim"], " ").alias("text")).select(F.col("doc_id").alias("text_id"), "text")


def _ratios(claims: DataFrame, above: float = 0.0) -> DataFrame:
    """Each claim against the published version of its own document, window by window."""
    return op.window_ratios(claims.select("claim_id", F.col("doc_id").alias("text_id"), F.col("claim").alias("text")), _published(claims), above)


@P.add()
def tier_published(spark: SparkSession, sf: str) -> DataFrame:
    """The matching-blocks ratio of every claim with its document's published version."""
    return _ratios(staged(_claims(spark, sf), "claims")).select("claim_id", F.col("ratio").alias("published"))


def _contained_in_published(claims: DataFrame) -> DataFrame:
    mine = claims.select("doc_id", "claim_id", F.col("claim").alias("text"))
    return op.claim_containment(mine, _published(claims).withColumn("doc_id", F.col("text_id")), within=("doc_id",)).select("claim_id", F.col("containment").alias("b"))


def _verdicts(spark: SparkSession, sf: str, by_ratio: bool = False) -> DataFrame:
    """Verdicts with the published tier as a ratio, or as the share of shingles, which SQL can say. Of ratios they ask whether one exceeds 0.7."""
    claims = staged(_claims(spark, sf), "claims")
    b = _ratios(claims, 0.7).select("claim_id", F.col("ratio").alias("b")) if by_ratio else _contained_in_published(claims)
    return op.verdicts(op.topical(claims).withColumnRenamed("topical", "a").join(b, "claim_id", "left").join(op.abstract_share(claims, _abstracts(spark, sf, claims)), "claim_id", "left"))


@P.add()
def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, by_ratio=True).select("claim_id", "verdict")


@P.add(f"{_VERDICT} SELECT claim_id, verdict FROM v")
def verify_by_shingles(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select("claim_id", "verdict")


@P.add(f"{_VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@P.add(f"{_VERDICT} SELECT claim_id, verdict, CASE verdict WHEN 'review' THEN 0 WHEN 'plausible' THEN 1 WHEN 'supported' THEN 2 ELSE 3 END AS verdict_order FROM v ORDER BY verdict_order, claim_id")
def verdict_order(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).orderBy("verdict_order", "claim_id")


@P.add("""WITH k AS (SELECT ref_id, list_filter(ws, lambda x, i: length(x) > 5 AND list_position(ws, x) = i)[1:5] AS ks FROM (SELECT item_id AS ref_id, string_split_regex(lower(text), '[^a-z0-9]+') AS ws FROM benchmark)), n AS (SELECT ref_id, unnest(ks) AS w, least(3, len(ks)) AS need FROM k WHERE len(ks) > 0)
SELECT ref_id, doc_id AS para_id, count(*) AS n FROM n JOIN documents ON contains(lower(text), w) GROUP BY ref_id, doc_id, need HAVING count(*) >= need""")
def reference_usage(spark: SparkSession, sf: str) -> DataFrame:
    return op.reference_usage(table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("title")), table(spark, sf, "documents").select(F.col("doc_id").alias("para_id"), "text"))


@P.add(f"""{BASE}, sheet AS (SELECT rec_id AS number, surname AS label FROM library WHERE rec_id % 3 <> 0) SELECT doc_id, rec_id AS fig_num, 'The ' || upper(CASE WHEN supp % 4 = 0 THEN 'wrong' ELSE author END) AS caption, label AS listed, CASE WHEN label IS NULL THEN 'not listed' WHEN supp % 4 <> 0 THEN 'match' ELSE 'mismatch' END AS status FROM citations LEFT JOIN sheet ON rec_id = number""")
def figure_naming_xref(spark: SparkSession, sf: str) -> DataFrame:
    caps = citations(spark, sf).select("doc_id", F.col("rec_id").alias("fig_num"), F.concat(F.lit("The "), F.upper(F.when(F.col("supp") % 4 == 0, "wrong").otherwise(F.col("author")))).alias("caption"))
    return op.naming_xref(caps, library(spark, sf).where("rec_id % 3 <> 0").select(F.col("rec_id").alias("number"), F.col("surname").alias("label")))


@P.add(f"{BASE} SELECT doc_id, 'Fig ' || rec_id AS label, CASE WHEN saved.st IS NULL THEN supp ELSE saved.st END AS crop_top, CASE WHEN saved.st IS NULL THEN supp + 50 ELSE saved.sb END AS crop_bot, saved.st IS NOT NULL AS saved FROM citations LEFT JOIN (SELECT rec_id AS r, rec_id % 70 AS st, rec_id % 70 + 30 AS sb FROM library WHERE rec_id % 2 = 0) saved ON r = rec_id")
def apply_saved_crops(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("Fig "), F.col("rec_id").cast("string")).alias("label")
    figs = citations(spark, sf).select("doc_id", label, F.col("supp").alias("crop_top"), (F.col("supp") + 50).alias("crop_bot"))
    return op.apply_saved(figs, library(spark, sf).where("rec_id % 2 = 0").select(label, (F.col("rec_id") % 70).alias("crop_top"), (F.col("rec_id") % 70 + 30).alias("crop_bot")))


_WIN = f"""{BASE}, rows AS (SELECT doc_id, pos, title || ' for the ' || author AS text, rec_id % 3 = 0 AS is_cite FROM citations), ws AS (SELECT *, CASE WHEN is_cite THEN [] ELSE list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x NOT IN ('the', 'for')) END AS w FROM rows),
b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ws), placed AS (SELECT doc_id, base + i - 1 AS place, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM b)),
bags AS (SELECT DISTINCT c.doc_id, c.pos AS cite, word FROM b c JOIN placed p ON p.doc_id = c.doc_id AND place >= base - 20 AND place < base + 12 WHERE is_cite), idf AS (SELECT word, count(*) AS df, round(ln(((SELECT count(*) FROM (SELECT DISTINCT doc_id, cite FROM bags)) + 1) / (count(*) + 0.5)) + 1, 6) AS idf FROM bags GROUP BY word)"""


def _cited_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = citations(spark, sf).withColumns({"cited": F.col("title"), "title": F.concat("title", F.lit(" for the "), "author"), "is_cite": F.col("rec_id") % 3 == 0})
    return rows.withColumnRenamed("title", "text")


def _bags(spark: SparkSession, sf: str) -> DataFrame:
    return op.context_words(_cited_rows(spark, sf).select("doc_id", "pos", "text", "is_cite"), ["the", "for"])


@P.add(f"{_WIN} SELECT * FROM bags")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _bags(spark, sf)


@P.add(f"{_WIN} SELECT * FROM idf")
def context_idf(spark: SparkSession, sf: str) -> DataFrame:
    return op.context_idf(_bags(spark, sf))


# Documents in pairs: an even one is the version to be mended, the odd one that follows is the intact one.
_SIM = f"""{_WIN.replace("WITH ", "WITH RECURSIVE ", 1)}, x AS (SELECT doc_id - doc_id % 2 AS pair, doc_id % 2 = 0 AS is_t, cite, word, idf FROM bags JOIN idf USING (word)), sz AS (SELECT pair, is_t, cite, sum(idf) AS n FROM x GROUP BY ALL),
sims AS (SELECT a.pair AS doc_id, a.cite AS t, b.cite AS s, round(sum(a.idf) / (any_value(p.n) + any_value(q.n) - sum(a.idf)), 6) AS sim FROM x a JOIN x b ON a.pair = b.pair AND a.word = b.word JOIN sz p ON p.pair = a.pair AND p.is_t AND p.cite = a.cite JOIN sz q ON q.pair = b.pair AND NOT q.is_t AND q.cite = b.cite WHERE a.is_t AND NOT b.is_t GROUP BY ALL)"""


def _windows(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The rows of citations with the words of their windows, written once."""
    rows = op.context_lists(_cited_rows(spark, sf), ["the", "for"])
    return staged(rows.select("doc_id", "pos", "words", *more), "context-windows")


def _sims(windows: DataFrame) -> DataFrame:
    held = windows.where("size(words) > 0").select("doc_id", F.col("pos").alias("cite"), "words")
    idf = staged(op.context_idf(held.select(F.explode("words").alias("word")), held.count()), "context-idf")
    return op.similar_windows(held.select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), (F.col("doc_id") % 2).alias("side"), "cite", "words"), idf)


@P.add(f"{_SIM} SELECT * FROM sims")
def context_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _sims(_windows(spark, sf))


_TOKEN = {
    "kind": "CASE WHEN rec_id % 3 <> 0 THEN 'text' WHEN flag = 'R' THEN 'bare' WHEN supp % 13 = 0 THEN 'refmarker' ELSE 'field' END",
    "text": "CASE WHEN rec_id % 3 <> 0 THEN title || ' for the ' || author || '. ' WHEN flag = 'R' THEN recnum WHEN supp % 13 = 0 THEN '[[REF ' || recnum || ']]' ELSE '(' || author || ', ' || rec_year || ') ' END",
    "instr": "CASE WHEN rec_id % 3 = 0 AND flag <> 'R' AND supp % 13 <> 0 THEN ' ADDIN EN.CITE ' || CASE WHEN supp % 4 = 0 THEN 'INVALID CITATION' ELSE '' END || '<RecNum>' || CASE WHEN supp % 5 = 0 THEN '0' ELSE recnum END || '</RecNum>' END",
    "surname": "CASE WHEN rec_id % 3 = 0 AND flag <> 'R' AND supp % 13 <> 0 THEN author END", "year": "rec_year", "title": "title",
}
_TOKENS = f"""tokens AS (SELECT doc_id, pos, {", ".join(f"{e} AS {k}" for k, e in _TOKEN.items())} FROM citations), tk AS (SELECT *, doc_id - doc_id % 2 AS pair, kind <> 'text' AS is_cite, kind <> 'field' OR contains(coalesce(instr, ''), 'INVALID CITATION') OR regexp_extract(coalesce(instr, ''), '<RecNum>(\\d+)</RecNum>', 1) IN ('', '0') AS broken FROM tokens),
tg AS (SELECT * FROM tk WHERE is_cite AND doc_id % 2 = 0), sr AS (SELECT * FROM tk WHERE kind = 'field' AND NOT broken AND doc_id % 2 = 1)"""


#: What tokens are made of.
_MADE_OF = ("rec_id", "recnum", "flag", "supp", "author", "rec_year", "cited")


def _tokens(rows: DataFrame) -> DataFrame:
    """Tokens of citations, or of _windows with the columns _MADE_OF."""
    return (rows.withColumnRenamed("cited", "title") if "cited" in rows.columns else rows).select("doc_id", "pos", *[F.expr(e).alias(k) for k, e in _TOKEN.items()])


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of the versions to be mended, and of the intact ones, by pair."""
    cites = tp.marked_broken(_tokens(rows))
    return tuple(cites.where(F.col("doc_id") % 2 == k).withColumn("doc_id", F.col("doc_id") - k) for k in (0, 1))


_CHOSEN = f"""{_SIM}, {_TOKENS},
bonus AS (SELECT t.pair AS doc_id, t.pos AS t, s.pos AS s, CASE WHEN t.year = s.year THEN 0.1 + 0.05 * least({_OVER('t.title', 's.title')}, 6) ELSE 0.03 END AS b, CASE WHEN t.year = s.year THEN {_OVER('t.title', 's.title')} ELSE 0 END AS ov FROM tg t JOIN sr s ON t.pair = s.pair AND t.surname = s.surname),
sc AS (SELECT doc_id, t, s, round(sum(w), 6) AS sim, max(ov) AS ov FROM (SELECT doc_id, t, s, sim AS w, 0 AS ov FROM sims UNION ALL SELECT doc_id, t, s, b::DOUBLE, ov FROM bonus) GROUP BY ALL), sp AS (SELECT sc.*, round(sim * 1000000)::BIGINT AS w FROM sc JOIN sr ON sr.pair = sc.doc_id AND sr.pos = sc.s),
chain AS (SELECT doc_id, t, s, w AS total, [t, s] AS path FROM sp WHERE sim >= 0.12 UNION ALL SELECT p.doc_id, p.t, p.s, total + p.w, path || [p.t, p.s] FROM chain c JOIN sp p ON p.doc_id = c.doc_id AND p.t > c.t AND p.s > c.s WHERE p.sim >= 0.12),
bestc AS (SELECT doc_id, max(struct_pack(a := total, b := path)).b AS path FROM chain GROUP BY doc_id), al AS (SELECT doc_id, path[2 * i - 1] AS t, path[2 * i] AS s FROM (SELECT doc_id, path, unnest(range(1, len(path) // 2 + 1)) AS i FROM bestc)),
el AS (SELECT tg.pair AS doc_id, tg.pos AS t, row_number() OVER (PARTITION BY tg.pair ORDER BY tg.pos) AS k, al.s AS cur, c.w AS cur_w, (SELECT list(struct_pack(s := sp.s, w := sp.w) ORDER BY sp.w DESC, sp.s) FROM sp WHERE sp.doc_id = tg.pair AND sp.t = tg.pos AND sp.w >= 400000) AS cs FROM tg LEFT JOIN al ON al.doc_id = tg.pair AND al.t = tg.pos LEFT JOIN sp c ON c.doc_id = tg.pair AND c.t = tg.pos AND c.s = al.s WHERE broken),
fb AS (SELECT doc_id, 0::BIGINT AS k, (SELECT list(s) FROM al WHERE al.doc_id = d.doc_id) AS used, NULL::BIGINT AS t, NULL::STRUCT(s BIGINT, w BIGINT) AS pick FROM (SELECT DISTINCT doc_id FROM el) d UNION ALL
 SELECT doc_id, k, CASE WHEN pick IS NULL OR kept THEN used ELSE coalesce(used, []) || [pick.s] END, t, pick FROM (SELECT e.doc_id, e.k, f.used, e.t, coalesce(e.cur_w, 0) >= 400000 AS kept, CASE WHEN coalesce(e.cur_w, 0) >= 400000 THEN struct_pack(s := e.cur, w := e.cur_w) ELSE list_filter(e.cs, lambda x: NOT list_contains(coalesce(f.used, []), x.s))[1] END AS pick FROM fb f JOIN el e ON e.doc_id = f.doc_id AND e.k = f.k + 1)),
ch AS (SELECT doc_id, t, pick.s AS s, pick.w AS w FROM fb WHERE k > 0),
am AS (SELECT ch.doc_id, ch.t FROM ch JOIN tg ON tg.pair = ch.doc_id AND tg.pos = ch.t JOIN sr s ON s.pair = ch.doc_id AND s.pos = ch.s JOIN sr o ON o.pair = ch.doc_id AND o.surname = s.surname AND o.year = s.year AND o.pos <> s.pos LEFT JOIN sp a ON a.doc_id = ch.doc_id AND a.t = ch.t AND a.s = ch.s LEFT JOIN sp b ON b.doc_id = ch.doc_id AND b.t = ch.t AND b.s = o.pos WHERE tg.kind = 'field' GROUP BY ch.doc_id, ch.t HAVING any_value(coalesce(a.ov, 0)) - max(coalesce(b.ov, 0)) < 2),
chosen AS (SELECT ch.doc_id, ch.t, ch.s, round(coalesce(ch.w, (SELECT max(w) FROM sp WHERE sp.doc_id = ch.doc_id AND sp.t = ch.t), 0) / 1000000, 6) AS ratio, CASE WHEN ch.s IS NOT NULL THEN 'context' END AS method, CASE WHEN ch.s IS NULL THEN 'no match' WHEN am.t IS NOT NULL THEN 'ambiguous' ELSE 'transplanted' END AS status FROM ch LEFT JOIN am ON am.doc_id = ch.doc_id AND am.t = ch.t)"""


def _chosen(windows: DataFrame) -> DataFrame:
    targets, sources = _sides(windows)
    return tp.transplant(targets, sources, staged(tp.scored_pairs(_sims(windows), tp.identity_bonus(targets, sources.where("not broken"))), "transplant-pairs"))


@P.add(f"{_CHOSEN} SELECT * FROM chosen")
def context_transplant(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(_windows(spark, sf, *_MADE_OF))


@P.add(f"{_CHOSEN} SELECT tk.doc_id, string_agg(coalesce(sr.text, tk.text), '' ORDER BY tk.pos) AS text, count(sr.text) AS n_replaced FROM tk LEFT JOIN chosen c ON c.doc_id = tk.doc_id AND c.t = tk.pos LEFT JOIN sr ON sr.pair = c.doc_id AND sr.pos = c.s WHERE tk.doc_id % 2 = 0 GROUP BY tk.doc_id")
def transplant_apply(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf, *_MADE_OF)
    return tp.transplant_apply(_tokens(windows).where("doc_id % 2 = 0"), _sides(windows)[1], _chosen(windows))


@P.add(f"{_CHOSEN} SELECT doc_id, count(*) AS citations, count(s) AS transplanted, count(*) FILTER (method = 'context') AS by_context, count(*) FILTER (method = 'position') AS by_position, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (s IS NULL) AS unmatched FROM chosen GROUP BY doc_id")
def transplant_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tp.transplant_summary(_chosen(_windows(spark, sf, *_MADE_OF)))


_FILL = f"""{BASE}, t AS (SELECT doc_id, pos AS t, CASE WHEN supp % 5 = 0 THEN 1 END AS anchor FROM citations), s AS (SELECT doc_id, pos AS s, CASE WHEN supp % 5 = 0 THEN 1 END AS anchor FROM citations WHERE supp % 5 = 0 OR supp % 3 > 0),
tg AS (SELECT *, coalesce(sum(anchor) OVER (PARTITION BY doc_id ORDER BY t), 0) AS gap FROM t), sg AS (SELECT *, coalesce(sum(anchor) OVER (PARTITION BY doc_id ORDER BY s), 0) AS gap FROM s),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY t) AS k FROM tg WHERE anchor IS NULL), sk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY s) AS k FROM sg WHERE anchor IS NULL)
SELECT doc_id, t, s FROM tk JOIN sk USING (doc_id, gap, k)"""


@P.add(_FILL)
def fill_by_order(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf)
    t, s = c.selectExpr("doc_id", "pos AS t"), c.where("supp % 5 = 0 OR supp % 3 > 0").selectExpr("doc_id", "pos AS s")
    return op.fill_by_order(t, s, c.where("supp % 5 = 0").selectExpr("doc_id", "pos AS t", "pos AS s"))


@P.add(f"WITH {CITATIONS}, {_TOKENS} SELECT t.doc_id, t.pos, t.kind FROM tk t WHERE t.is_cite AND t.broken AND EXISTS (SELECT 1 FROM sr WHERE sr.pair = t.pair AND lower(sr.surname) = lower(t.surname)) AND t.doc_id % 2 = 0")
def broken_to_source(spark: SparkSession, sf: str) -> DataFrame:
    targets, sources = _sides(citations(spark, sf))
    return tp.broken_with_source(targets, sources).select("doc_id", "pos", "kind")


@P.add(f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, side AS (SELECT doc_id % 2 AS s, doc_id * 100 + pos AS pos, author || cited_year AS surname, list_distinct(regexp_extract_all(lower(title), '[a-z]{{5,}}')) AS ws FROM citations),
p AS (SELECT m.surname, m.pos AS m, e.pos AS e, row_number() OVER (PARTITION BY m.surname ORDER BY m.pos, e.pos) AS k FROM side m JOIN side e ON m.surname = e.surname AND list_has_any(m.ws, e.ws) WHERE m.s = 0 AND e.s = 1),
f AS (SELECT surname, 0::BIGINT AS k, NULL::BIGINT AS m, NULL::BIGINT AS e, []::BIGINT[] AS ms, []::BIGINT[] AS es FROM (SELECT DISTINCT surname FROM p) UNION ALL
SELECT p.surname, p.k, CASE WHEN free THEN p.m END, CASE WHEN free THEN p.e END, CASE WHEN free THEN ms || [p.m] ELSE ms END, CASE WHEN free THEN es || [p.e] ELSE es END FROM (SELECT p.*, f.ms, f.es, NOT list_contains(f.ms, p.m) AND NOT list_contains(f.es, p.e) AS free FROM f JOIN p ON p.surname = f.surname AND p.k = f.k + 1) p)
SELECT surname, m AS missing_pos, e AS extra_pos FROM f WHERE m IS NOT NULL""")
def reconcile_bibliographies(spark: SparkSession, sf: str) -> DataFrame:
    c = citations(spark, sf).select((F.col("doc_id") * 100 + F.col("pos")).alias("pos"), F.concat("author", "cited_year").alias("surname"), "title", "doc_id")
    return op.reconcile(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"))


# A document's bibliography numbers its rows; citations of every seventh supplier say a number that it lacks. The intact version is the document without its rows of flag R, where years are decades.
_YEAR10 = "substr(rec_year, 1, 3) || '0'"
_RELINK = f"""{BASE}, loc AS (SELECT doc_id, CASE WHEN group_order % 3 = 0 THEN 'notes' ELSE 'body' END AS part, group_order, ref_pos AS k, CASE WHEN supp % 7 = 0 THEN 900 + pos ELSE pos END AS num FROM citations), bib AS (SELECT doc_id, pos AS num, author || '|' || {_YEAR10} AS ident, {_HINT} AS text FROM citations),
src AS (SELECT doc_id, group_order AS group_id, author || '|' || {_YEAR10} AS ident, c.rec_id, l.title, l.journal, l.volume, c.rec_id || '-' || (c.rec_id + 9) AS pages FROM citations c JOIN library l ON l.rec_id = c.rec_id WHERE flag <> 'R'), rec AS (SELECT DISTINCT doc_id, ident, rec_id, title, journal, volume, pages FROM src), several AS (SELECT doc_id, ident, count(*) AS n_records FROM rec GROUP BY ALL),
held AS (SELECT loc.*, bib.ident, bib.text FROM loc LEFT JOIN bib USING (doc_id, num)), cs AS (SELECT h.doc_id, h.num, list(struct_pack(s := -score, rec_id := rec_id) ORDER BY -score, rec_id) AS cs FROM (SELECT DISTINCT h.doc_id, h.num, r.rec_id, {_content('h.text', 'r', False)} AS score FROM held h JOIN rec r ON r.doc_id = h.doc_id AND r.ident = h.ident) h GROUP BY ALL),
sets AS (SELECT DISTINCT doc_id, string_agg(DISTINCT ident, ';' ORDER BY ident) AS idents FROM src GROUP BY doc_id, group_id), rg AS (SELECT h.doc_id, part, group_order, string_agg(h.num::VARCHAR, ',' ORDER BY k, h.num) AS numbers, bool_and(h.ident IS NOT NULL) AS known, bool_and(n_records IS NOT NULL) AS recorded, bool_or(coalesce(n_records, 0) > 1) AS several,
 coalesce(string_agg(h.num::VARCHAR, ',' ORDER BY k, h.num) FILTER (cs IS NOT NULL AND {_BEST} = 'ambiguous'), '') AS verify, string_agg(DISTINCT h.ident, ';' ORDER BY h.ident) AS idents FROM held h LEFT JOIN several s ON s.doc_id = h.doc_id AND s.ident = h.ident LEFT JOIN cs ON cs.doc_id = h.doc_id AND cs.num = h.num GROUP BY h.doc_id, part, group_order),
d AS (SELECT rg.doc_id, part, group_order, numbers, CASE WHEN known AND sets.idents IS NOT NULL AND NOT several THEN 'exact' WHEN known AND recorded THEN 'constructed' ELSE 'placeholder' END AS kind, verify FROM rg LEFT JOIN sets ON sets.doc_id = rg.doc_id AND sets.idents = rg.idents)"""


def _relinked(spark: SparkSession, sf: str) -> DataFrame:
    c = staged(citations(spark, sf).select("doc_id", "pos", "group_order", "ref_pos", "rec_id", "supp", "flag", "author", "rec_year", "title"), "citations")
    c = c.select("*", F.expr(_YEAR10).alias("decade"), F.col("author").alias("surname"), F.expr(_HINT).alias("text"))
    groups = c.select("doc_id", F.when(F.col("group_order") % 3 == 0, "notes").otherwise("body").alias("part"), "group_order", F.col("ref_pos").alias("k"), F.when(F.col("supp") % 7 == 0, 900 + F.col("pos")).otherwise(F.col("pos")).alias("num"))
    bibliography = c.select("doc_id", F.col("pos").alias("num"), "surname", F.col("decade").alias("year"), "text")
    source = c.where("flag <> 'R'").select("doc_id", F.col("group_order").alias("group_id"), "surname", F.col("decade").alias("year"), "rec_id")
    return op.relink(groups, bibliography, source, source, catalog=library(spark, sf).selectExpr("rec_id", "title", "journal", "volume", f"{_MORE['pages']} AS pages"))


@P.add(f"{_RELINK} SELECT doc_id, part, group_order, numbers, kind, CASE WHEN kind = 'constructed' THEN verify ELSE '' END AS verify FROM d")
def relink_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _relinked(spark, sf)


@P.add(f"{_RELINK} SELECT part, kind, count(*) AS n, grouping(part) AS all_parts, grouping(kind) AS all_kinds FROM d GROUP BY GROUPING SETS ((part, kind), (part), (kind), ())")
def relink_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _relinked(spark, sf).cube("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.grouping("part").cast("long").alias("all_parts"), F.grouping("kind").cast("long").alias("all_kinds"))


QUERIES, ORACLES = P.queries, P.oracles
