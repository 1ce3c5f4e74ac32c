"""The driver's queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import chat, decontaminate, fim, html, lm, mixing, neardup, quality, resample, sharding, substring, tokens, urls
from refweave.llm.common import scratch, table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), folder, tokens.Format(public_tokenizers.path("byte_bpe_50k.json"), end_id=0, width=2))
    return tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


#: The extra conversation: both of its texts hold what looks like control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    said = chat.read_back(chat.format_conversations(turns.union(extra)))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return said.select("conv_id", "n_turns", sha("turns_text").alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), "formatted_chars")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_source_mix, op4_near_duplicates, op5_decontamination, op6_lm_score, op7_html_text, op8_substring_dedup, op9_url_filter, op10_chat_format, op11_importance_resample, op12_sampled_shards, op13_fill_in_middle)
}

_W = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[])"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS ws FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM
  (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS n_upper,
  len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_lettered, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
  coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id IS NOT DISTINCT FROM rep.doc_id),
g AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (10 * n_upper > 3 * word_chars) AND NOT (100 * n_dup_lines > 35 * n_lines) AND NOT (10 * n_lettered < 7 * n_words) AS kept
FROM g"""

_MIX = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_W})::BIGINT AS size, md5(concat_ws(':', '0', doc_id::VARCHAR)) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS r FROM d GROUP BY source),
w AS (SELECT source, size, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, 3 * size / weight AS full_at, sum(size) OVER () AS total FROM w),
c AS (SELECT *, coalesce(sum(3 * size) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
  sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM o),
m AS (SELECT *, min(CASE WHEN (total - capped_before) * weight <= 3 * size * weight_from THEN full_at END) OVER () AS free_from FROM c),
l AS (SELECT sum(CASE WHEN full_at >= free_from THEN weight ELSE 0 END)::BIGINT AS weights, (max(total) - sum(CASE WHEN full_at >= free_from THEN 0 ELSE 3 * size END))::BIGINT AS left_over FROM m),
t AS (SELECT source, size AS source_size, CASE WHEN full_at >= free_from THEN (left_over * weight)::DOUBLE / weights ELSE (3 * size)::DOUBLE END AS target FROM m, l),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (passes + CASE WHEN target - passes * source_size > 0 AND 2 * start + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWERED}, {_ALNUM}), []::VARCHAR[]) AS ws FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWERED}, {_ALNUM}), []::VARCHAR[]) AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS x FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
place AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS x FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS (SELECT r, k, i, item_id FROM place JOIN win USING (k, x)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)"""

_REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
g AS (SELECT r, count(*) AS n, list(p) AS ps FROM gone GROUP BY r),
w AS (SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
k AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN gone ON w.r = gone.r AND w.p = gone.p WHERE gone.r IS NULL GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""


#: Rounds of propagation in the SQL, which can't stop by itself; the scores then differ from their limits by less than 0.001 of a seed.
_URL_ROUNDS = 44


def _url_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}|{r.verdict}'" for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    )
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    linked = urls.LINKED_HOST.replace("'", "''")
    rounds = "".join(
        f""",
r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, seed AS score FROM base UNION ALL SELECT e.kind, e.dst, x.score * e.w * {urls.DAMPING} FROM r{k} x JOIN edge e ON e.kind = x.kind AND e.src = x.host) GROUP BY 1, 2)"""
        for k in range(_URL_ROUNDS)
    )
    return rf"""
WITH p AS (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{urls.URL_PARTS}', 1), '')")} AS host, coalesce(regexp_extract(url, '{urls.URL_PARTS}', 2), '') AS path FROM pages),
j AS (SELECT *, split_part(hit, '|', 1) AS rule, split_part(hit, '|', 2) AS verdict FROM (SELECT *, CASE {fits} END AS hit FROM p)),
l AS (SELECT host AS src, {lower("dst")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{linked}', 1)) AS dst FROM p)),
n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY 1, 2),
share AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM n),
edge AS MATERIALIZED (SELECT 't' AS kind, src, dst, w FROM share UNION ALL SELECT 'd', dst, src, w FROM share),
base AS MATERIALIZED (SELECT kind, host, {1 - urls.DAMPING} * (CASE kind WHEN 't' THEN a ELSE b END) AS seed FROM (SELECT host, avg((verdict IS NOT NULL AND verdict = 'allow')::INT) AS a, avg((verdict IS NOT NULL AND verdict = 'block')::INT) AS b FROM j GROUP BY host), (VALUES ('t'), ('d')) k(kind)),
r0 AS (SELECT kind, host, seed AS score FROM base){rounds},
bad AS (SELECT host FROM r{_URL_ROUNDS} GROUP BY host HAVING coalesce(sum(CASE WHEN kind = 'd' THEN score END), 0) - coalesce(sum(CASE WHEN kind = 't' THEN score END), 0) > {1 - urls.DAMPING} * {urls.THRESHOLD})
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON j.host = bad.host"""


_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + (len(string_split(text, '\')) - 1) - (len(string_split(text, '###')) - 1) - 5 * (len(string_split(text, '</turn>')) - 1) + length(role) + 14 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_DRAW = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWERED}, {_ALNUM}), []::VARCHAR[]) AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(coalesce(regexp_extract_all({_LOWERED}, {_ALNUM}), []::VARCHAR[])) AS w FROM benchmark) GROUP BY w),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(strlen(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM vocabulary, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
every AS (SELECT b AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s ON b = s.bucket LEFT JOIN t ON b = t.bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM every),
weighed AS (SELECT r, sum(n * gain) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""

_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, coalesce(regexp_extract_all(t, '[^\n]*\n|[^\n]+'), []::VARCHAR[]) AS ls, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, len(ls)::BIGINT AS n, least(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS a, greatest(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(ls[:a], '') AS prefix, array_to_string(ls[a + 1:b], '') AS middle, array_to_string(ls[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {"op2_quality_rules": _QUALITY, "op3_source_mix": _MIX, "op5_decontamination": _LEAKS, "op8_substring_dedup": _REPEATS, "op9_url_filter": _url_sql(), "op10_chat_format": _CHAT, "op11_importance_resample": _DRAW, "op13_fill_in_middle": _INFILL}
