"""URL filters (9): rules for hosts and paths, and link-graph propagation for what no rule decides. DataFrame functions only.

Hosts are the nodes of a graph whose edges are the absolute links of their pages. Trust starts from the share of a host's pages
that a rule allows and follows links, divided among those a host links to (personalised PageRank). Distrust starts from the share that a rule blocks and goes
backwards, to those who link there: a host gets the mean of the distrust of what it links to, so that a farm of many hosts around a blocked one doesn't share its distrust out.
Rounds go on until scores change no more. A host is blocked when its distrust exceeds its trust by what a host earns
whose pages are half blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import ascii_lower, written

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINKED_HOST = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds stop when no score has changed by so much in the last STEPS rounds.
TOLERANCE, STEPS = 1e-5, 4
#: Parts into which each host's pages are dealt where verdicts join them.
SALTS = 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; else null. The rules become one CASE, so they should be at most some hundreds."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        hit = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust.

    judged: a row per page with host and rule verdict (or null). edges: src, dst, n. Scores are (1 - damping) times a
    host's own share of pages plus damping times what comes along its edges, by their weight; hosts without links pass nothing on, and hosts that have only links to them and no page have scores too.
    The empty host, of null and odd urls, is a host like others; repeated pages count as often; without pages and edges there are no rows.
    """
    share = lambda v: F.avg(F.coalesce((F.col("verdict") == v).cast("double"), F.lit(0.0)))
    kinds = lambda t, d, name: F.explode(F.array(F.struct(F.lit("t").alias("kind"), t.alias(name)), F.struct(F.lit("d").alias("kind"), d.alias(name)))).alias("s")
    seeds = judged.groupBy("host").agg(share("allow").alias("a"), share("block").alias("b")).select("host", kinds(F.col("a"), F.col("b"), "seed")).select("s.kind", "host", (F.col("s.seed") * (1 - damping)).alias("seed"))
    shares = edges.join(edges.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))
    both = written(shares.select(F.lit("t").alias("kind"), "src", "dst", "w").union(shares.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "url-edges")
    base = written(seeds, "url-seeds").select("kind", "host", F.col("seed").alias("score"))
    known = base
    while True:
        score = known
        for _ in range(STEPS):
            passed = score.withColumnRenamed("host", "src").join(both, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
            score = base.union(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = written(score, "url-scores")
        # scores only grow, from none for a host that had none
        change = score.join(known.withColumnRenamed("score", "was"), ["kind", "host"], "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0]
        known = score
        if change is None or change < tolerance:
            break
    return known.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("score"))), F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict per page.

    A url that is null or holds no ``://`` has an empty host and path, fits no rule and is judged as the host "" is. Null html has no links. Repeated rows each get a row and count as pages
    of their host; an empty table gives no rows; other columns are ignored. A host that holds a third of all pages is one row of
    the graph, for pages and links are summed before they are shuffled; the verdicts join back by host and a salt.
    """
    parts = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("_h"))
    judged = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("verdict"), "_h")
    links = judged.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("_h", F.lit(LINKED_HOST), F.lit(1))).alias("dst"))
    edges = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    scores = host_scores(judged.select("host", "verdict"), edges, damping, tolerance)
    blocked = scores.where(F.col("distrust") - F.col("trust") > (1 - damping) * threshold).select(F.col("host").alias("_bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_salt"))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))
    out = judged.drop("_h").join(blocked, (F.col("host") == F.col("_bad")) & (salt == F.col("_salt")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
