"""Citations carried over from an intact version of a document: by the words around them, by who is cited, and by order.

Tokens of a document: doc_id, pos, kind (text, field, bare or refmarker), text, and for fields instr and the identity of the embedded record (surname, year, title). Pairs of
documents share a doc_id; what is matched within a pair is a small table of its own, folded by one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as tx

THRESHOLD, FLOOR = 0.4, 0.12
_MICRO = 1_000_000


def marked_broken(tokens: DataFrame) -> DataFrame:
    """Citations (kind other than text) with `broken`: those that are no field, fields that say INVALID CITATION, and fields without a record number or with 0."""
    instr = F.coalesce("instr", F.lit(""))
    recnum = F.regexp_extract(instr, r"<RecNum>(\d+)</RecNum>", 1)
    broken = (F.col("kind") != "field") | F.contains(instr, F.lit("INVALID CITATION")) | recnum.isin("", "0")
    return tokens.where("kind <> 'text'").withColumns({"broken": broken, "recnum": recnum})


def broken_with_source(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """The broken targets whose cited surname an intact source of the other version cites too."""
    known = sources.where("kind = 'field' and not broken").select("doc_id", F.lower("surname").alias("_surname")).distinct()
    return targets.where("broken").withColumn("_surname", F.lower("surname")).join(known, ["doc_id", "_surname"], "left_semi").drop("_surname")


def identity_bonus(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, t, s, bonus, overlap of pairs of fields that cite one surname: 0.03, or, in one year, 0.10 and 0.05 for each shared title word up to six."""
    side = lambda df, c: df.where("kind = 'field' and surname <> ''").select("doc_id", F.col("pos").alias(c), F.lower("surname").alias("surname"), F.col("year").alias(f"{c}_year"), F.col("title").alias(f"{c}_title"))
    j = side(targets, "t").join(side(sources, "s"), ["doc_id", "surname"])
    same = F.coalesce((F.col("t_year") != "") & (F.col("t_year") == F.col("s_year")), F.lit(False))
    overlap = F.when(same, F.size(F.array_intersect(tx.terms(F.coalesce("t_title", F.lit(""))), tx.terms(F.coalesce("s_title", F.lit("")))))).otherwise(0)
    rows = j.select("doc_id", "t", "s", same.alias("same"), overlap.alias("overlap"))
    return rows.select("doc_id", "t", "s", F.when(F.col("same"), 0.1 + 0.05 * F.least("overlap", F.lit(6))).otherwise(0.03).alias("bonus"), F.col("overlap").cast("long").alias("overlap"))


def scored_pairs(sims: DataFrame, bonus: DataFrame) -> DataFrame:
    """doc_id, t, s, sim (with the bonus), overlap: pairs that share a word or a surname."""
    both = sims.select("doc_id", "t", "s", "sim", F.lit(0).cast("long").alias("overlap")).union(bonus.select("doc_id", "t", "s", "bonus", "overlap"))
    return both.groupBy("doc_id", "t", "s").agg(F.round(F.sum("sim"), 6).alias("sim"), F.max("overlap").alias("overlap"))


def aligned(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The order-preserving chain of pairs (t, s, weight) with the greatest sum; of several, the one whose first pair is the last possible, and so on.

    A pair's best sum from there on is read from a Fenwick tree of maxima over later sources, filled from the last target on.
    """
    rows = sorted(pairs)
    places = sorted({s for _, s, _ in rows}, reverse=True)
    rank = {s: i + 1 for i, s in enumerate(places)}
    tree = [0] * (len(places) + 1)
    onward: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # pairs by their best sum, in descending order
    last = len(rows)
    while last:
        first = last
        while first and rows[first - 1][0] == rows[last - 1][0]:
            first -= 1
        totals = []
        for t, s, w in reversed(rows[first:last]):
            i, top = rank[s] - 1, 0
            while i > 0:
                top = max(top, tree[i])
                i -= i & -i
            totals.append((s, w + top))
            onward[w + top].append((t, s, w))
        for s, total in totals:
            i = rank[s]
            while i <= len(places):
                tree[i] = max(tree[i], total)
                i += i & -i
        last = first
    out, left, t, s = [], max(onward, default=0), None, None
    while left:
        x = next(p for p in onward[left] if t is None or (p[0] > t and p[1] > s))
        out.append(x)
        t, s, left = x[0], x[1], left - x[2]
    return out


def chosen_sources(pairs: list[tuple[int, int, int]], targets: list[tuple[int, bool]], sources: list[int], threshold: int, floor: int, by_order: bool) -> list[tuple[int, int | None, int, str | None]]:
    """(t, s or None, weight, method) of each eligible target of one document. targets: (t, eligible)."""
    sim = {(t, s): w for t, s, w in pairs}
    matched = {t: s for t, s, _ in aligned([x for x in pairs if x[2] >= floor])}
    eligible = [t for t, wanted in sorted(targets) if wanted]
    best: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, s, w in sorted(pairs, key=lambda x: (x[0], -x[2], x[1])):
        best[t].append((s, w))
    used = set(matched.values())
    for t in eligible:  # out of order: the best source that is free
        if t not in matched or sim[t, matched[t]] < threshold:
            free = next(((s, w) for s, w in best[t] if s not in used), None)
            if free is not None and free[1] >= threshold:
                matched[t] = free[0]
                used.add(free[0])
    taken = {t: (s, "context") for t, s in matched.items() if sim[t, s] >= threshold}
    if by_order:
        used, order, known = {s for s, _ in taken.values()}, sorted(sources), sorted(taken)
        bounds = [(None, None), *((t, taken[t][0]) for t in known), (None, None)]
        for (t_low, s_low), (t_high, s_high) in zip(bounds, bounds[1:]):
            gap = [t for t in eligible if t not in taken and (t_low is None or t > t_low) and (t_high is None or t < t_high)]
            free = [s for s in order[0 if s_low is None else bisect_left(order, s_low + 1) :] if s not in used and (s_high is None or s < s_high)]
            for t, s in zip(gap, free):
                taken[t] = (s, "position")
                used.add(s)
    return [(t, taken[t][0], sim.get((t, taken[t][0]), 0), taken[t][1]) if t in taken else (t, None, max((w for _, w in best[t]), default=0), None) for t in eligible]


def transplant(targets: DataFrame, sources: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR, replace_all: bool = False, by_order: bool = False) -> DataFrame:
    """doc_id, t, s, ratio, method (context or position), status (transplanted, ambiguous or no match) of each target to be replaced: the broken ones, with replace_all all fields as well.

    targets and sources: marked_broken rows of the two versions (sources that are broken or no fields aren't used). A chosen source is ambiguous if others of its surname and year
    share as many of the target's title words but one.
    """
    import pandas as pd

    good = sources.where("kind = 'field' and not broken")
    wanted = F.col("broken") | (F.lit(replace_all) & (F.col("kind") == "field"))
    own = scored.join(good.select("doc_id", F.col("pos").alias("s")), ["doc_id", "s"], "left_semi")
    listed = lambda df, *c: df.groupBy("doc_id").agg(F.collect_list(F.struct(*c)).alias("x"))
    t = listed(targets.withColumn("wanted", wanted), F.col("pos").cast("long").alias("t"), "wanted").withColumnRenamed("x", "targets")
    s = listed(good, F.col("pos").cast("long").alias("s")).withColumnRenamed("x", "sources")
    p = listed(own, F.col("t").cast("long").alias("t"), F.col("s").cast("long").alias("s"), F.round(F.col("sim") * _MICRO).cast("long").alias("w")).withColumnRenamed("x", "pairs")
    held = t.join(s, "doc_id", "left").join(p, "doc_id", "left").select("doc_id", "targets", "sources", "pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_of = lambda x: [] if x is None else x
        for b in batches:
            out = []
            for d, ts, ss, ps in zip(b["doc_id"], b["targets"], b["sources"], b["pairs"]):
                chosen = chosen_sources([(x["t"], x["s"], x["w"]) for x in rows_of(ps)], [(x["t"], x["wanted"]) for x in ts], [x["s"] for x in rows_of(ss)], round(threshold * _MICRO), round(floor * _MICRO), by_order)
                out += [(d, *x) for x in chosen]
            made = pd.DataFrame(out, columns=["doc_id", "t", "s", "w", "method"])
            made["s"] = made["s"].astype("Int64")
            yield made

    kind = targets.schema["doc_id"].dataType.simpleString()
    found = held.mapInPandas(run, f"doc_id {kind}, t long, s long, w long, method string")
    # siblings of the chosen source, and the most title words that one of them shares with the target
    known = good.select("doc_id", F.col("pos").cast("long").alias("s"), F.lower("surname").alias("surname"), "year").where("surname <> ''")
    overlap = lambda s, c: own.select("doc_id", F.col("t").cast("long").alias("t"), F.col("s").cast("long").alias(s), F.col("overlap").alias(c))
    named = found.where("s is not null").join(targets.where("kind = 'field' and surname is not null").select("doc_id", F.col("pos").cast("long").alias("t")), ["doc_id", "t"]).join(known, ["doc_id", "s"])
    siblings = named.join(known.withColumnRenamed("s", "other"), ["doc_id", "surname", "year"]).where("other <> s").join(overlap("other", "second"), ["doc_id", "t", "other"], "left")
    margin = siblings.groupBy("doc_id", "t", "s").agg(F.max(F.coalesce("second", F.lit(0))).alias("second")).join(overlap("s", "first"), ["doc_id", "t", "s"], "left")
    unclear = margin.where("coalesce(first, 0) - second < 2").select("doc_id", "t", F.lit(True).alias("unclear"))
    status = F.when(F.col("s").isNull(), "no match").when(F.col("unclear"), "ambiguous").otherwise("transplanted")
    return found.join(unclear, ["doc_id", "t"], "left").select("doc_id", "t", "s", F.round(F.col("w") / _MICRO, 6).alias("ratio"), "method", status.alias("status"))


def transplant_apply(tokens: DataFrame, sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text (the document's tokens in order, those with a chosen source replaced by the source's text) and n_replaced."""
    new = chosen.where("s is not null").select("doc_id", F.col("t").alias("pos"), "s").join(sources.select("doc_id", F.col("pos").alias("s"), F.col("text").alias("new")), ["doc_id", "s"]).drop("s")
    at = tokens.join(new, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("new", "text").alias("text"), F.col("new").isNotNull().alias("hit"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return at.groupBy("doc_id").agg(F.array_join(parts["text"], "").alias("text"), F.count_if("hit").alias("n_replaced"))


def transplant_summary(chosen: DataFrame) -> DataFrame:
    """Per document: citations to be replaced, those transplanted (by context, by position), the ambiguous among them, and those unmatched."""
    done = F.col("status") != "no match"
    return chosen.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(done).alias("transplanted"), F.count_if(done & (F.col("method") == "context")).alias("by_context"), F.count_if(done & (F.col("method") == "position")).alias("by_position"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(~done).alias("unmatched"),
    )
