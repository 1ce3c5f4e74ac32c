"""Mixing sources to target weights (3): a multivariate-hypergeometric splitting tree.

Each source's target in words becomes whole passes over the source and a last part of it, in an order that a seeded hash
permutes; equal prefixes of the hash make blocks. A source's quota is the number of blocks that its passes and its last part
draw. The exact quotas of all sources are split in two at each node of a tree, drawn by the
multivariate hypergeometric distribution, until each output shard has its quotas; a shard then draws the next disjoint
blocks of each source's permuted blocks, and shuffles its documents locally. What a document gives is what its block's draws take of it.

Nothing is held per source on the driver: ranks, weights, targets and quotas are columns. The tree is grown on the driver for groups of sources, and in tasks within each group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.llm.common import free_name, running_sum, words, written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Documents of a block, at most about.
BLOCK_DOCS = 128
#: Blocks of all sources' passes, at most: the tree's draws are exact below 10^9. A larger corpus has larger blocks; sources must be fewer than a quarter of it.
MOST_BLOCKS = 900_000_000
#: Sources in a group of the tree's lower part.
GROUP_SOURCES = 4096


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, docs, rank, weight and target for totals (source, source_size, docs), a row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; none gets more than `most` times its size, and what is above goes to the others by weight,
    round by round: a round caps the sources whose share would be too much, and leaves the rest of the sum and of the weights to the others.
    """
    ranked = running_sum(totals, [F.col("source").isNull(), F.col("source")], F.lit(1), "rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    weighed = written(ranked.withColumn("weight", turn.cast("long")), "mix-sources")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    capped, seen = F.lit(False), None
    while True:
        left, share, n = weighed.agg(F.sum(F.when(capped, F.col("source_size") * (1 - most)).otherwise(F.col("source_size"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == seen:
            break
        seen = n
        # left is all sizes less `most` times those of the capped: what the others share
        capped = F.lit(left or 0).cast("decimal(38,0)") * exact("weight") > F.lit(most) * exact("source_size") * F.lit(share or 1)
    free = F.lit(float(left or 0)) * F.col("weight") / F.lit(float(share or 1))
    return weighed.withColumn("target", F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(free))


def splitting_tree(quotas: np.ndarray, takes: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """quotas: blocks of each source; takes: blocks of each shard, with the same sum (below 10^9). Returns shards x sources, whose columns add up to the quotas and rows to the takes."""
    if len(takes) == 1:
        return quotas[None, :]
    half = len(takes) // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(sum(takes[:half])), method="marginals")
    return np.vstack([splitting_tree(drawn, takes[:half], rng), splitting_tree(quotas - drawn, takes[half:], rng)])


def even_takes(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def shard_ends(quotas: DataFrame, shards: int, seed: int, group_sources: int = GROUP_SOURCES) -> DataFrame:
    """source and ends (of each shard in turn, how many of the source's permuted blocks it and those before it draw) for quotas (source, rank, quota)."""
    grouped = quotas.withColumn("part", F.floor(F.col("rank") / group_sources).cast("long"))
    sums = sorted((r["part"], int(r["quota"])) for r in grouped.groupBy("part").agg(F.sum("quota").alias("quota")).collect())  # a row per group of sources
    tree = splitting_tree(np.array([q for _, q in sums], dtype=np.int64), even_takes(sum(q for _, q in sums), shards), np.random.default_rng(seed)) if sums else np.zeros((shards, 0), dtype=np.int64)
    takes_of = {part: tree[:, i].tolist() for i, (part, _) in enumerate(sums)}

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        part = int(rows["part"].iloc[0])
        own = splitting_tree(rows["quota"].to_numpy(dtype=np.int64), takes_of[part], np.random.default_rng([seed, part]))
        return pd.DataFrame({"source": rows["source"], "ends": np.cumsum(own, axis=0).T.tolist()})

    return grouped.select("part", "source", "rank", "quota").groupBy("part").applyInPandas(within, "source string, ends array<long>")


def _before(rows: DataFrame, order: str, top: Column, value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over the source's rows before, by `order`, whose first characters `top` deal the rows of a source out."""
    at = rows.withColumn("_top", top)
    sums = at.groupBy("source", "_top").agg(F.sum(value).alias("_sum"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.select(F.col("source").alias("_s"), F.col("_top").alias("_t"), before("_sum", Window.partitionBy("source").orderBy("_top")).alias("_base"))
    inner = at.withColumn("_inner", before(value, Window.partitionBy("source", "_top").orderBy(order)))
    return inner.join(tops, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_top") == F.col("_t"))).withColumn(name, F.col("_inner") + F.col("_base")).select(*rows.columns, name)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES, shards: int = 8, seed: int = 0, block_docs: int = BLOCK_DOCS, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, draws (pass and shard of each time that it is taken), taken (words), place (its permuted order), and the columns named in `extra`.

    Null texts have size 0; null sources are a source; ties in the permuted order are broken by text hash and then have one result for rows alike; repeated rows are documents each;
    an empty table gives no rows; other columns are ignored. A hot source is cut into blocks before anything is summed in order, so no task gets a whole source.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), place.alias("place"), F.xxhash64(text).alias("tie"), *extra)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = source_targets(totals, weights, most)
    # a block has a sixteenth of block_docs at least, and is drawn `most` times and once more at most; each source has one block at least
    all_docs = plan.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    block_docs = max(block_docs, -(-16 * (most + 1) * all_docs // MOST_BLOCKS))
    digits = F.coalesce(*[F.when(F.col("docs") <= block_docs * 16**k, k) for k in range(12)], F.lit(12))  # hex digits that name a block
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("passes", passes).select("source", "source_size", "target", "rank", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), digits.alias("digits")), "mix-plan")
    at = sized.join(plan.withColumnRenamed("source", "s").drop("rank"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.expr("substring(place, 1, digits)"))

    # the blocks, where each begins in its source's permuted order, and how often each is drawn
    spec = ["passes", "rest", "digits"]
    blocks = at.groupBy("source", "block").agg(F.sum("size").alias("block_size"), *[F.first(c).alias(c) for c in spec])
    top = F.expr("substring(block, 1, cast(ceil(digits / 2) as int))")
    blocks = _before(written(blocks, "mix-blocks"), "block", top, "block_size", "block_start")
    blocks = written(blocks.withColumn("n", F.col("passes") + ((F.col("rest") > 0) & (F.col("block_start") <= F.col("rest"))).cast("long")), "mix-blocks")
    rank = plan.select(F.col("source").alias("s"), "rank")
    quotas = blocks.groupBy("source").agg(F.sum("n").alias("quota")).join(rank, F.col("source").eqNullSafe(F.col("s"))).select("source", "rank", "quota")
    ends = shard_ends(quotas, shards, seed)

    # each draw's place among its source's draws, and so its shard
    draws = blocks.where("n > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "pass", "block").cast("binary")))
    draws = _before(draws.withColumn("one", F.lit(1)), "draw", F.expr("substring(draw, 1, cast(ceil(digits / 2) as int))"), "one", "nth")
    sharded = draws.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
    drawn = sharded.groupBy("source", "block", "block_start").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # a row per pass, so at most `most`
    drawn = drawn.select(F.col("source").alias("s"), F.col("block").alias("b"), "block_start", "draws")

    at = at.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    start = F.coalesce(F.sum("size").over(Window.partitionBy("source", "block").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("block_start")
    at = at.withColumn("last", F.coalesce(2 * start + F.col("size") <= 2 * F.col("rest"), F.lit(False)))
    at = at.withColumn("draws", F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda d: (d["pass"] <= F.col("passes")) | F.col("last")))
    return at.select("doc_id", "source", "size", "source_size", "target", "draws", (F.col("size") * F.size("draws")).alias("taken"), "place", *extra)


def mixture(docs: DataFrame, shards: int = 8, seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: the documents' columns, each document as often as it is drawn, with `shard` and `shard_order` (sort a shard by it for its local shuffle).

    Where the documents have columns of these names, the new ones get an underscore behind them. Nulls, ties, repeated rows and empty tables are as in mix_sources; a document that is taken three times
    is drawn with three blocks, so in general by three shards.
    """
    shard = free_name("shard", docs.columns)
    order = free_name("shard_order", docs.columns)
    row = free_name("_row", docs.columns)
    packed = docs.withColumn(row, F.struct(*docs.columns))
    taken = mix_sources(packed, shards=shards, seed=seed, extra=(row,), **options).select(F.col(row).alias("_row"), "place", F.explode("draws").alias("_draw"))
    return taken.select("_row.*", F.col("_draw.shard").alias(shard), F.xxhash64(F.lit(seed), "_draw.pass", "place").alias(order))
