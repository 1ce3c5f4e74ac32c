"""Sharding (12): sampled splitters over a key order.

Records are ordered by a key, the hash of their text, so that equal texts are neighbours. Samples of the keys, drawn in proportion to the records' sizes, give quantiles: the splitters of many more ranges
than there are shards. Each range is then measured exactly, and one that is overfull (in bytes or in rows) is sampled again and subdivided: by further keys, or, if one text fills it,
by the hash of its records' ids, and at last by the records themselves. When none is overfull, neighbouring ranges make up the shards by their exact sizes, so a shard's size is off by less than a range.

So equal texts share a shard unless they are too many for one range, and a text that a third of all records repeat is spread over as many shards as it needs. The law is `bytes`: sizes near equal.

What the driver holds are samples, splitters and ranges: RANGES times the shards of them or one per RANGE_BYTES of records, whichever is more, and SAMPLES samples a range.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.llm.common import free_name, running_sum, scratch, written

SHARDS = 8
#: Ranges a shard, at least, and bytes of records in a range, at most about.
RANGES, RANGE_BYTES = 128, 1 << 30
#: Samples a range.
SAMPLES = 16
#: A range is overfull beyond so many times its share of bytes or rows.
OVERFULL = 2

LEAST = -(2**63)


class Splitters:
    """Where ranges begin, as sorted pairs (key, second key); range 0 begins before the first."""

    def __init__(self, pairs: set[tuple[int, int]]):
        self.pairs = sorted(pairs)
        self.major, self.minor = (np.array([p[i] for p in self.pairs], dtype=np.int64) for i in (0, 1))
        values, counts = np.unique(self.major, return_counts=True)
        # keys within which ranges begin
        self.inner = [int(v) for v, n in zip(values, counts) if n > 1 or self.minor[np.searchsorted(self.major, v)] > LEAST]

    def ranges(self, major: np.ndarray, minor: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.major, major, side="right")
        for v in self.inner:
            here = major == v
            if here.any():
                low, high = np.searchsorted(self.major, v, side="left"), np.searchsorted(self.major, v, side="right")
                found[here] = low + np.searchsorted(self.minor[low:high], minor[here], side="right")
        return found.astype(np.int64)


class Range(NamedTuple):
    id: int
    size: int
    n: int
    least: tuple[int, int]
    most: tuple[int, int]


def _placed(keyed: DataFrame, splitters: Splitters) -> DataFrame:
    """keyed with `range`."""

    @F.pandas_udf("long")
    def place(major: pd.Series, minor: pd.Series) -> pd.Series:
        return pd.Series(splitters.ranges(major.to_numpy(np.int64), minor.to_numpy(np.int64)))

    return keyed.withColumn("range", place("major", "minor"))


def _measured(placed: DataFrame) -> list[Range]:
    """The ranges that hold records."""
    key = F.struct("major", "minor")
    rows = placed.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).collect()  # a row per range
    return sorted(Range(r["range"], r["size"], r["n"], tuple(r["least"]), tuple(r["most"])) for r in rows)


def _sample(records: DataFrame, expected: Column, seed: int) -> list[tuple[int, int, int]]:
    """(major, minor, times) of records drawn `expected` times on average each; the part of it below one is decided by a hash of the key."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "major", "minor"), 11) / float(1 << 53)
    drawn = records.withColumn("times", F.floor(expected + uniform)).where("times > 0").select("major", "minor", "times")
    return sorted(tuple(r) for r in drawn.groupBy("major", "minor").agg(F.sum("times")).collect())  # SAMPLES a range, about


def quantiles(samples: list[tuple[int, int, int]], pieces: int, by_minor: bool = False) -> set[tuple[int, int]]:
    """Splitters that cut the samples into so many pieces of equal weight: at keys, or (`by_minor`) at second keys within one key. A key that weighs as much as a piece gets a range to itself."""
    keys = np.array([s[1] if by_minor else s[0] for s in samples], dtype=np.int64)
    weights = np.array([s[2] for s in samples], dtype=np.int64)
    if not len(keys) or pieces < 2:
        return set()
    upto = np.cumsum(weights)
    step = upto[-1] / pieces
    chosen = set(keys[np.minimum(np.searchsorted(upto, step * np.arange(1, pieces), side="right"), len(keys) - 1)].tolist())
    if not by_minor:
        values, first = np.unique(keys, return_index=True)
        heavy = values[np.add.reduceat(weights, first) >= step].tolist()
        chosen |= set(heavy) | {v + 1 for v in heavy if v < 2**63 - 1}
    return {(samples[0][0], k) for k in chosen} if by_minor else {(k, LEAST) for k in chosen}


def find_splitters(keyed: DataFrame, ranges: int, total: int, n: int, seed: int = 0) -> tuple[Splitters, list[Range]]:
    """Splitters for keyed (major, minor, size), and what their ranges hold; no range that can be divided by its keys is overfull."""
    most_size, most_n = OVERFULL * total / ranges, OVERFULL * n / ranges
    pairs = quantiles(_sample(keyed, F.col("size") * (ranges * SAMPLES / total), seed), ranges)
    for level in range(1, 1 << 30):
        splitters = Splitters(pairs)
        placed = _placed(keyed, splitters)
        found = _measured(placed)
        # a range of one record can't be divided, nor one of records whose keys are alike
        full = {r.id: r for r in found if r.least < r.most and (r.size > most_size or r.n > max(1, most_n))}
        if not full:
            return splitters, found
        pieces = {k: int(np.ceil(max(r.size / most_size, r.n / most_n))) + 1 for k, r in full.items()}
        spark = keyed.sparkSession
        # half of a sample goes by bytes and half by rows, for a range may be overfull in either
        rates = spark.createDataFrame([(k, SAMPLES * pieces[k] / 2 / r.size, SAMPLES * pieces[k] / 2 / r.n) for k, r in full.items()], "at long, by_size double, by_row double")
        again = placed.join(F.broadcast(rates), F.col("range") == F.col("at"))  # a row per overfull range
        samples = _sample(again, F.col("size") * F.col("by_size") + F.col("by_row"), seed + level)
        at = splitters.ranges(np.array([s[0] for s in samples], np.int64), np.array([s[1] for s in samples], np.int64))
        for k, r in full.items():
            own = [s for s, i in zip(samples, at) if i == k] if len(full) < 32 else samples[np.searchsorted(at, k) : np.searchsorted(at, k, side="right")]
            one = r.least[0] == r.most[0]
            new = {p for p in quantiles(own, pieces[k], by_minor=one) if r.least < p <= r.most}
            pairs |= new or {r.most if one else (r.most[0], LEAST)}  # its last key at least gets a range of its own
    raise AssertionError("unreachable")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", seed: int = 0, ranges: int = RANGES, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one more), text_crc32, range, shard, slot (the record's place in its shard, gapless from 0) and the columns named in `extra`, a row per document.

    Null texts have no bytes and count as equal to empty ones. Null ids are ids like others. Records with one id and one text are interchangeable: together their rows are the same in every run, and so is everything else.
    A record larger than a shard's share makes its shard larger. An empty table gives no rows; other columns are ignored.
    """
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), body).alias("major"), F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("minor"), *extra,
    )
    keyed = written(plain.withColumn("row", F.monotonically_increasing_id()), "shard-keys")
    total, n = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(0).cast("long").alias("range"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *extra)
    many = max(shards * ranges, -(-total // RANGE_BYTES))
    splitters, found = find_splitters(keyed, many, total, n, seed)

    # a range of one record repeated can't be divided by keys: its rows are counted through, and dealt out in parts of equal numbers
    parts, units, before = [], [], 0
    for r in found:
        pieces = max(1, int(np.ceil(max(r.size * many / total, r.n * many / n) / OVERFULL))) if r.n > 1 and r.least == r.most else 1
        parts.append((r.id, len(units), pieces, before, r.n))
        before += r.n * (pieces > 1)
        for i in range(pieces):
            rows = -(-r.n * (i + 1) // pieces) - -(-r.n * i // pieces)
            units.append((r.size * rows // r.n, rows))
    located = _placed(keyed, splitters).join(F.broadcast(spark.createDataFrame(parts, "at long, first long, pieces long, before long, n long")), F.col("range") == F.col("at"))  # a row per range
    dealt = located.where("pieces = 1").withColumn("range", F.col("first"))
    if before:
        counted = running_sum(located.where("pieces > 1"), [F.col("range"), F.col("row")], F.lit(1), "nth")
        dealt = dealt.unionByName(counted.withColumn("range", F.expr("first + ((nth - before) * pieces) div n")).drop("nth"))
    table, upto, slots = [], 0, [0] * shards
    for i, (size, rows) in enumerate(units):
        shard = min(shards - 1, (2 * upto + size) * shards // (2 * total))
        table.append((i, shard, slots[shard]))
        slots[shard] += rows
        upto += size
    plan = spark.createDataFrame(table, "unit long, shard int, base long")
    order = Window.partitionBy("range").orderBy("major", "doc_id", "row")
    placed = dealt.withColumn("nth", F.row_number().over(order)).join(F.broadcast(plan), F.col("range") == F.col("unit"))  # a row per range
    return placed.select("doc_id", "size", "text_crc32", "range", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), *extra)


def write_shards(docs: DataFrame, folder: str | None = None, **options) -> str:
    """Writes the documents, all columns, as Parquet below `folder` (a new one in the shared folder by default), a directory `shard=k` for each shard, whose files are ranges in the order of `slot`; returns the folder.

    Columns `shard` and `slot` are added, with underscores behind them if docs has such columns. A task writes whole ranges, so no task gets a shard.
    """
    folder = folder or scratch(docs.sparkSession, "shards")
    shard, slot, row = free_name("shard", docs.columns), free_name("slot", docs.columns), free_name("_row", docs.columns)
    assigned = assign_shards(docs.withColumn(row, F.struct(*docs.columns)), extra=(row,), **options)
    dealt = assigned.repartitionByRange(F.col("range")).sortWithinPartitions("range", "slot").select(f"{row}.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    dealt.write.partitionBy(shard).parquet(folder)
    return folder


def read_shard(spark: SparkSession, folder: str, shard: int, name: str = "shard") -> DataFrame:
    """A shard's documents as write_shards wrote them; sort by slot for their order."""
    return spark.read.parquet(folder).where(F.col(name) == shard)
