"""Target-distribution importance resampling (11): hashed n-gram features read off an Aho-Corasick dictionary.

A block's distinct words, each with a delimiter on both sides, are the patterns of an automaton; a pattern's payload is the CRC-32 and the length of the word's bytes, worked out once.
One scan of the block's texts emits the payloads in text order, one a word, for neighbours share their delimiter and no word holds one. An n-gram's CRC is composed of
adjacent payloads: CRCs are linear, so that of `a b` follows from those of its parts and the length of b. The CRC modulo the number of buckets is the feature's bucket.

Each text's buckets are written once, two bytes a feature. Counting adds them up within a task before anything is shuffled, and scoring sums the buckets' gains;
the table of gains has a row per bucket, whatever the size of the corpus. The draw adds Gumbel noise and takes the highest scores, ranked range by range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches, free_name, running_sum, written

#: Bytes of texts in a block, about: the scope of one automaton. A single longer text is a block of its own.
BLOCK_BYTES = 8_000_000
#: What a byte counts as: A-Z as a-z, ASCII letters and digits and all bytes beyond ASCII as themselves, everything else as the delimiter.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SPACE_CRC = 0xE96CCF45  # the CRC-32 of one space


def block_payloads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 and byte length of each word of the texts, in order, and how many words there are up to the end of each text."""
    joined = b" ".join([b"", *texts, b""]).translate(FOLD)
    distinct = list(dict.fromkeys(joined.split()))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    if not distinct:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(distinct):  # bytes as Latin-1: one character each
        automaton.add_word(f" {w.decode('latin-1')} ", i)
    automaton.make_automaton()
    found = np.fromiter(chain.from_iterable(automaton.iter(joined.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
    crcs, lengths = np.fromiter(map(_crc, distinct), np.uint32, len(distinct)), np.fromiter(map(len, distinct), np.int64, len(distinct))
    return crcs[found[:, 1]], lengths[found[:, 1]], np.searchsorted(found[:, 0], ends, side="right")


def _crc(word: bytes) -> int:
    from zlib import crc32

    return crc32(word)


def _through(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by what it makes of each bit."""
    out = np.zeros_like(crc)
    for i in range(32):
        out ^= ((crc >> np.uint32(i)) & np.uint32(1)) * columns[i]
    return out


@lru_cache(maxsize=4096)
def _zeros(length: int) -> np.ndarray:
    """What so many zero bytes behind it make of each bit of a CRC, by squaring."""
    if length == 1:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            bits = (bits >> np.uint32(1)) ^ ((bits & np.uint32(1)) * np.uint32(0xEDB88320))
        return bits
    half = _zeros(length // 2)
    both = _through(half, half)
    return _through(_zeros(1), both) if length % 2 else both


def followed_by(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray) -> np.ndarray:
    """The CRC-32 of byte strings of which those of both parts, and the second one's length, are known."""
    out = np.empty_like(crc)
    for n in np.unique(next_length):
        here = next_length == n
        out[here] = _through(_zeros(int(n)), crc[here]) if n else crc[here]
    return out ^ next_crc


def block_buckets(texts: list[bytes], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all runs of `shortest` to `longest` words of each text, text by text; how many there are up to the end of each text; and how many words."""
    crc, length, upto = block_payloads(texts)
    counts = np.diff(upto, prepend=0)
    text_of = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(upto, counts) - np.arange(len(crc))  # words from this one to the text's end
    grams, owners, acc = [], [], crc
    for n in range(1, longest + 1):
        if n > 1:
            acc, starts = acc[: len(crc) - n + 1], len(crc) - n + 1
            if starts <= 0:
                break
            one = np.ones(starts, np.int64)
            acc = followed_by(followed_by(acc, np.full(starts, _SPACE_CRC, np.uint32), one), crc[n - 1 :], length[n - 1 :])
        if n >= shortest:
            whole = left[: len(acc)] >= n
            grams.append(acc[whole] % np.uint32(buckets))
            owners.append(text_of[: len(acc)][whole])
    gram, owner = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, np.uint32), (owners, np.int64)))
    if len(grams) > 1:
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    return gram, np.searchsorted(owner, np.arange(len(texts)), side="right"), counts


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def text_buckets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and buckets (of each feature, as little-endian unsigned integers of two bytes, or of four beyond 65,536 buckets).

    Null and empty texts have no words; texts are read whole; repeated rows are rows each; other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kind, width = docs.schema[id_col].dataType.simpleString(), _width(buckets)

    def emit(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        found, upto, words = block_buckets(texts, shortest, longest, buckets)
        offsets = np.concatenate([[0], upto]) * width.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found.astype(width))])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(words), pa.array(np.diff(upto, prepend=0)), packed], names=["doc_id", "n_words", "n_features", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            texts += [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            held += b.column(1).nbytes
            if held >= BLOCK_BYTES:
                yield emit(ids, texts)
                ids, texts, held = [], [], 0
        if texts:
            yield emit(ids, texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """bucket and n, its features in all rows of text_buckets. A task adds up its own before the shuffle, so at most `buckets` rows leave it, however hot a bucket is."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            counts += np.bincount(_packed(b.column(0), width)[0], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _packed(column: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of packed rows end to end, and where each row's begin (and the last end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(width) if data is not None else np.zeros(0, width)
    return values, (offsets - offsets[0]) // width.itemsize


def bucket_gains(docs_counts: DataFrame, target_counts: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain: a thousand times the logarithm of how much likelier the bucket is in the target than in the documents, both with one feature added to every bucket, rounded down. Buckets without features have a row too."""
    s, t = docs_counts.select("bucket", F.col("n").alias("s")), target_counts.select("bucket", F.col("n").alias("t"))
    every = docs_counts.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    totals = every.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    real = lambda c: F.col(c).cast("double")
    odds = (real("t") + 1) * (F.col("all_s") + float(buckets)) / ((real("s") + 1) * (F.col("all_t") + float(buckets)))
    return every.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", target_id: str | None = None, shortest: int = 1, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of its features) and score (weight and noise that seed and id decide), a row per document; written once.

    Null and empty texts have no features and weight 0; a null id counts as the empty text in the noise; an empty target has no features, so all gains follow from the documents alone.
    """
    width = _width(buckets)
    options = {"shortest": shortest, "longest": longest, "buckets": buckets}
    mine = written(text_buckets(docs, id_col, text, **options), "buckets")
    theirs = text_buckets(target, target_id or target.columns[0], target_text, **options)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(bucket_counts(mine, buckets), bucket_counts(theirs, buckets), buckets).collect():  # a row per bucket
        gains[r["bucket"]] = r["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = _packed(b.column(3), width)
            upto = np.concatenate([[0], np.cumsum(gains[values])])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(upto[offsets]), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = mine.schema["doc_id"].dataType.simpleString()
    weighed = mine.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return written(weighed.withColumn("score", F.col("weight") + noise), "scores")


def importance_resample(docs: DataFrame, target: DataFrame, min_words: int = 20, percent: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank, a row per document.

    Of the documents with at least `min_words` words, the given percentage (rounded down) with the highest scores is drawn, and ranked from 1; ties go to the smaller id, null ids last, and repeated rows
    take consecutive ranks. Undrawn documents have no rank. Nulls, empties and options are those of importance_scores. Ranks are worked out range by range of the scores, so no task gets all documents.
    """
    scored = importance_scores(docs, target, **options)
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    ranked = running_sum(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], F.lit(1), "before")
    nth = F.when(F.col("before") < drawn, F.col("before") + 1).cast("long")
    return ranked.withColumn("rank", nth).drop("before").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns, and `draw_rank` (with underscores behind it if docs has such a column). Ids should be unique: rows that share one come along together, and null ids never do."""
    rank = free_name("draw_rank", docs.columns)
    drawn = importance_resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias(rank))
    key = free_name("_drawn", docs.columns)
    return docs.join(drawn.withColumnRenamed("doc_id", key), F.col(id_col) == F.col(key)).drop(key)
