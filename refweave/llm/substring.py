"""Substring dedup (8): level-wise doubling.

Windows of words that occur twice or more are found level by level: a window repeated at one length is extended to twice
that length (the last step ends at the asked length: 9, 18, 35), and only what is repeated there goes on. The first level looks at a
few windows alone: in every window of the asked length, the short window with the least hash, its anchor. Two equal long windows have the
same anchor at the same place, so no repeat is missed, and most of the corpus ends there. A longer level takes the window that
begins with the shorter one, or ends with it where the asked window ends sooner. Beyond the asked length, which alone decides what is cut, longer_repeats goes
on doubling until no candidates survive, which gives the length of the longest repeats.

A level is one shuffle of window hashes. Each task first counts its own windows: a window repeated inside a task is decided
there, and the task sends it once, so a passage that a third of all documents share sends a row per task. Word sequences are compared by 64-bit hashes:
of N different windows some two agree by chance with a probability of about N^2 / 2^65, and then count as repeated if they also agree at the levels before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refweave.llm.common import WORD, bounded_batches, flat_lists, row_key, window_hashes, word_hashes, written

LENGTH, FIRST = 35, 9
_SENT = "h long, key long, pos int"


def anchor_places(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of each `span` consecutive hashes, the leftmost on ties; grams of one text."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # least of 2**j consecutive places, by doubling; then of span as two overlapping
    place, size = np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        a, b = place[:-step] if step else place, place[step:]
        place = np.where(grams[b] < grams[a], b, a)
        size += step
    return place[:n]


def _extended(anchors: np.ndarray, first: int, half: int, length: int) -> np.ndarray:
    """Where the window of `half` words stands that each window of `length` words has: it begins with the anchor, or ends with it where it would reach too far."""
    return np.where(anchors + half <= np.arange(len(anchors)) + length, anchors, anchors + first - half)


def _emit(*lists: list) -> tuple[np.ndarray, ...]:
    kinds = (np.uint64, np.int64, np.int32, np.int64, np.int64)
    return tuple(np.concatenate(x).astype(t, copy=False) if x else np.zeros(0, t) for x, t in zip(lists, kinds))


def _local(h: np.ndarray, key: np.ndarray, pos: np.ndarray, *carried: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each hash of this task's windows, with its place if it is alone here; and a row for each window that isn't, marked as decided. `carried` columns (c0, c1, ...) go with the places."""
    order = np.argsort(h, kind="stable")
    h, key, pos = h[order], key[order], pos[order]
    carried = [x[order] for x in carried]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True] if len(h) else new
    many = new & ~alone
    for sel, known, placed in ((alone, False, True), (many, True, False), (~alone, True, True)):
        rows = np.flatnonzero(sel)
        for i in range(0, len(rows), 100_000):
            r = rows[i : i + 100_000]
            # sent: to be counted by hash; decided rows carry no hash
            out = {
                "h": pa.array(h[r].view(np.int64) if not (known and placed) else np.zeros(len(r), np.int64), pa.int64(), mask=np.full(len(r), known and placed)),
                "key": pa.array(key[r], pa.int64(), mask=np.full(len(r), not placed)),
                "pos": pa.array(pos[r], pa.int32(), mask=np.full(len(r), not placed)),
            }
            out |= {f"c{k}": pa.array(x[r], pa.int64(), mask=np.full(len(r), not placed) | (x[r] == 0)) for k, x in enumerate(carried)}
            yield pa.RecordBatch.from_pydict(out)


def _repeated(sent: DataFrame) -> DataFrame:
    """The places (key, pos and what they carry) of the windows whose hash occurs elsewhere. A null key stands for two or more windows of one task, a null h for a window decided by its task."""
    w = Window.partitionBy("h")
    carried = [c for c in sent.columns if c != "h"]
    counted = sent.where("h is not null").withColumn("n", F.sum(F.when(F.col("key").isNull(), 2).otherwise(1)).over(w)).where("n > 1 and key is not null").select(*carried)
    return counted.union(sent.where("h is null").select(*carried))


def _by_text(places: DataFrame) -> DataFrame:
    return places.groupBy("key").agg(F.collect_set("pos").alias("places"))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """key and text. Texts are shuffled, not their hashes, which are twice as large."""
    return docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """key (of the row's id and text, see common.row_key) and places: where windows of `length` words start that occur elsewhere too, in the same text or another.

    Null texts and those of fewer words have none; rows that repeat an id and a text repeat each other's windows and have a row together; an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    first = min(first, length)
    half = min(2 * first, (length + first + 1) // 2)  # at most so long that a window of that many words holds every anchor without reaching out of its long window
    src = _texts(docs, id_col, text).select("key", word_hashes(F.col("text")).alias("w"))
    span = length - first + 1

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Row, begin, end, and the anchor of each window, of the texts that have one."""
        values, offsets = flat_lists(batch.column("w"))
        grams = window_hashes(values, first)
        for i, (b, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if e - b >= length:
                yield i, b, e, anchor_places(grams[b : e - first + 1], span)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per anchor, which carries the hashes of the longer windows that begin and end with it, if any are wanted."""
        hs, keys, at, begin, end = [], [], [], [], []
        for batch in batches:
            values, _ = flat_lists(batch.column("w"))
            grams, longer, own = window_hashes(values, first), window_hashes(values, half).view(np.int64), np.asarray(batch.column("key"))
            for i, b, _, a in rows_of(batch):
                p = np.unique(a)
                place = _extended(a, first, half, length)
                forward, back = np.isin(p, a[place == a]), np.isin(p, a[place != a])
                hs.append(grams[b + p])
                keys.append(np.full(len(p), own[i]))
                at.append(p.astype(np.int32))
                begin.append(np.where(forward, longer[np.where(forward, b + p, b)], 0))
                end.append(np.where(back, longer[np.where(back, b + p + first - half, b)], 0))
        yield from _local(*_emit(hs, keys, at, begin, end))

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The longer windows at the anchors that are repeated. Equal ones have one anchor hash, so most of them meet in one task here."""
        hs, keys, at = [], [], []
        for batch in batches:
            for c, shift in (("c0", 0), ("c1", first - half)):
                has = np.asarray(batch.column(c).is_valid())
                hs.append(np.asarray(batch.column(c).fill_null(0))[has].view(np.uint64))
                keys.append(np.asarray(batch.column("key"))[has])
                at.append((np.asarray(batch.column("pos"))[has] + shift).astype(np.int32))
        yield from _local(*_emit(hs, keys, at))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, keys, at = [], [], []
        for batch in batches:
            places, ends = flat_lists(batch.column("places"))
            longer, own = window_hashes(flat_lists(batch.column("w"))[0], length), np.asarray(batch.column("key"))
            for i, b, _, a in rows_of(batch):
                p = np.flatnonzero(np.isin(_extended(a, first, half, length), places[ends[i] : ends[i + 1]]))
                hs.append(longer[b + p])
                keys.append(np.full(len(p), own[i]))
                at.append(p.astype(np.int32))
        yield from _local(*_emit(hs, keys, at))

    level = _repeated(src.mapInArrow(anchors, f"{_SENT}, c0 long, c1 long"))
    level = written(_by_text(_repeated(level.mapInArrow(doubled, _SENT))), "substring-level")
    found = _texts(docs, id_col, text).join(level, "key").select("key", word_hashes(F.col("text")).alias("w"), "places").mapInArrow(windows, _SENT)
    return _by_text(_repeated(found))


def longer_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, levels: int = 24) -> DataFrame:
    """key and longest: per text with a repeat, the greatest of length, 2 * length, 4 * length, ... at which one of its windows is repeated. Doubles until no candidates survive. Null and short texts have none; rows that repeat an id and a text repeat each other; an empty table gives no rows."""
    now = written(repeated_windows(docs, id_col, text, length), "substring-level")
    out = now.select("key", F.lit(length).alias("longest"))
    for _ in range(levels):
        half = length

        def doubled(batches: Iterator[pa.RecordBatch], half: int = half) -> Iterator[pa.RecordBatch]:
            hs, keys, at = [], [], []
            for batch in batches:
                values, offsets = flat_lists(batch.column("w"))
                places, ends = flat_lists(batch.column("places"))
                longer, own = window_hashes(values, 2 * half), np.asarray(batch.column("key"))
                for i in range(batch.num_rows):
                    own_places = np.sort(places[ends[i] : ends[i + 1]])
                    p = own_places[np.isin(own_places + half, own_places)]
                    p = p[p + 2 * half <= offsets[i + 1] - offsets[i]]
                    hs.append(longer[offsets[i] + p])
                    keys.append(np.full(len(p), own[i]))
                    at.append(p.astype(np.int32))
            yield from _local(*_emit(hs, keys, at))

        now = written(_by_text(_repeated(_texts(docs, id_col, text).join(now, "key").select("key", word_hashes(F.col("text")).alias("w"), "places").mapInArrow(doubled, _SENT))), "substring-level")
        if now.isEmpty():
            break
        length *= 2
        out = out.union(now.select("key", F.lit(length).alias("longest")))
    return out.groupBy("key").agg(F.max("longest").alias("longest"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) per document.

    Every word that a repeated window covers goes, at all its occurrences. Null texts have no words; texts of fewer than `length` words keep all;
    rows that repeat an id and a text repeat each other's windows; an empty table gives no rows; other columns are ignored.
    """
    import re

    word = re.compile(WORD)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), row_key(F.col(id_col), F.col(text)).alias("key"))
    found = written(repeated_windows(docs, id_col, text, length), "substring-repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            n, gone, kept = [], [], []
            for t, p in zip(texts, places):
                ws = word.findall(t or "")
                if p:
                    edge = np.zeros(len(ws) + 1, dtype=np.int64)
                    p = np.array(p)
                    edge[p] += 1
                    edge[p + length] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone.append(int(covered.sum()))
                    kept.append(" ".join(w for w, c in zip(ws, covered.tolist()) if not c))
                else:
                    gone.append(0)
                    kept.append(" ".join(ws))
                n.append(len(ws))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return src.join(found, "key", "left").select("doc_id", "text", "places").mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
