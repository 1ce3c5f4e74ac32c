"""MinHash near-dedup (4): Order MinHash and banded alignment.

Two texts are near when the edit distance of their words is at most (1 - similarity) times the longer one's words. Classes are the connected components of near texts.

A text's k-mers are its windows of k words, each labelled with its occurrence number. Each hash function of a sketch
picks the two k-mers with the least values; the pair in text order is the band's key, so that texts meet if they
share the k-mers in the same order. Three sketches find candidates: five-word k-mers for close pairs, three-word k-mers for pairs
towards the edit limit, of whose longer k-mers few are whole, and two-word k-mers for texts of at most 30 words. Where at most two edits are
allowed (up to 14 words), one edit may touch every k-mer; there the words that remain when up to so many are deleted are keys as well, which
miss no pair. Within a bucket all pairs of texts are candidates, and are verified by an alignment of their words in a band as wide as the allowed distance.

Nothing here holds a bucket: centres are minima, pre-aggregated before the shuffle, and links are rows. First each text is aligned
with its least centre only; then with all its buckets' centres that are not in its class yet. Then rounds go on in the buckets that hold
several classes: the centres leave, 256 times as many of the rest are the next ones and are compared with all that is left, until each bucket is used up or one class.
So a big group of near copies costs about one alignment per copy.

In the rounds texts meet that merely share a passage. A MinHash of the single words, 512 bytes a text, tells them apart from near ones without an alignment: two near texts share at least two thirds
of their occurrence-labelled words, so 341 of the 512 bytes on average; texts of one length that share fewer than 304, of different lengths even more, are not aligned (a near pair is lost so with a probability of 2 * 10^-4 at the very limit, and hardly at all below it).

In place of the buckets of more than 32 texts in the rounds, their texts meet on what any near pair must share, so that a passage that a large part of the corpus shares doesn't make all its texts meet: an edit touches two pairs of neighbouring words at
most, so near texts share all but so many of their labelled pairs, and of both texts' rarest pairs, one more than may be missing, one is common (`least_common`). Pairs that only one of these texts has are of no use as keys. No near pair is lost by it.
Texts that share a passage share all its pairs, so that most buckets lie within another one; only the outer ones are gone through (`outer_buckets`), or each pair would be found once for every key that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches, flat_lists, mix, spread, window_hashes, words, written

SIMILARITY = 0.8
#: The sketches: words of a k-mer, bands, and words at most of the texts that have it.
SKETCHES = ((5, 16, None), (3, 24, None), (2, 16, 30))
#: Edits up to which texts get keys of what remains when so many words are deleted.
DELETIONS = 2
#: Bytes of the MinHash of words.
WORD_BYTES = 512
#: Texts of a bucket up to which all are compared in the rounds; those of larger ones meet on their rarest word pairs.
BUCKET = 32
#: Runs of words, those that most texts share, whose counts every task gets.
HOT_RUNS = 10_000
#: Rows, and centres, of a bucket that are compared at once in the rounds.
BLOCK = 2048
#: Parts into which each class is dealt where its members are joined with it.
SALTS = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


def occurrence_labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence numbers in the text."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    again = g[1:] == g[:-1]
    if not again.any():
        return mix(grams, np.zeros(1, dtype=np.uint64))
    index = np.arange(len(g))
    first = np.maximum.accumulate(np.where(np.r_[True, ~again], index, 0))
    out = np.empty_like(grams)
    out[order] = mix(g, (index - first).astype(np.uint64))
    return out


def order_minhash(values: np.ndarray, offsets: np.ndarray, k: int, bands: int) -> np.ndarray:
    """rows x bands keys of the texts whose word hashes lie end to end. Texts of fewer than k words have one k-mer, of all their words."""
    out = np.zeros((len(offsets) - 1, bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        factors = spread(np.arange(1, bands + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        band = np.arange(bands, dtype=np.uint64) + np.uint64(1000 * k)
        grams = window_hashes(values, k)
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if high == low:
                continue
            own = grams[low : high - k + 1] if high - low >= k else window_hashes(values[low:high], high - low)
            x = occurrence_labelled(own)
            if len(x) == 1:
                out[i] = mix(np.repeat(x, bands), band)
                continue
            for some in np.array_split(np.arange(bands), max(1, bands * len(x) // 2_000_000)):
                h = factors[some, None] * x[None, :]
                one = h.argmin(axis=1)
                h[np.arange(len(some)), one] = np.iinfo(np.uint64).max
                two = h.argmin(axis=1)
                out[i, some] = mix(mix(x[np.minimum(one, two)], x[np.maximum(one, two)]), band[some])
    return out


def edit_limit(n: int, similarity: float) -> int:
    """The edits that are allowed when the longer text has n words."""
    return int((1 - similarity) * n + 1e-9)


def deletion_keys(h: np.ndarray, most: int) -> list[int]:
    """Hashes of what remains of a short text when up to `most` words are deleted."""
    out = []
    for d in range(min(most, len(h)) + 1):
        for gone in combinations(range(len(h)), d):
            rest = np.delete(h, gone) if d else h
            out.append(int(mix(window_hashes(rest, len(rest)), np.array([len(rest) + 1], dtype=np.uint64))[0]) if len(rest) else 0)
    return list(set(out))


def word_bytes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WORD_BYTES bytes per text: of the occurrence-labelled word that each hash function picks, a byte."""
    out = np.zeros((len(offsets) - 1, WORD_BYTES), dtype=np.uint8)
    with np.errstate(over="ignore"):
        factors = spread(np.arange(1, WORD_BYTES + 1, dtype=np.uint64) * _STEP + np.uint64(1)) | np.uint64(1)
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if high > low:
                x = occurrence_labelled(values[low:high].astype(np.uint64))
                for some in np.array_split(np.arange(WORD_BYTES), max(1, WORD_BYTES * len(x) // 2_000_000)):
                    out[i, some] = (spread((factors[some, None] * x[None, :]).min(axis=1)) & np.uint64(0xFF)).astype(np.uint8)
    return out


def least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many bytes near texts of n and m words share at least: three and a half standard deviations below what the least likeness of their words makes expected. Of the longer one's words all but the allowed edits stand in the shorter one."""
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    likeness = np.minimum(1.0, similarity * longer / (shorter + (1 - similarity) * longer))
    return WORD_BYTES * likeness - 3.5 * np.sqrt(WORD_BYTES * likeness * (1 - likeness))


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree, row by row, in two arrays of WORD_BYTES / 8 whole numbers a row."""
    x = a ^ b
    for shift in (4, 2, 1):
        x |= x >> np.uint64(shift)
    x &= np.uint64(0x0101010101010101)
    return WORD_BYTES - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def alike_pairs(left: DataFrame, deals: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The centres (h, id) of the buckets' rows (h, id, n, g, root, size), one for each of `deals` parts by hash; and the pairs (a, b) of a row with a centre of its bucket that is of another class and, by its bytes and length, may be near.

    The pairs are looked through in blocks of BLOCK rows and BLOCK centres at most, which are dealt out: a bucket's work is spread over as many tasks as it has blocks, and only what may be near becomes a row.
    A pair of texts with the same `largest` bucket, where the rows say it, is left to that bucket, which is gone through until it is used up or one class.
    """
    if "largest" not in left.columns:
        left = left.withColumn("largest", F.col("h"))
    text = F.struct("id", "n", "g", "root", "size", "largest")
    centres = written(left.groupBy("h", F.pmod(F.xxhash64("id", F.lit(deals)), F.lit(deals))).agg(F.min(text).alias("c")).select("h", "c.*"), "centres")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    row_blocks, centre_blocks = blocks(F.col("size")), blocks(F.least("size", F.lit(deals)))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["h", "part", "centre_part", "is_row", "id", "n", "root", "largest", "g"]
    dealt = centres.withColumns({"is_row": F.lit(0), "centre_part": place(centre_blocks), "part": every(row_blocks)}).select(columns)
    dealt = dealt.union(left.withColumns({"is_row": F.lit(1), "part": place(row_blocks), "centre_part": every(centre_blocks)}).select(columns))

    def compare(h: int, a: tuple, b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (ia, na, ra, la, ga), (ib, nb, rb, lb, gb) = a, b
        step, is_centre = max(1, 65_536 // len(ib)), np.isin(ia, ib)  # of two centres of a block the greater one finds the pair
        for k in range(0, len(ia), step):
            n, m = na[k : k + step, None], nb[None, :]
            may = (np.abs(n - m) <= (1 - similarity) * np.maximum(n, m) + 1e-9) & (ra[k : k + step, None] != rb[None, :])
            if (lb != h).any():
                may &= (la[k : k + step, None] != lb[None, :]) | (lb[None, :] == h)
            may &= ~is_centre[k : k + step, None] | (ia[k : k + step, None] > ib[None, :])
            x, y = np.nonzero(may)
            x += k
            keep = shared_bytes(ga[x], gb[y]) >= least_shared(na[x], nb[y], similarity)
            yield ia[x[keep]], ib[y[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            key = np.stack([column(c).astype(np.int64) for c in columns[:4]], axis=1)
            g = flat_lists(batch.column("g"))[0].view(np.uint64).reshape(batch.num_rows, WORD_BYTES // 8)
            texts = column("id"), column("n").astype(np.int64), column("root"), column("largest"), g
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, batch.num_rows].tolist() if batch.num_rows else [0]
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for low, high in zip(cuts, cuts[1:]):
                *block, is_row = key[low].tolist()
                if block != last:
                    last, held = block, []
                some = tuple(x[low:high] for x in texts)
                if not is_row:
                    held.append(some)
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                for one, other in compare(block[0], some, held[0]) if held else ():
                    a.append(np.maximum(one, other))
                    b.append(np.minimum(one, other))
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = pa.table({"a": a, "b": b}).group_by(["a", "b"]).aggregate([]).to_batches()
            yield from pairs

    met = dealt.repartition("h", "part", "centre_part").sortWithinPartitions("h", "part", "centre_part", "is_row").mapInArrow(run, "a long, b long")
    return centres.select("h", "id"), met.distinct()


def sketch_keys(values: np.ndarray, offsets: np.ndarray, similarity: float = SIMILARITY, sketches: tuple = SKETCHES, deletions: int = DELETIONS) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which each text is looked for, end to end, and where each text's begin (and the last end)."""
    sizes = np.diff(offsets)
    found: list[list[np.ndarray]] = [[] for _ in sizes]
    for k, bands, most in sketches:
        has = (sizes >= k) & (sizes <= (most or np.inf))
        rows = np.flatnonzero(has)
        if len(rows):
            some = values if has.all() else np.concatenate([values[offsets[i] : offsets[i + 1]] for i in rows])
            for i, keys in zip(rows.tolist(), order_minhash(some, np.r_[0, np.cumsum(sizes[rows])], k, bands)):
                found[i].append(keys)
    for i in np.flatnonzero(sizes > 0):
        limit = edit_limit(int(sizes[i]), similarity)
        if limit <= deletions:
            found[i].append(np.array(deletion_keys(values[offsets[i] : offsets[i + 1]].astype(np.uint64), limit), dtype=np.uint64))
    keys = [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in found]
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int64)


def run_length(similarity: float) -> int:
    """The words of a run by whose rarest ones texts are looked for: two where that leaves near texts of any length common ones, else one."""
    return 2 if similarity >= 0.75 else 1


def least_common(n: int, similarity: float) -> int:
    """How many of its n - k + 1 labelled runs of k words a text of n words shares at least with any near text that is as long or longer; less than that with none of the shorter ones. An edit touches k runs."""
    k = run_length(similarity)
    longest = n + int(1 / max(1 - similarity, 1e-3)) + 1  # from there on the same lengths come again with more words
    return min(m - k + 1 - k * edit_limit(m, similarity) for m in range(n, longest + 1))


def within_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two sequences if it is at most `limit`, else None.

    A column of the alignment table holds, as bits, the vertical differences of the rows at most `limit` from the diagonal, and the next
    column follows from it by a few operations on whole numbers of that many bits.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:same] != b[::-1][:same])
    tail = int(differ[0]) if len(differ) else same
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not m:
        return n if n <= limit else None
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if n - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:  # words that have no partner
        return None
    limit = min(limit, n)
    rows, columns, top = a.tolist(), b.tolist(), 2 * limit
    every, last = (1 << (top + 1)) - 1, 1 << top
    places: dict[int, tuple[int, int]] = {}  # of each word, the rows in the band that hold it, as bits that count from the band's lowest row at a column
    for r in range(limit):
        places[rows[r]] = (places.get(rows[r], (0, 0))[0] | 1 << (r + limit + 1), 0)
    up, down, distance, give_up = every >> limit << limit, 0, limit, 2 * limit + m - n
    for j, w in enumerate(columns, 1):
        r = j + limit - 1
        if r < n:
            bits, at = places.get(rows[r], (0, j))
            places[rows[r]] = (bits >> (j - at) | last, j)
        bits, at = places.get(w, (0, j))
        x = bits >> (j - at)
        zero = (((x & up) + up ^ up) | x | down) & every
        right, left = down | ~(zero | up) & every, zero & up
        if j <= n - limit:  # along the band's lower edge, down to the last row
            distance += not zero & last
            if distance > give_up:
                return None
        else:  # along the last row
            bit = n - j + limit
            distance += (right >> bit & 1) - (left >> bit & 1)
        up, down = left | ~(zero >> 1 | right) & every, zero >> 1 & right
    return distance if distance <= limit else None


def near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the edit distance is at most the limit."""
    limit = edit_limit(max(len(a), len(b)), similarity)
    if len(a) == len(b) and np.count_nonzero(a != b) <= limit:
        return True
    return within_distance(a, b, limit) is not None


def aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of text ids whose texts (id, w) are near."""
    left = texts.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("w").alias("wb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob) = flat_lists(batch.column("wa")), flat_lists(batch.column("wb"))
            keep = []
            for i in range(batch.num_rows):
                keep.append(near(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # by b first: a centre may have thousands of partners, and the rows that are aligned are dealt out by a, which has few
    return pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long")


def rare_lists(ids: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """id, hs: keys of the texts (id, w) that are asked for, of which any two near ones have one in common: of each its rarest labelled runs of words, as many as may be missing in a near text and one more."""
    k = run_length(similarity)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat_lists(batch.column("w"))
            out, missing = [], []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n = high - low
                able = n >= k and edit_limit(int(n / similarity + 1e-9) + 1, similarity) > 0  # else near texts are equal
                out.append(occurrence_labelled(window_hashes(values[low:high].astype(np.uint64), k)[: n - k + 1]) if able else np.zeros(0, dtype=np.uint64))
                missing.append(n - k + 1 - least_common(n, similarity) if able else -1)
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in out])], pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(missing, pa.int64()), lists], names=["id", "missing", "runs"])

    held = written(texts.join(ids.hint("merge"), "id", "left_semi").select("id", "w").mapInArrow(runs, "id long, missing long, runs array<long>"), "runs")
    shared = written(held.select(F.explode("runs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "shared")
    # the runs that most texts share are known to every task, and make no rows of a join
    hot = sorted((r["h"], r["texts"]) for r in shared.orderBy(F.desc("texts"), "h").limit(HOT_RUNS).collect())
    hot_runs, hot_texts = (np.array(x, dtype=np.int64) for x in (zip(*hot) if hot else ((), ())))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_lists(batch.column("runs"))
            at = np.minimum(np.searchsorted(hot_runs, flat), max(len(hot_runs) - 1, 0))
            is_hot = hot_runs[at] == flat if len(hot_runs) else np.zeros(len(flat), dtype=bool)
            ends = lambda some: pa.array(np.r_[0, np.cumsum(some)][offsets], pa.int32())
            known = pa.StructArray.from_arrays([pa.array(hot_texts[at[is_hot]]), pa.array(flat[is_hot])], names=["texts", "h"])
            lists = [pa.ListArray.from_arrays(ends(is_hot), known), pa.ListArray.from_arrays(ends(~is_hot), pa.array(flat[~is_hot]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("missing"), pa.array(np.diff(offsets)), *lists], names=["id", "missing", "n_runs", "hot", "cold"])

    parts = held.mapInArrow(parted, "id long, missing long, n_runs long, hot array<struct<texts: long, h: long>>, cold array<long>")
    rows = parts.select("id", F.explode("cold").alias("h"))
    cold = rows.join(shared.hint("merge"), "h").groupBy("id").agg(F.collect_list(F.struct("texts", "h")).alias("some"))
    common = parts.select("id", "missing", "n_runs", "hot").join(cold, "id", "left").withColumn("common", F.when(F.col("some").isNull(), F.sort_array("hot")).otherwise(F.sort_array(F.concat("some", "hot")))).where("size(common) > 0")
    # runs that no other text has are the rarest
    left = F.greatest(F.col("missing") + 1 - (F.col("n_runs") - F.size("common")), F.lit(0)).cast("int")
    return common.select("id", F.slice("common", F.lit(1), left)["h"].alias("hs"))


def rare_keys(ids: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """id, h: a row for each of the keys of `rare_lists`."""
    return rare_lists(ids, texts, similarity).select("id", F.explode("hs").alias("h"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b), by alternating large and small stars.

    Nodes with many neighbours are only ever minimised over, which is pre-aggregated, and joined by rows, which AQE splits.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = now.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (h, id, ...) of buckets with the root of their text's class, itself where it has none. All columns but h are the text's: a text and its keys meet its root as one row."""
    own = [c for c in rows.columns if c not in ("h", "id")]
    texts = rows.groupBy("id").agg(*(F.first(c).alias(c) for c in own), F.collect_list("h").alias("hs"))
    return texts.join(roots, F.col("id") == F.col("node"), "left").select(F.explode("hs").alias("h"), "id", *own, F.coalesce("root", "id").alias("root"))


def largest_buckets(rows: DataFrame) -> DataFrame:
    """id, largest, hs: of each text of the buckets (rows h, id, size) its largest bucket (the greatest h of equal ones), and all."""
    return rows.groupBy("id").agg(F.max(F.struct("size", "h"))["h"].alias("largest"), F.collect_list("h").alias("hs"))


def outer_buckets(rows: DataFrame) -> DataFrame:
    """h of those buckets (rows h, id, size) that do not lie within another one: where the largest bucket of each of its texts (the greatest h of equal ones) is one and the same other bucket, that one holds all its pairs."""
    spans = largest_buckets(rows).select("largest", F.explode("hs").alias("h")).groupBy("h").agg(F.min("largest").alias("low"), F.max("largest").alias("high"))
    return spans.where("low <> high or low = h").select("h")


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots (node, root) after further edges (a, b): only the roots that the edges touch are joined."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    over = written(components(ends), "roots").select(F.col("node").alias("root"), F.col("root").alias("_over"))
    known = roots.union(over.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti"))
    return known.join(over, "root", "left").select("node", F.coalesce("_over", "root").alias("root"))


def _text_key(text: str) -> Column:
    return F.md5(F.array_join(words(F.col(text)), " ").cast("binary"))


def _keyed_classes(docs: DataFrame, id_col: str, text: str, similarity: float, sketches: tuple) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, n, ...), those with words (doc_id, key), key, least id and copies per text with words (and its id), and the root of each text that is linked (node, root)."""
    bounded_batches(docs.sparkSession)
    ws, kind = words(F.col(text)), docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), ws.alias("ws")).select("doc_id", F.size("ws").alias("n"), F.md5(F.array_join("ws", " ").cast("binary")).alias("key"), F.transform("ws", lambda w: F.xxhash64(w)).alias("h"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ends = sketch_keys(*flat_lists(batch.column("h")), similarity, sketches)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("key"), lists], names=["doc_id", "n", "key", "s"])

    members = written(base.where("n > 0").mapInArrow(sketch, f"doc_id {kind}, n int, key string, s array<long>"), "sketches")
    distinct = written(members.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("s").alias("s"), F.count(F.lit(1)).alias("copies")).withColumn("id", F.xxhash64("key")), "texts")
    banded = distinct.select("id", "n", F.explode("s").alias("h"))
    centres = banded.groupBy("h").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("h", F.col("c.id").alias("b"), F.col("c.n").alias("nb"))
    close = (F.abs(F.col("n") - F.col("nb")) <= (1 - similarity) * F.greatest("n", "nb") + 1e-9) & (F.col("id") != F.col("b"))
    left = written(banded.join(centres, "h"), "buckets")
    pairs = written(left.where(close).select(F.col("id").alias("a"), "b").distinct(), "pairs")
    texts = docs.select(words(F.col(text)).alias("ws")).select(F.xxhash64(F.md5(F.array_join("ws", " ").cast("binary"))).alias("id"), F.transform("ws", lambda w: F.hash(w)).alias("w"))
    used = left.select("id").distinct().hint("merge")  # grows with the corpus: never broadcast
    texts = written(texts.join(used, "id", "left_semi").groupBy("id").agg(F.first("w").alias("w")), "words")
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = written(aligned(first, texts, similarity), "near")
    roots = written(components(links), "roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    more = written(aligned(rest, texts, similarity), "near")
    roots = written(components(links.union(more)), "roots")
    left, deals = left.where("id <> b").select("h", "id", "n"), 1
    several = lambda rows: rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("h", "size")
    classed = rooted(left, roots)
    left = written(classed.join(several(classed), "h").drop("root"), "buckets")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = pa.FixedSizeListArray.from_arrays(pa.array(word_bytes(*flat_lists(batch.column("w"))).view("<i8").ravel()), WORD_BYTES // 8).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), g], names=["id", "g"])

    wanted = left.select("id").distinct().hint("merge")
    known = written(texts.join(wanted, "id", "left_semi").select("id", "w").mapInArrow(compared, "id long, g array<long>"), "word-bytes")
    left = written(left.join(known, "id"), "buckets")
    crowded = left.where(f"size > {BUCKET}").select("id", "n", "g").dropDuplicates(["id"])
    rare = rare_lists(crowded.select("id"), texts, similarity)
    keyed = crowded.join(rare, "id").select(F.explode("hs").alias("h"), "id", "n", "g")  # a text and its keys meet as one row
    left = written(left.where(f"size <= {BUCKET}").select("h", "id", "n", "g").union(keyed), "buckets")
    classed = rooted(left.select("h", "id"), roots)
    sized = classed.join(several(classed), "h")
    left = left.join(outer_buckets(sized).hint("merge"), "h", "left_semi").join(largest_buckets(sized).select("id", "largest").hint("merge"), "id").select("h", "id", "n", "g", "largest")
    while True:  # sixteen centres of a bucket are compared with all of it; then, as many times 256, up to as many as there are texts
        deals *= 16 if deals == 1 else 256
        classed = rooted(left, roots)
        left = written(classed.join(several(classed), "h"), "buckets")
        if left.isEmpty():
            break
        centres, met = alike_pairs(left, deals, similarity)
        fresh = written(met.join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = written(aligned(fresh, texts, similarity), "near")
        if not more.isEmpty():
            roots = written(joined(roots, more), "roots")
        pairs = pairs.union(fresh)
        left = left.join(centres, ["h", "id"], "left_anti").select("h", "id", "n", "g", "largest")
    return base, members, distinct.select("key", "least", "copies", "id"), roots


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: tuple = SKETCHES) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links (0 for a document alone in its class, else the members of its class but itself) per document row.

    Texts with the same words are one text. Texts without words (null, empty, white space) are alone, each by its doc_id. Rows that repeat a doc_id are members of their texts' classes.
    A null doc_id has the class of its text, and null where all members are null; ids may be of any type that has an order; an empty table gives no rows; other columns are ignored.
    """
    base, members, distinct, roots = _keyed_classes(docs, id_col, text, similarity, sketches)
    linked = written(distinct.join(roots, F.col("id") == F.col("node")).select("key", "root", "least", "copies"), "linked")
    # a class may hold a third of all texts: its members meet it in SALTS parts
    classes = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("size")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    classed = linked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(classes, ["root", "salt"]).select("key", "class_id", "size")
    keyed = distinct.join(classed, "key", "left").select("key", F.when(F.col("size").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("size", "copies").alias("size"))
    out = members.select("doc_id", "key").join(keyed, "key").select("doc_id", "class_id", (F.col("size") - 1).alias("n_links"))
    return out.union(base.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns: of each class one row, of the least id (null ids last), then of the least text hash; rows that repeat both are kept once. Texts without words, null ones among them, stay; an empty table stays empty."""
    _, _, distinct, roots = _keyed_classes(docs, id_col, text, similarity, SKETCHES)
    rooted = distinct.join(roots, F.col("id") == F.col("node"), "left").select("key", F.coalesce("root", "id").alias("root"))
    named = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), _text_key(text).alias("key"))
    bare = F.size(words(F.col(text))) == 0
    rows = docs.select(F.struct(*docs.columns).alias("_row"), named.alias("_name"), bare.alias("_bare"))
    picked = rows.where("not _bare").select("_name", F.col("_name.key").alias("key")).join(rooted, "key").groupBy("root").agg(F.min("_name").alias("_name")).select("_name")
    one = rows.where("not _bare").join(picked, "_name", "left_semi").groupBy("_name").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.select("_row.*").union(rows.where("_bare").select("_row.*"))
