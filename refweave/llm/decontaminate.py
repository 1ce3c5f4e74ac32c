"""Benchmark decontamination (5): a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton, which tracks the length of the longest match that ends at each word. A
match of `window` words or more is an occurrence of a window of an item; items of fewer words are one window each. Words are
compared by 64-bit hashes that the JVM computes: of N different words some two agree by chance with a probability of about N^2 / 2^65.

Items are dealt into blocks of bounded size, one automaton each. One block at a time comes to the driver and is broadcast, for a pass over the documents;
further blocks have passes of their own, whose hits are joined by document. So memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refweave.llm.common import ALNUM_WORD, ascii_lower, bounded_batches, flat_lists, free_name, row_key, running_sum, word_hashes, written

WINDOW = 10
#: Words of items in one block, about at most: 8 bytes a word in the broadcast, some 300 in the automaton.
BLOCK_WORDS = 500_000


class SuffixAutomaton:
    """Of several word sequences; no match runs from one into another."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        self._near: list[int] = []
        self._of_window: list[int] = []

    def add(self, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        seen = nxt[last].get(w)
        if seen is not None:
            return seen if length[seen] == length[last] + 1 else self._clone(last, w, seen)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def name(self, item: int, sequence: list[int]) -> None:
        """Notes at the states of the item's windows that they are its. Called when all items have been added."""
        if 0 < len(sequence) < self.window:
            for v, n in self.matches(sequence):
                pass
            self.short.setdefault(v, []).append((n, item))
            self.least = min(self.least, n)
            return
        for v, n in self.matches(sequence):
            if n >= self.window:
                own = self.items.setdefault(self.of_window(v), [])
                if not own or own[-1] != item:
                    own.append(item)

    def of_window(self, v: int) -> int:
        """The state of the last `window` words of a match; worked out once for all states."""
        if len(self._of_window) != len(self.link):
            self._of_window = [0] * len(self.link)
            for u in self._by_length():
                self._of_window[u] = self._of_window[self.link[u]] if self.length[self.link[u]] >= self.window else u
        return self._of_window[v]

    def _by_length(self) -> list[int]:
        """All states but the first, each behind the one that its suffix link leads to."""
        return sorted(range(1, len(self.link)), key=self.length.__getitem__)

    def matches(self, sequence) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for w in sequence:
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            yield v, n

    def scan(self, sequence) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (begin, end) of the windows that occur in the sequence, and the items that have them."""
        spans, found = [], set()
        for i, (v, n) in enumerate(self.matches(sequence)):
            if n >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found.update(self.items[self.of_window(v)])
            if self.short:
                near = self.nearest_short()
                u, m = near[v], n
                while u > 0:
                    for k, item in self.short[u]:
                        if k <= m:
                            spans.append((i + 1 - k, i + 1))
                            found.add(item)
                    m = self.length[self.link[u]]
                    u = near[self.link[u]]
        return spans, found

    def nearest_short(self) -> list[int]:
        """For each state the first one, from it along the suffix links, at which a short item ends; 0 if there is none. As short items have fewer words than a window, so do the chains of these."""
        if len(self._near) != len(self.link):
            self._near = [0] * len(self.link)
            for v in self._by_length():
                self._near[v] = v if v in self.short else self._near[self.link[v]]
        return self._near


class Matcher:
    """One block of items: names, word sequences and, built on each executor when first used, their automaton."""

    def __init__(self, names: list[str], sequences: list[np.ndarray], window: int):
        self.names, self.sequences, self.window = names, sequences, window
        self._built = None

    def __getstate__(self):
        return self.__dict__ | {"_built": None}

    def built(self) -> tuple[SuffixAutomaton, np.ndarray]:
        if self._built is None:
            vocabulary = np.unique(np.concatenate(self.sequences)) if self.sequences else np.zeros(0, dtype=np.int64)
            coded = [np.searchsorted(vocabulary, s).tolist() for s in self.sequences]
            automaton = SuffixAutomaton(self.window)
            for s in coded:
                automaton.add(s)
            for k, s in enumerate(coded):
                automaton.name(k, s)
            self._built = automaton, vocabulary
        return self._built

    def scan_batch(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Row, spans and item names of each row with hits. A word that no item has ends every match, so only runs of known words that are long enough are streamed."""
        automaton, vocabulary = self.built()
        if not len(vocabulary) or not len(values):
            return
        codes = np.searchsorted(vocabulary, values)
        codes[codes == len(vocabulary)] = 0
        known = vocabulary[codes] == values
        cut = np.zeros(len(values) + 1, dtype=bool)
        cut[offsets[:-1][offsets[:-1] < len(values)]] = True
        change = np.flatnonzero(cut[:-1] | (known != np.r_[False, known[:-1]]))
        ends = np.r_[change[1:], len(values)]
        use = known[change] & (ends - change >= automaton.least)
        hits: dict[int, tuple[list, set]] = {}
        for b, e in zip(change[use].tolist(), ends[use].tolist()):
            spans, found = automaton.scan(codes[b:e].tolist())
            if spans:
                row = int(np.searchsorted(offsets, b, side="right")) - 1
                got = hits.setdefault(row, ([], set()))
                got[0].extend((b - int(offsets[row]) + x, b - int(offsets[row]) + y) for x, y in spans)
                got[1].update(self.names[k] for k in found)
        for row, (spans, found) in hits.items():
            yield row, spans, found


def item_blocks(items: DataFrame, id_col: str, text: str, window: int, block_words: int) -> DataFrame:
    """block, name and w (word hashes): the items' words in blocks of about block_words at most. Null and wordless items are left out; longer items than a quarter block stand in several pieces that overlap, so that each window is whole in one."""
    piece = max(block_words // 4, 2 * window)
    named = items.select(F.col(id_col).cast("string").alias("name"), word_hashes(ascii_lower(F.col(text)), ALNUM_WORD).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(piece - window + 1))
    pieces = named.select("name", F.explode(starts).alias("at"), "all").select("name", "at", F.slice("all", F.col("at") + 1, F.lit(piece)).alias("w"))
    placed = running_sum(pieces, [F.col("name"), F.col("at"), F.xxhash64("w")], F.size("w"), "before")
    return written(placed.select(F.floor(F.col("before") / block_words).cast("long").alias("block"), F.coalesce("name", F.lit("")).alias("name"), "w"), "item-blocks")


def matcher_of(blocks: DataFrame, block: int, window: int) -> Matcher:
    rows = blocks.where(F.col("block") == block).collect()  # block_words and a piece at most
    return Matcher([r["name"] for r in rows], [np.array(r["w"], dtype=np.int64) for r in rows], window)


Hits = tuple[list[list[tuple[int, int]]], list[set[str]]]


def _scanned(docs: DataFrame, w: str, key: str, items: DataFrame, item_id: str, item_text: str, window: int, block_words: int, finish: Callable[[pa.RecordBatch, Hits], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """finish(batch, (spans, names) of each row) of the documents' batches. w: the column of word hashes; key: one that tells rows apart which differ in their words."""
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id, item_text, window, block_words)
    n_blocks = 1 + (blocks.agg(F.max("block")).first()[0] or 0)

    def hits_of(batch: pa.RecordBatch, matcher: Matcher) -> Hits:
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        found: list[set] = [set() for _ in range(batch.num_rows)]
        for row, got, names in matcher.scan_batch(*flat_lists(batch.column(w))):
            spans[row], found[row] = got, names
        return spans, found

    if n_blocks == 1:
        only = spark.sparkContext.broadcast(matcher_of(blocks, 0, window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, hits_of(batch, only.value))

        return docs.mapInArrow(scan, schema)

    hits = None
    for k in range(n_blocks):
        one = spark.sparkContext.broadcast(matcher_of(blocks, k, window))

        def scan_one(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans, found = hits_of(batch, one.value)
                rows = [i for i, x in enumerate(spans) if x]
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(key).take(pa.array(rows, pa.int64())), "begins": pa.array([[b for b, _ in merged(spans[i])] for i in rows], pa.list_(pa.int64())),
                    "ends": pa.array([[e for _, e in merged(spans[i])] for i in rows], pa.list_(pa.int64())), "names": pa.array([sorted(found[i]) for i in rows], pa.list_(pa.string())),
                })

        own = written(docs.select(w, key).mapInArrow(scan_one, "key long, begins array<long>, ends array<long>, names array<string>"), "leaks")
        one.destroy()
        hits = own if hits is None else hits.union(own)
    listed = lambda c: F.flatten(F.collect_list(c)).alias(c)
    # begins and ends are listed as pairs, so that both keep one order
    pairs = hits.select("key", F.arrays_zip("begins", "ends").alias("spans"), "names").groupBy("key").agg(listed("spans"), listed("names"))
    spans, names = free_name("spans", docs.columns), free_name("names", docs.columns)
    joined = docs.join(pairs.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("names").alias(names)), key, "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[(x["begins"], x["ends"]) for x in xs or ()] for xs in batch.column(spans).to_pylist()]
            yield finish(batch, (got, [set(x or ()) for x in batch.column(names).to_pylist()]))

    return joined.mapInArrow(rest, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (names, sorted) and spans (merged, in words) per document.

    Null texts and items have no words; an empty side gives no hits; repeated rows give repeated results; an item id that
    occurs twice counts once, a null one as ""; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), word_hashes(ascii_lower(F.col(text)), ALNUM_WORD).alias("w"), row_key(F.col(id_col), F.col(text)).alias("key"))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def finish(batch: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        joined, names = [merged(s) for s in hits[0]], hits[1]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(flat_lists(batch.column("w"))[1]), pa.int64()), "n_hit": pa.array([sum(e - b for b, e in s) for s in joined], pa.int64()), "n_items": pa.array([len(x) for x in names], pa.int64()),
            "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())), "spans": pa.array([[{"begin": b, "end": e} for b, e in s] for s in joined], span),
        })

    return _scanned(src, "w", "key", items, item_id, item_text, window, block_words, finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<begin:long,end:long>>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns whatever their names, without the spans that items' windows cover; those covered to more than max_coverage of their words are dropped whole.

    A removed span reaches from its first word's start to the start of the word after its last. Texts without hits stay as they are, null and empty ones too; rows that repeat are cut or dropped alike; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    word = re.compile(ALNUM_WORD)
    names = docs.columns
    w, key = free_name("_w", names), free_name("_key", names)

    def finish(batch: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        kept = batch.select(names)
        at, sizes = names.index(text), np.diff(flat_lists(batch.column(w))[1])
        texts, keep = kept.column(at).to_pylist(), np.ones(batch.num_rows, dtype=bool)
        for row, got in enumerate(hits[0]):
            joined = merged(got)
            if sum(e - b for b, e in joined) > max_coverage * sizes[row]:
                keep[row] = False
            elif joined:
                starts = [m.start() for m in word.finditer(texts[row].translate(_LOWER))] + [len(texts[row])]
                for b, e in reversed(joined):
                    texts[row] = texts[row][: starts[b]] + texts[row][starts[e] :]
        return kept.set_column(at, kept.schema.field(at), pa.array(texts, kept.schema.field(at).type)).filter(pa.array(keep))

    src = docs.withColumn(w, word_hashes(ascii_lower(F.col(text)), ALNUM_WORD)).withColumn(key, row_key(F.col(id_col), F.col(text)))
    return _scanned(src, w, key, items, "item_id", "text", window, block_words, finish, docs.schema)


_LOWER = {i: i + 32 for i in range(65, 91)}
