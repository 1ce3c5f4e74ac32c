"""Fill-in-middle transformation (13): content-defined chunks whose summaries are remembered.

A rolling hash over the bytes cuts a text where the last bytes say so, so texts that share a passage share the chunks inside it wherever it stands. A chunk's summary (how many line ends and code points
it has and where its lines end, whether it holds a control string) is worked out once and remembered under the chunk's content: a hash finds it and the bytes themselves confirm it.
Summaries combine: running sums of the chunks' line ends give the number of lines and find the chunk in which a cut falls, its line ends the place inside, and sums of code points the lengths.
Control strings that lie across chunks are looked for in the few bytes around each seam.

The memory of summaries is bounded and only saves work; no result depends on it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches, spread

#: Control strings: before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that decide a cut; a cut is made where so many top bits of the hash are zero, so chunks have about 1,024 bytes; least and most bytes of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 64, 16_384
#: Bytes of chunks that a task remembers in each of two generations.
MEMORY_BYTES = 32_000_000

_GEAR = (spread(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_CONTINUATION = bytes(range(0x80, 0xC0))


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where chunks may end: after each byte whose rolling hash, of it and the bytes before it, has zero top bits. The hash of a window is made of two of half its size."""
    h, size = _GEAR[data], 1
    while size < WINDOW and size < len(h):
        longer = h.copy()
        longer[size:] += h[:-size] << np.uint32(size)
        h, size = longer, size * 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(points: list[int], length: int) -> list[int]:
    """The ends of a text's chunks, given where they may end: none shorter than LEAST (but the last), none longer than MOST."""
    ends, last = [], 0
    for p in (*points, length):
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or (p == length and p > last):
            ends.append(p)
            last = p
    return ends


class Summary(NamedTuple):
    """What combining needs of a chunk: where its lines end, its code points, whether it holds a control string."""

    line_ends: list[int]
    chars: int
    marked: bool


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


class Memory:
    """Summaries by the content of chunks. When the newer generation is full it becomes the older one, and what the older one had is forgotten unless it was used since."""

    def __init__(self, marks: tuple[bytes, ...], most_bytes: int = MEMORY_BYTES):
        self.marks, self.most_bytes = marks, most_bytes
        self.new: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.held = self.asked = self.made = 0

    def __getitem__(self, chunk: bytes) -> Summary:
        self.asked += 1
        known = self.new.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                self.made += 1
                known = Summary((np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1).tolist(), code_points(chunk), any(m in chunk for m in self.marks))
            self.held += len(chunk)
            if self.held > self.most_bytes:
                self.old, self.new, self.held = self.new, {}, len(chunk)
            self.new[chunk] = known
        return known


class Outline:
    """A text's chunks, combined."""

    def __init__(self, text: bytes, points: list[int], memory: Memory):
        self.text, self.ends = text, chunk_ends(points, len(text))
        seam = max(map(len, memory.marks), default=1) - 1
        self.summaries, self.lines, self.chars, self.marked, start = [], [], [], False, 0
        lines = chars = 0
        for end in self.ends:
            s = memory[text[start:end]]
            self.summaries.append(s)
            lines, chars = lines + len(s.line_ends), chars + s.chars
            self.lines.append(lines)
            self.chars.append(chars)
            self.marked = self.marked or s.marked or (start > 0 and any(m in text[max(0, start - seam) : start + seam] for m in memory.marks))
            start = end
        self.n = lines + (len(text) > 0 and text[-1] != 10)
        self.total_chars = chars

    def cut(self, k: int) -> tuple[int, int]:
        """The bytes and the code points of the first k lines."""
        if k == 0:
            return 0, 0
        if not self.lines or k > self.lines[-1]:
            return len(self.text), self.total_chars
        at = bisect_left(self.lines, k)
        start, lines, chars = (self.ends[at - 1], self.lines[at - 1], self.chars[at - 1]) if at else (0, 0, 0)
        inside = self.summaries[at].line_ends[k - lines - 1]
        return start + inside, chars + code_points(self.text[start : start + inside])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, a row per document.

    A text's lines are cut in three at two places that seed and id decide. psm is prefix, suffix, middle; spm suffix, prefix, middle; each part behind its control string.
    Plain, and as it was, stays an empty text (null counts as empty), one that holds a control string, and what `percent` leaves out. A null id counts as the empty text in the hash.
    Repeated rows get the same output; long texts are taken whole; other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    before, behind, between = (m.encode() for m in marks)

    def formed(key: str | None, data: bytes, points: list[int], memory: Memory) -> tuple:
        o = Outline(data, points, memory)
        digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not data or o.marked or h3 % 100 >= percent:
            return o.n, "plain", None, None, data
        a, b = sorted((h1 % (o.n + 1), h2 % (o.n + 1)))
        (i, i_chars), (j, j_chars) = o.cut(a), o.cut(b)
        prefix, middle, suffix = data[:i], data[i:j], data[j:]
        if h4 % 100 < spm_percent:
            return o.n, "spm", i_chars, j_chars - i_chars, b"".join([behind, suffix, before, prefix, between, middle])
        return o.n, "psm", i_chars, j_chars - i_chars, b"".join([before, prefix, behind, suffix, between, middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory((before, behind, between))
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            points = cut_points(np.frombuffer(b"".join(texts), np.uint8))
            out, at = [], 0
            for key, t, end in zip(b.column(1).to_pylist(), texts, ends):
                begin, to = int(end) - len(t), int(np.searchsorted(points, end, side="right"))
                # chunks have WINDOW bytes at least, so no cut depends on the text before
                out.append(formed(key, t, (points[at:to] - begin).tolist(), memory))
                at = to
            n, form, p, m, o = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(o, pa.binary()).view(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of fill_in_middle was made of, from the output and its form alone; null if either is null.

    The parts hold no control string, nor do a part's last characters and the control string behind it make one, so the output falls apart at its three."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
