"""Token-ID / binary output (1): flat unsigned integers and 64-bit document offsets, in shards that are read by memory map.

Documents are range-partitioned by id. Each task streams its documents' ids to one flat file and their ends to another; a
shard's base, the number of ids before it, is a prefix sum over the shards' totals, written to the manifest. Position
arithmetic is all that a reader needs: the ids of document i of a shard are ids[offsets[i]:offsets[i + 1]].

Files of a folder: NNNNN.ids (little-endian uint16 or uint32), NNNNN.off (little-endian int64, one more than documents),
NNNNN.doc (little-endian int64 document ids; null ids are written as 0, and the manifest says which leading documents they are)
and manifest.json.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches

#: Pieces a worker remembers the ids of, at most; then it starts anew.
MEMO_ENTRIES = 1_000_000
BATCH_CHARS = 4_000_000
#: A white-space character (as Python sees it, which includes all that a tokenizer may take for one) before a space.
_SPACES = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")


@dataclass(frozen=True)
class Format:
    """tokenizer: the file's path. width: bytes of an id, 2 or 4. end_id is appended to each document."""

    tokenizer: str
    end_id: int = 0
    width: int = 2

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


class Encoder:
    """Ids of texts.

    A byte-level BPE splits a text into pretokens first and encodes each by itself, and always splits where a space
    follows a character that isn't white space. So a text is cut before such spaces, and the tokenizer encodes each distinct
    piece once; a text's ids are gathered from its pieces' ids.
    """

    _made: dict[Format, Encoder] = {}

    def __init__(self, form: Format):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.form = form
        self.tokenizer = Tokenizer.from_file(form.tokenizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else "{}").get("type")
        self.splits = kind == "ByteLevel" and self.tokenizer.normalizer is None
        # a special token is found before a text is split; that changes nothing about where texts may be cut, unless it takes in white space
        self.splits = self.splits and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # whether a token begins with a space
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        self._forget()

    @classmethod
    def of(cls, form: Format) -> Encoder:
        """This worker's encoder for a format."""
        if form not in cls._made:
            cls._made[form] = cls(form)
        return cls._made[form]

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of each piece, by what follows the space that it begins with
        self.ids = np.zeros(1 << 16, dtype=self.form.dtype)  # of the pieces, end to end
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # ends[i] is where the ids of piece i - 1 end and those of piece i begin

    def _append(self, ids: np.ndarray, lengths: Sequence[int]) -> None:
        n, at = len(self.number), int(self.ends[len(self.number)])
        while len(self.ends) <= n + len(lengths):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ends[n + 1 : n + 1 + len(lengths)] = at + np.cumsum(lengths)
        self.ids[at : at + len(ids)] = ids

    def _learn(self, pieces: list[str], joined: bool) -> None:
        encode = lambda xs: [e.ids for e in self.tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
        if joined:
            ids = np.array(encode([" " + " ".join(pieces)])[0], dtype=self.form.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            lengths = np.diff(starts, append=len(ids))
        else:
            each = encode([" " + x for x in pieces])
            ids, lengths = np.array([i for x in each for i in x], dtype=self.form.dtype), list(map(len, each))
        if len(lengths) != len(pieces):
            raise RuntimeError("pieces and tokens that begin with a space differ in number")
        self._append(ids, lengths)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        numbers = list(map(self.number.get, pieces))
        new = [x for x, i in zip(pieces, numbers) if i is None]
        if len(self.number) + len(new) > MEMO_ENTRIES:
            self._forget()
            new, numbers = pieces, [None] * len(pieces)
        first = len(self.number)
        if new:
            # one call for many pieces: whatever starts with a space starts a piece, but where a piece holds further spaces or ends in white space
            plain = [bool(x) and " " not in x and not x[-1].isspace() for x in new]
            for some, joined in (([x for x, p in zip(new, plain) if p], True), ([x for x, p in zip(new, plain) if not p], False)):
                for i in range(0, len(some), 1000):
                    self._learn(some[i : i + 1000], joined)
            numbers = list(map(self.number.__getitem__, pieces)) if first + len(pieces) == len(self.number) else [self.number[x] if i is None else i for x, i in zip(pieces, numbers)]
        return np.array(numbers, dtype=np.int64)

    def _gathered(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows' pieces end to end, and where each row's end."""
        flat, offsets = pieces.flatten(), np.asarray(pieces.offsets, dtype=np.int64)
        coded = flat.dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts, lengths = self.ends[number], self.ends[number + 1] - self.ends[number]
        of = np.asarray(coded.indices)
        size = lengths[of]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(starts[of] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.r_[0, ends][offsets[1:] - offsets[0]]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, the end id last."""
        plain = lambda xs: [np.array(e.ids, dtype=self.form.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
        end = np.array([self.form.end_id], dtype=self.form.dtype).tobytes()
        if not self.splits:
            return [x + end for x in plain(texts.to_pylist())]
        rough = np.asarray(pc.match_substring_regex(texts, _SPACES))
        out: list[bytes] = [b""] * len(texts)
        for odd in (False, True):
            rows = np.flatnonzero(rough == odd)
            if not len(rows):
                continue
            some = texts.take(pa.array(rows))
            if odd:
                cut = pa.array([[x if i == 0 else x[1:] for i, x in enumerate(_CUT.split(t))] for t in some.to_pylist()], pa.list_(pa.large_string()))
            else:
                cut = pc.split_pattern(some.cast(pa.large_string()), " ")
            heads = plain(pc.list_element(cut, 0).to_pylist())
            ids, ends = self._gathered(pc.list_slice(cut, 1))
            for row, head, b, e in zip(rows.tolist(), heads, [0, *ends[:-1].tolist()], ends.tolist()):
                out[row] = head + ids[b:e].tobytes() + end
        return out


def _filesystem(folder: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, folder: str, form: Format, id_col: str = "doc_id", text: str = "text", order: Sequence[str] = ()) -> dict:
    """Writes the documents' ids below `folder` and returns the manifest. Documents are in the order of the columns `order`, or else in ascending document id (null first); ties are broken by id and text.

    Ids of documents are integers, or null. Null texts are empty and hold the end id alone; repeated rows are written each; an empty table gives a manifest without shards; other
    columns are ignored, whatever their names. A task writes under a name of its own attempt and renames, so that a repeated task does no harm.
    """
    bounded_batches(docs.sparkSession)
    at = docs.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    by = [*[F.col(f"o{i}") for i in range(len(order))], F.col("d"), F.xxhash64("t")]
    ordered = at.repartitionByRange(*by).sortWithinPartitions(*by, "t").select("d", "t")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get(), Encoder.of(form)
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name, attempt = f"{root}/{part.partitionId():05d}", f".{part.taskAttemptId()}"
        n, ends, ids, nulls = 0, [np.zeros(1, dtype="<i8")], [], []
        out = None
        for batch in batches:
            texts, at = batch.column("t"), sum(map(len, ids))
            ids.append(np.asarray(batch.column("d").fill_null(0), dtype="<i8"))
            nulls += (at + np.flatnonzero(np.asarray(batch.column("d").is_null()))).tolist()
            if out is None and len(texts):
                out = files.open_output_stream(f"{name}.ids{attempt}")
            share = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64)) // BATCH_CHARS
            for piece in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(share)) + 1):
                if len(piece):
                    got = encoder.encode(texts.slice(piece[0], len(piece)))
                    ends.append(n + np.cumsum(np.fromiter(map(len, got), dtype="<i8", count=len(got)) // form.width))
                    n = int(ends[-1][-1])
                    out.write(b"".join(got))
        if out is None:
            return
        out.close()
        for kind, values in (("off", np.concatenate(ends)), ("doc", np.concatenate(ids))):
            with files.open_output_stream(f"{name}.{kind}{attempt}") as f:
                f.write(values.astype("<i8").tobytes())
        for kind in ("ids", "off", "doc"):
            files.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part.partitionId()], pa.int32()), "docs": pa.array([sum(map(len, ids))], pa.int64()), "tokens": pa.array([n], pa.int64()), "nulls": pa.array([nulls], pa.list_(pa.int64()))})

    made = sorted(tuple(r) for r in ordered.mapInArrow(shard, "shard int, docs long, tokens long, nulls array<long>").collect())  # a row for each partition
    shards, base = [], 0
    for k, n_docs, n, nulls in made:
        shards.append({"shard": k, "docs": n_docs, "tokens": n, "base": base, "nulls": _spans(nulls)})
        base += n
    manifest = {"dtype": form.dtype, "end_id": form.end_id, "tokens": base, "docs": sum(s["docs"] for s in shards), "shards": shards}
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    files, root = _filesystem(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """ids, off (where each document's ids begin, and the last's end) and doc (document ids) of a shard; by memory map on a local or mounted folder, else by reading the asked range."""

    def __init__(self, folder: str, shard: int, dtype: str):
        import pyarrow.fs as fs

        self.files, root = _filesystem(folder)
        self.names = {kind: (f"{root}/{shard:05d}.{kind}", t) for kind, t in (("ids", dtype), ("off", "<i8"), ("doc", "<i8"))}
        self.mapped = {k: np.memmap(name, dtype=t, mode="r") for k, (name, t) in self.names.items()} if isinstance(self.files, fs.LocalFileSystem) else None

    def read(self, kind: str, begin: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[kind][begin:end]
        name, t = self.names[kind]
        size = np.dtype(t).itemsize
        with self.files.open_input_file(name) as f:
            f.seek(begin * size)
            return np.frombuffer(f.read((end - begin) * size), dtype=t)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, end_id, shard; with_ids adds ids.

    Null ids are null again; null and empty texts have their end id alone; rows that repeated are rows each; the files of an empty table give no rows."""
    manifest = read_manifest(folder)
    shards, dtype = manifest["shards"], manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, end_id long, shard int" + ", ids array<long>" * with_ids
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["shard"], s["base"], s["docs"], s["nulls"]) for s in shards], "shard int, base long, docs long, nulls array<array<long>>").repartition(len(shards), "shard")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, base, docs, nulls in zip(b["shard"], b["base"], b["docs"], b["nulls"]):
                shard = Shard(folder, k, dtype)
                for i in range(0, docs, 2000):
                    j = min(i + 2000, docs)
                    cut, ids_of = shard.read("off", i, j + 1), shard.read("doc", i, j)
                    ids = shard.read("ids", int(cut[0]), int(cut[-1]))
                    rows = [ids[x:y] for x, y in zip((cut[:-1] - cut[0]).tolist(), (cut[1:] - cut[0]).tolist())]
                    named = pd.array(ids_of.astype(np.int64), dtype="Int64")
                    for low, high in nulls:
                        named[max(0, low - i) : max(0, high - i)] = pd.NA
                    out = pd.DataFrame({"doc_id": named, "start": base + np.asarray(cut[:-1]), "n_tokens": np.diff(cut), "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in rows], "end_id": [int(x[-1]) for x in rows], "shard": k})
                    if with_ids:
                        out["ids"] = [x.astype(np.int64) for x in rows]
                    yield out

    return listed.mapInPandas(read, schema)


def _spans(places: list[int]) -> list[list[int]]:
    """Ascending places as [begin, end) spans."""
    out: list[list[int]] = []
    for x in places:
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return out
