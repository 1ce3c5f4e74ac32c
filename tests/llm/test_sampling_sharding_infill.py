"""Importance resampling, sharding and fill-in-middle against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refweave.llm import fim, queries, resample, sharding
from tests.llm.test_llm import SF, docs_of, sample_docs

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = st.text(alphabet=st.sampled_from(list("aAbZ09 ,._-{|}~\n\t\x00\x7f\x80é 中🙂")), max_size=40)


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


# 11: importance resampling


def test_the_fixed_crc_of_a_space():
    assert resample._SPACE_CRC == zlib.crc32(b" ")


@settings(max_examples=200, deadline=None)
@given(st.lists(HARD, min_size=1, max_size=4), st.integers(1, 3), st.integers(0, 2))
def test_buckets_equal_hashing_each_gram(texts, shortest, more):
    longest = shortest + more
    found, upto, counts = resample.block_buckets([t.encode() for t in texts], shortest, longest, 997)
    at = 0
    for t, end, n in zip(texts, upto, counts):
        ws = words_of(t)
        want = [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 997 for k in range(shortest, longest + 1) for i in range(len(ws) - k + 1)]
        assert n == len(ws)
        assert found[at:end].tolist() == want
        at = end


def test_crc_of_a_long_word_behind_another():
    long = b"x" * 70_001
    got = resample.followed_by(np.array([zlib.crc32(b"ab ")], np.uint32), np.array([zlib.crc32(long)], np.uint32), np.array([len(long)]))
    assert got.tolist() == [zlib.crc32(b"ab " + long)]


def brute_draw(docs, target, longest=1, buckets=10_000, min_words=20, percent=10):
    grams = lambda t: [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for ws in [words_of(t)] for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]
    s, t = Counter(b for _, x in docs for b in grams(x)), Counter(b for x in target for b in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, x in docs:
        weight = sum(map(gain, grams(x)))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(words_of(x)), len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for i, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r, []).append(i + 1)
    return sorted((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in sorted(rows, key=repr)) if all(r[0] is not None for r in rows) else sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_equals_brute_force(spark, longest):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 19, 20, 40, 90])))) for i in range(300)]
    docs += [(None, "w1 " * 30), (400, None), (401, ""), (402, "w2 w3 " * 2000), (7, docs[7][1]), (8, "w9 " * 25), (8, "w9 " * 25)]
    target = [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(20)] + [""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)] + [(99, None)], "item_id long, text string")
    got = resample.importance_resample(docs_of(spark, docs), table, longest=longest).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_draw(docs, target, longest), key=repr)


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.importance_resample(docs_of(spark, []), none).collect() == []
    got = resample.importance_resample(docs_of(spark, [(1, "a b " * 20)]), none).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(40, None)]


def test_resampled_keeps_columns(spark):
    docs = docs_of(spark, [(i, f"w{i % 7} common words here " * 8) for i in range(50)]).withColumnRenamed("key", "draw_rank")
    got = resample.resampled(docs, spark.createDataFrame([(1, "w3 w3 w3")], "item_id long, text string"))
    assert got.columns == [*docs.columns, "draw_rank_"] and sorted(r["draw_rank_"] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_draw_query_equals_brute_force(spark):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_importance_resample(spark, SF).collect()}
    assert got == {d: (d, n, w, s, k) for d, _, n, w, s, k in brute_draw(list(sample_docs(spark).items()), target)}


# 12: sharding


def shards_of(rows, shards=8):
    """Checks what holds for any table, and returns the shards' bytes."""
    sizes = Counter()
    slots = {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= k < shards for k in slots)
    return [sizes[k] for k in range(shards)]


def near_equal(sizes, largest, within):
    mean = sum(sizes) / len(sizes)
    return max(abs(s - mean) for s in sizes) <= within * mean + 2 * largest


def test_shards_are_near_equal_and_keep_equal_texts(spark):
    rng = random.Random(3)
    docs = [(i, "x" * int(rng.paretovariate(1.3) * 40)) for i in range(4000)]
    docs = [(i, f"{i // 3} {t}" if i % 3 else f"{i // 3} {docs[i][1]}") for i, t in docs]
    docs = [(i, docs[i - i % 3][1]) for i, _ in docs]  # groups of three
    rows = sharding.assign_shards(docs_of(spark, docs)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in docs)
    assert near_equal(shards_of(rows), 3 * max(r["size"] for r in rows), 0.02)
    total, small = sum(r["size"] for r in rows), {}
    for r in rows:
        if 3 * r["size"] <= total / (8 * sharding.RANGES):  # a group that fits into a range
            small.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(small) > 1000 and all(len(s) == 1 for s in small.values())


def test_a_text_of_a_third_of_all_rows_is_spread(spark):
    hot = "the same text again"
    docs = [(i, hot if i % 3 == 0 else f"text {i} " * (i % 9)) for i in range(9000)] + [(9, hot)] * 3000 + [(None, None)] * 500
    rows = sharding.assign_shards(docs_of(spark, docs)).collect()
    assert len(rows) == len(docs)
    assert near_equal(shards_of(rows), 100, 0.03)
    most = Counter(r["range"] for r in rows)
    assert max(most.values()) <= 2 * 3 * len(docs) / (8 * sharding.RANGES) + 12
    again = sharding.assign_shards(docs_of(spark, docs).repartition(7)).collect()
    key = lambda r: (repr(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"])
    once, twice = (Counter(key(r) for r in x if r["doc_id"] != 9 and r["doc_id"] is not None) for x in (rows, again))
    assert once == twice


def test_few_records_and_a_giant(spark):
    assert sharding.assign_shards(docs_of(spark, [])).collect() == []
    rows = sharding.assign_shards(docs_of(spark, [(1, None), (2, ""), (3, "é" * 500_000), (4, "a"), (4, "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == [(1, 1, 0), (2, 1, 0), (3, 1_000_001, zlib.crc32("é".encode() * 500_000)), (4, 2, zlib.crc32(b"a")), (4, 2, zlib.crc32(b"a"))]
    shards_of(rows)


def test_splitters_deal_out_keys():
    s = sharding.Splitters({(5, sharding.LEAST), (9, sharding.LEAST), (9, 3), (9, 7), (12, sharding.LEAST)})
    at = lambda *p: s.ranges(*(np.array([x[i] for x in p], np.int64) for i in (0, 1))).tolist()
    assert at((4, 9), (5, -(2**63)), (8, 0), (9, -5), (9, 3), (9, 6), (9, 7), (10, 0), (12, 0), (99, 1)) == [0, 1, 1, 2, 3, 3, 4, 4, 5, 5]
    # the hot key of a sample gets a range to itself
    assert sharding.quantiles([(1, 0, 1), (5, 0, 8), (9, 0, 1)], 4) >= {(5, sharding.LEAST), (6, sharding.LEAST)}


def test_written_shards_hold_all_columns_in_order(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text {i} " * (i % 13)) for i in range(600)]).withColumnRenamed("key", "slot")
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=4)
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, shards=4).collect()}
    got = [r for k in range(4) for r in sharding.read_shard(spark, str(tmp_path / "shards"), k).collect()]
    assert {r["doc_id"]: (r["shard"], r["slot_"]) for r in got} == want and len(got) == 600 and got[0]["slot"] == "k"


def test_sharding_query(spark):
    rows = queries.op12_sampled_shards(spark, SF).collect()
    texts = sample_docs(spark)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in texts.items()}
    assert near_equal(shards_of(rows), max(r["size"] for r in rows), 0.02)


# 13: fill in the middle


def brute_infill(doc_id, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in marks):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def infill_rows(df):
    return [tuple(r) for r in df.withColumn("back", fim.restored(df["output"], df["form"])).collect()]


def test_infill_equals_brute_force(spark):
    rng = random.Random(11)
    passage = "".join(f"shared line {i} of a passage 🙂\n" for i in range(400))
    texts = [None, "", "\n", "\n\n", "no end", "<", "a<P>b", "<S", "x\n<M>", passage, f"other start {passage}and end", "y" * 60_000, "é\n" * 40_000, "line\r\nline"]
    texts += ["".join(rng.choices("ab\n <PSM>é", k=rng.randrange(2000))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, passage), (9, passage), (9, passage)]
    got = infill_rows(fim.fill_in_middle(docs_of(spark, rows)))
    want = [(*brute_infill(d, t), t or "") for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs_of(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<", "P", ">", "<P>", "\n", "x" * 70, "é中", "long line of words\n" * 9]), max_size=60), st.integers(0, 9))
def test_outline_of_any_chunks(parts, seed):
    data = "".join(parts).encode()
    rng = random.Random(seed)
    points = sorted(rng.sample(range(1, len(data) + 1), min(len(data), 12)))
    o = fim.Outline(data, points, fim.Memory((b"<P>", b"<S>", b"<M>")))
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    assert o.n == len(lines) and o.marked == (b"<P>" in data) and (o.ends[-1:] or [0]) == [len(data)]
    for k in range(len(lines) + 1):
        head = b"".join(lines[:k])
        assert o.cut(k) == (len(head), len(head.decode()))


def test_shared_passages_share_summaries():
    rng = random.Random(2)
    passage = "".join(chr(97 + rng.randrange(26)) if rng.random() < 0.9 else "\n" for _ in range(200_000)).encode()
    memory = fim.Memory((b"<P>",))
    for head in (b"", b"x" * 1001, b"another beginning\n"):
        text = head + passage
        fim.Outline(text, fim.cut_points(np.frombuffer(text, np.uint8)).tolist(), memory)
    assert memory.made < 1.1 * memory.asked / 3
    small = fim.Memory((b"<P>",), most_bytes=5000)
    for text in (passage[:50_000], passage[:50_000]):
        o = fim.Outline(text, fim.cut_points(np.frombuffer(text, np.uint8)).tolist(), small)
        assert o.n == len(re.findall(rb"[^\n]*\n|[^\n]+", text))
    assert sum(map(len, small.new)) + sum(map(len, small.old)) <= 2 * (5000 + fim.MOST)


def test_infill_is_linear_in_the_text():
    text = ("word " * 9 + "\n").encode() * 400_000
    began = time.time()
    o = fim.Outline(text, fim.cut_points(np.frombuffer(text, np.uint8)).tolist(), fim.Memory((b"<P>",)))
    assert o.n == 400_000 and o.cut(399_999)[0] == len(text) - 46 and time.time() - began < 10


def test_infill_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {d: (*brute_infill(d, t)[:5], sha(brute_infill(d, t)[5]), sha(t or "")) for d, t in sample_docs(spark).items()}
    assert {r["doc_id"]: tuple(r) for r in queries.op13_fill_in_middle(spark, SF).collect()} == want
