"""Texts that merely share much of a bucket are told apart in blocks, not as joined rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from refweave.llm import neardup


def test_blocks_find_the_pairs_of_all_rows_with_all_centres(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    word_sets = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(4)]
    texts = {i: np.r_[word_sets[i % 4][: 60 - i % 30], rng.integers(0, 2**63, i % 9).astype(np.uint64)] for i in range(90)}
    g = {i: neardup.word_bytes(t, np.array([0, len(t)]))[0] for i, t in texts.items()}
    rows = [(h, i, len(texts[i]), int(i // 3 % 5), g[i].view("<i8").tolist()) for h in (1, 2, 3) for i in texts if h < 3 or i < 2]
    sizes = {h: sum(r[0] == h for r in rows) for h in (1, 2, 3)}
    left = spark.createDataFrame([(*r, sizes[r[0]]) for r in rows], "h long, id long, n int, root long, g array<long>, size long")
    for deals in (16, 4096):
        centres, met = neardup.alike_pairs(left, deals, 0.8)
        listed = [tuple(r) for r in centres.collect()]
        assert len(listed) == len(set(listed)) == left.select("h", F.pmod(F.xxhash64("id", F.lit(deals)), F.lit(deals))).distinct().count()
        want = set()
        of = {r[1]: r for r in rows}
        for h, b in listed:
            for _, a, n, root, _ in (r for r in rows if r[0] == h):
                m = of[b][2]
                if root != of[b][3] and abs(n - m) <= 0.2 * max(n, m) + 1e-9 and np.sum(g[a] == g[b]) >= neardup.least_shared(np.array([n]), np.array([m]), 0.8)[0]:
                    want.add((max(a, b), min(a, b)))
        found = [tuple(r) for r in met.collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_a_crowded_text_meets_its_keys_as_one_row(spark):
    texts = spark.createDataFrame([(i, [*range(i % 3, 40), 100 + i % 2]) for i in range(12)], "id long, w array<int>")
    lists = neardup.rare_lists(texts.select("id"), texts, 0.8)
    assert lists.count() == lists.select("id").distinct().count() == 12
    keys = neardup.rare_keys(texts.select("id"), texts, 0.8)
    assert keys.count() == lists.select(F.sum(F.size("hs"))).first()[0] > 12


def test_buckets_within_another_one_are_left_out_and_no_pair_with_them(spark):
    rng = np.random.default_rng(5)
    buckets = {h: set(range(40 - h)) for h in range(20)} | {100 + h: {int(x) for x in rng.choice(60, 2 + h % 9, replace=False)} for h in range(80)} | {300: set(range(3, 40)) | {77}, 301: {77, 78}, 302: {77, 78}}
    rows = spark.createDataFrame([(h, i, len(ids)) for h, ids in buckets.items() for i in ids], "h long, id long, size long")
    kept = {r["h"] for r in neardup.outer_buckets(rows).collect()}
    pairs = lambda some: {(a, b) for h in some for a in buckets[h] for b in buckets[h] if a < b}
    assert pairs(kept) == pairs(buckets)
    assert not kept & set(range(1, 20)) and len(kept & {301, 302}) < 3 and {0, 300} <= kept


def test_texts_meet_their_roots_once_however_many_keys_they_have(spark):
    rows = spark.createDataFrame([(h, i, i + 5) for i in range(4) for h in range(50)], "h long, id long, n int")
    roots = spark.createDataFrame([(0, 0), (2, 0)], "node long, root long")
    out = neardup.rooted(rows, roots)
    assert sorted(tuple(r) for r in out.select("h", "id", "n", "root").collect()) == sorted((h, i, i + 5, 0 if i == 2 else i) for i in range(4) for h in range(50))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join LeftOuter")


def test_rare_lists_are_the_same_with_and_without_hot_runs(spark, monkeypatch):
    texts = spark.createDataFrame([(i, [*range(i % 5, 40), *range(200 + i % 4, 215), 1000 + i]) for i in range(30)] + [(99, [7])], "id long, w array<int>")
    found = []
    for most in (1, 7, 10_000):
        monkeypatch.setattr(neardup, "HOT_RUNS", most)
        found.append(sorted((r["id"], r["hs"]) for r in neardup.rare_lists(texts.select("id"), texts, 0.8).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 30


def test_a_pair_is_left_to_the_largest_bucket_that_its_texts_share(spark):
    g = np.zeros(neardup.WORD_BYTES // 8, dtype=np.int64).tolist()
    rows = [(h, i, 30, i, 9 if i < 4 else 8, g, n) for h, n in ((7, 6), (8, 2), (9, 4)) for i in range(6) if h == 7 or (i < 4) == (h == 9)]
    left = spark.createDataFrame(rows, "h long, id long, n int, root long, largest long, g array<long>, size long")
    met = lambda df: {tuple(r) for r in neardup.alike_pairs(df, 4096, 0.8)[1].collect()}
    every = {(a, b) for a in range(6) for b in range(a)}
    assert met(left) == every
    assert met(left.where("h = 7")) == {(a, b) for a, b in every if (a < 4) != (b < 4)}
