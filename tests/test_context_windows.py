"""Windows of words around citations are made where their document's rows are."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from refweave.operators import matching as op

try:
    from conftest import rows
except ImportError:
    from tests.conftest import rows


def _documents() -> list:
    r = random.Random(11)
    out = []
    for d in range(8):
        for pos in range(r.randint(3, 90)):
            kind = r.random()
            text = None if kind < 0.05 else "" if kind < 0.2 else " ".join(f"{r.choice('abcdefgh')}{r.choice('stuvw')}x" for _ in range(r.choice((1, 1, 2, 40)))) + " the"
            out.append((d, pos * 2, text, kind > 0.7))
    return out


def test_windows_are_those_of_numbered_words(spark):
    docs, want = _documents(), set()
    for d in range(8):
        place, words, cites = 0, [], []
        for _, pos, text, is_cite in (x for x in docs if x[0] == d):
            if is_cite:
                cites.append((pos, place))
            else:
                held = [w for w in (text or "").split() if w != "the"]
                words += held
                place += len(held)
        want |= {(d, pos, w) for pos, at in cites for w in words[max(0, at - 20) : at + 12]}
    df = spark.createDataFrame(docs, "doc_id long, pos long, text string, is_cite boolean")
    got = op.context_words(df, ["the"])
    assert rows(got) == sorted(want, key=repr)
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_similar_windows_are_dealt_out_once(spark):
    r = random.Random(2)
    every = [(d, side, c, r.sample("abcdefghij", r.randint(1, 6))) for d in range(5) for side in (0, 1) for c in range(7)]
    idf = {w: round(1 + i / 7, 6) for i, w in enumerate("abcdefghij")}
    total = lambda ws: sum(idf[w] for w in ws)
    want = {}
    for d, a, t, x in every:
        for e, b, s, y in every:
            if d == e and (a, b) == (0, 1) and set(x) & set(y):
                both = total(set(x) & set(y))
                want[d, t, s] = both / (total(x) + total(y) - both)
    windows = spark.createDataFrame(every, "doc_id long, side int, cite long, words array<string>")
    weights = spark.createDataFrame(list(idf.items()), "word string, idf double")
    got = op.similar_windows(windows, weights)
    found = {tuple(x[:3]): x[3] for x in rows(got)}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)
    flat = windows.select("doc_id", "side", "cite", F.explode("words").alias("word"))
    again = op.context_similarity(flat.where("side = 0").drop("side"), flat.where("side = 1").drop("side"), weights)
    assert {tuple(x[:3]): x[3] for x in rows(again)} == found
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
