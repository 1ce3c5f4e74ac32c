"""Claims and versions of one document meet in its own task; windows that read alike are measured once."""

from __future__ import annotations

import random

import pytest

from refweave.functions import similarity as sim
from refweave.operators import matching as op
from refweave.plans import kit

try:
    from conftest import rows
except ImportError:
    from tests.conftest import rows


def _texts(seed: int = 3) -> tuple[list, list]:
    r = random.Random(seed)
    said = lambda n: " ".join(r.choice("the of economy matter then which was with these ring".split()) for _ in range(n))
    claims = [(d, d * 100 + i, said(r.choice((2, 5, 9, 14)))) for d in range(12) for i in range(6)] + [(40, 4000 + i, said(30)) for i in range(20)]
    texts = [(d, 9000 + d * 2 + k, " ".join(c[2] for c in claims if c[0] == d and (c[1] + k) % 3)) for d in (*range(10), 40) for k in range(2)]
    return claims, texts


@pytest.mark.parametrize("short", [1 << 14, 300, 0])
def test_shares_of_shingles_within_documents_are_those_of_brute_force(spark, monkeypatch, short):
    claims, texts = _texts()
    monkeypatch.setattr(op, "SHORT", short, raising=False)
    shingles = lambda t, k=5: {tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    want = {(c, t, len(shingles(x) & shingles(y)), len(shingles(x))) for d, c, x in claims for e, t, y in texts if d == e and shingles(x) & shingles(y)}
    got = op.claim_containment(spark.createDataFrame(claims, "doc_id long, claim_id long, text string"), spark.createDataFrame(texts, "doc_id long, text_id long, text string"), within=("doc_id",))
    assert {tuple(r)[:4] for r in rows(got)} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("h#" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)


def test_citations_are_dealt_out_by_document_once(spark, monkeypatch):
    c = kit.citations(spark, "/root/testdata/sf0.001")
    plan = c.groupBy("doc_id", "group_order").count()._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(doc_id" in line for line in plan.splitlines()) == 1


def test_equal_windows_are_measured_once_and_right():
    r = random.Random(5)
    part = lambda: f"{r.choice(('ring', 'bolt'))} of {r.randint(1950, 1953)} {r.choice(('economy with these', 'standard matter which then was'))}"
    sim.remembered_blocks.cache_clear()
    for _ in range(300):
        text = " ".join(part() for _ in range(r.randint(1, 6)))
        claim = "".join(x for x in part() if not x.isdigit())
        n, step = len(claim), max(20, len(claim) // 2)
        want = max([sim.SequenceMatcher(None, claim, text[s : s + n + 40]).ratio() for s in range(0, len(text) - n, step)], default=0.0)
        hidden = text.translate(str.maketrans("123456789", "0" * 9))
        assert abs(sim.best_window(claim, sim.PlacedText(hidden), 0.0, 40) - want) < 1e-12
        assert sim.best_window(claim, sim.PlacedText(hidden), 0.7, 40) == (pytest.approx(want) if want > 0.7 else 0.0)
    info = sim.remembered_blocks.cache_info()
    assert info.hits > info.misses
