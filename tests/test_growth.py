"""What joins make, and what is broadcast, does not outgrow the input."""

from __future__ import annotations

import random
import re

from conftest import rows

from refweave.operators import citations as cit
from refweave.operators import extraction as ex
from refweave.operators import matching as mt


def nodes(df):
    """The operators of df's final plan, after it has run."""
    df.collect()

    def walk(p):
        yield p
        name = p.nodeName()
        below = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        for x in below:
            yield from walk(x)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def most_joined(df):
    """The most rows that a join of df makes."""
    return max([p.metrics().apply("numOutputRows").value() for p in nodes(df) if "Join" in p.nodeName()], default=0)


def most_broadcast(df):
    """The most rows that df broadcasts."""
    return max([p.metrics().apply("numOutputRows").value() for p in nodes(df) if p.nodeName() == "BroadcastExchange"], default=0)


def test_an_unnested_bibliography_is_not_broadcast(spark):
    spans = spark.createDataFrame([(1, 1, "1, 3-4"), (1, 2, "3"), (1, 3, "x"), (2, 1, "40")], "doc_id long, group_order int, display string")
    entries = spark.range(1, 3).selectExpr("id AS doc_id", "explode(sequence(1, 30)) AS num").selectExpr("doc_id", "num", "'entry' AS text")
    df = cit.number_listing(spans, entries)
    assert not [p for p in nodes(df) if p.nodeName().startswith("Broadcast")]
    assert rows(df) == [(1, 1, "1, 3-4", 0, 1, "1 — entry", 1, 2, 4, 3), (1, 1, "1, 3-4", 1, 3, "3 — entry", 2, 2, 4, 3), (1, 1, "1, 3-4", 2, 4, "4 — entry", 1, 2, 4, 3), (1, 2, "3", 0, 3, "3 — entry", 2, 2, 4, 3), (2, 1, "40", 0, 40, "#40", 1, 1, 1, 1)]


def test_records_of_one_name_are_met_as_one_row(spark):
    lib = spark.range(300).selectExpr("id AS rec_id", "'Fox' AS surname", "'1990' AS year", "CASE WHEN id = 7 THEN 'Red hens' ELSE 'Other things' END AS title", "0 AS trash_state").union(spark.createDataFrame([(900, "Owl", "1990", None, 0), (901, "Elk", "1990", "Moss", 1)], "rec_id long, surname string, year string, title string, trash_state int"))
    missing = spark.createDataFrame([(str(i), a, "1990", t) for i, (a, t) in enumerate([("fox", "Red hens!"), ("Fox", "Grey"), ("Owl", "Any"), ("Elk", "Moss"), (None, "Any"), ("Fox", None)] + [("Fox", f"Grey {i}") for i in range(200)])], "recnum string, author string, year string, title string")
    df = cit.remap_recnums(missing, lib)
    assert most_joined(df) <= 206
    assert {r["recnum"]: (r["new_id"], r["how"]) for r in df.where("recnum < '6' AND length(recnum) = 1").collect()} == {"0": (7, "title"), "1": (0, "first"), "2": (900, "only"), "3": (None, "not_found"), "4": (None, "not_found"), "5": (0, "first")}


def test_pairs_of_one_surname_are_not_made(spark):
    titles = ["Brown foxes", "Brown hens", "Green foxes", "Nothing alike", "xy", None]
    side = lambda n, by: [((i * by) % 1009, "Fox", titles[(i * by) % 6]) for i in range(n)] + [(5000, None, "Brown foxes"), (5, "Elk", "Green moss"), (5, "Elk", "Brown moss")]
    missing, extra = side(300, 7), side(300, 11)
    words = lambda t: set(re.findall("[a-z]{5,}", (t or "").lower()))
    want, used = [], {0: set(), 1: set()}
    for s, m, e in sorted((a[1], a[0], b[0]) for a in missing for b in extra if a[1] and a[1] == b[1] and words(a[2]) & words(b[2])):
        if (s, m) not in used[0] and (s, e) not in used[1]:
            used[0].add((s, m))
            used[1].add((s, e))
            want.append((s, m, e))
    schema = "pos long, surname string, title string"
    df = mt.reconcile(spark.createDataFrame(missing, schema), spark.createDataFrame(extra, schema))
    assert rows(df) == sorted(want, key=repr) and len(want) > 200
    assert most_joined(df) <= 600


def test_a_catalogue_is_not_broadcast(spark, tmp_path):
    spark.range(400).selectExpr("id AS rec_id", "'Fox' AS surname", "'1990' AS year", "CASE WHEN id % 2 = 0 THEN 'Brown woods' ELSE 'Woods, brown' END AS title", "concat('a', id) AS abstract").write.parquet(f"{tmp_path}/c")
    spark.range(300).selectExpr("id AS ref_id", "'Fox, A.' AS author", "'1990' AS year", "CASE WHEN id = 0 THEN '' WHEN id = 1 THEN 'Green' ELSE 'Brown' END AS title").write.parquet(f"{tmp_path}/r")
    df = mt.catalog_abstracts(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/c"))
    assert rows(df) == sorted(((i, 0, "a0") for i in range(300) if i != 1), key=repr)
    assert most_broadcast(df) <= 10
    claims = df.selectExpr("ref_id AS claim_id", "'brown fox' AS claim")
    assert most_broadcast(mt.abstract_share(claims, df)) <= 10


def test_records_of_the_same_words_are_scored_once(spark):
    rng = random.Random(5)
    words, numbers = ["brown", "foxes", "hens", "moss", "river"], ["3", "5", "12", "40", "41", "900"]
    some = lambda xs, n: " ".join(rng.choice(xs) for _ in range(n))
    records = [(i, rng.choice(["Fox", "Elk"]), "1990", some(words, 2), some(words, 1), rng.choice(["3", "5", "12", None]), f"{rng.choice(['40', '41', str(i)])}-{rng.choice(['3', str(i)])}") for i in range(300)]
    said = [(i, rng.choice(["Fox", "Elk", "Owl"]), rng.choice(["1990", "1990", None]), f"{some(words, 2)} {some(numbers, i % 4)} {300 - i}") for i in range(300)]
    of = lambda text: set(re.findall("[a-z]{4,}", text))
    want = {}
    for i, name, year, hint in said:
        have, found = set(re.findall(r"\d+", hint)), []
        for r, surname, y, title, journal, volume, pages in records:
            if name == surname and y == year:
                hits = (volume in have) + sum(p in have for p in pages.split("-"))
                found.append((-(len(of(title) & of(hint)) + len(of(journal) & of(hint)) + 0.5 * min(hits, 2)), r))
        found.sort()
        top, second = (-found[0][0], -found[1][0]) if found else (None, None)
        kind = "none" if not found else "exact" if top >= 2 and top - second >= 1.5 else "near" if top >= 1 and top > second else "ambiguous"
        want[i] = (found[0][1] if found else None, top, kind)
    asked = spark.createDataFrame(said, "ident long, surname string, year string, hint string")
    held = spark.createDataFrame(records, "rec_id long, surname string, year string, title string, journal string, volume string, pages string")
    df = mt.resolve_cited(asked, held)
    assert {r["ident"]: (r["rec_id"], r["score"], r["match_kind"]) for r in df.collect()} == want
    assert len({k for _, _, k in want.values()}) > 2
    alike = spark.range(400).selectExpr("id AS rec_id", "'Fox' AS surname", "'1990' AS year", "'Brown foxes' AS title", "'' AS journal", "'7' AS volume", "concat(2000 + id, '-', 3000 + id) AS pages")
    df = mt.resolve_cited(spark.range(300).selectExpr("id AS ident", "'Fox' AS surname", "'1990' AS year", "concat('Brown foxes 7, ', 2000 + id) AS hint"), alike)
    assert rows(df) == sorted(((i, i, 3.0, "near") for i in range(300)), key=repr)
    assert most_joined(df) <= 1000


def test_records_of_a_document_are_not_held_as_a_set(spark):
    rows_of = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "a"), (1, 3, 1, None), (2, 1, 1, None)], "doc_id long, group_order int, ref_pos int, recnum string")
    df = cit.citation_listing(rows_of)
    assert rows(df) == sorted([(1, 1, 1, "a", 2, 3, 4, 2), (1, 1, 2, "b", 1, 3, 4, 2), (1, 2, 1, "a", 2, 3, 4, 2), (1, 3, 1, None, 1, 3, 4, 2), (2, 1, 1, None, 1, 1, 1, 0)], key=repr)
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_a_claim_are_made_once_not_for_each_title(spark):
    claims = spark.createDataFrame([(1, "Brown foxes with moss", ["Moss and rivers", None, "Brown moss"]), (2, "with", ["Moss"]), (3, None, ["Moss"]), (4, "Green hens", []), (5, "Green hens", None), (6, "Hens", ["red HENS"])], "claim_id long, claim string, titles array<string>")
    df = mt.topical(claims)
    assert rows(df) == [(1, 0.666667), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 1.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(claim") == 1 and "lambdafunction" in plan


def test_a_reference_is_matched_once_for_all_its_fields(spark):
    shape = r"(.+?)\.\s+(.+?)\.\s+([^.]+)\.\s+(\d{4});(\d+)(?:\(([^)]*)\))?:(\d+)(?:-(\d+))?"
    bodies = ["Fox A, Elk B. Red hens. Moss. 1990;5(2):10-19. doi\n\nmore", "Fox A. Hens $1. Moss. 1991;6:7", "Owl\x01A. Red. Moss. 1992;7():8-9", "no reference", "", "\x01\x01\x01\x01\x01\x01\x01", "Fox\nA. Red. Moss. 1990;5:1", None]
    want = set()
    for b in bodies:
        m = re.match(shape, b) if b is not None else None
        want.add(tuple(None if b is None else "" for _ in range(8)) if m is None else tuple(x or "" for x in m.groups()))
    df = ex.parse_reference(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {tuple(r[c] for c in ("authors", "title", "journal", "year", "volume", "issue", "spage", "epage")) for r in df.collect()} == want and len(want) == 5
    assert "regexp_replace(body" in df._jdf.queryExecution().optimizedPlan().toString()


def test_ratios_of_short_windows_are_found_without_going_through_all_pairs_of_characters(monkeypatch):
    from difflib import SequenceMatcher

    from refweave.functions import similarity

    r, texts = random.Random(3), []
    for k in range(3000):
        letters = "abcdefgh  "[: r.randint(1, 10)]
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, n))) for n in (60, 90))
        texts.append((a, b if r.random() < 0.5 else (b + a[r.randint(0, len(a)) :] + b)[:190]))
    for a, b in texts:
        assert 2 * similarity.in_blocks(a, b) == round(SequenceMatcher(None, a, b, False).ratio() * (len(a) + len(b)))
    text = "".join(a + b for a, b in texts[:40])
    placed = similarity.PlacedText(text)
    claims = [text[i : i + n].replace("a", "z") for i in range(0, 900, 90) for n in (5, 40, 120)] + ["~~~~", "x" * 70]

    def slid(claim):
        n, step = len(claim), max(20, len(claim) // 2)
        return max([SequenceMatcher(None, claim, text[s : s + n + 40]).ratio() for s in range(0, len(text) - n, step)], default=0.0)

    want = [slid(c) for c in claims]
    monkeypatch.setattr(similarity, "SequenceMatcher", None)
    assert [similarity.best_window(c, placed, 0.0, 40) for c in claims] == want
