"""Hand-made rows for what SQL pairs can't show: exact semantics, folds, readers, streams."""

from __future__ import annotations

import base64
import json
import random
import re
import zipfile

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refweave.operators import citations, extraction, fields, layout, matching, rewriting, transplant
from refweave.sources import packages, readers, writers
from refweave.streaming import streams


def test_appearance_numbers_are_a_permutation(spark):
    cited = spark.createDataFrame([(1, 7, 1), (1, 3, 2), (1, 7, 3), (2, 5, 1)], "doc_id long, num int, pos int")
    entries = spark.createDataFrame([(1, 3), (1, 7), (1, 9), (2, 5)], "doc_id long, num int")
    assert rows(citations.renumber_appearance(cited, entries)) == [(1, 3, 2, True), (1, 7, 1, True), (1, 9, 3, False), (2, 5, 1, True)]


def test_ranges_expand_within_their_span(spark):
    df = spark.createDataFrame([("1,3-5",), ("9-2",), ("1-400",), (" 2 ; x; 4–6",), ("",)], "t string")
    assert [r[0] for r in df.select(citations.expanded_numbers(F.col("t"))).collect()] == [[1, 3, 4, 5], [9, 2], [1, 400], [2, 4, 5, 6], []]


def test_remaps_do_not_chain(spark):
    c = spark.createDataFrame([("1",), ("2",), ("3",)], "recnum string")
    m = spark.createDataFrame([("1", "2"), ("2", "3")], "old string, new string")
    assert rows(citations.apply_recnum_map(c, m).select("recnum", "mapped")) == [("1", "2"), ("2", "3"), ("3", "3")]


def test_nested_blocks_and_stray_ends(spark):
    runs = [(1, i + 1, b, 0, e, str(i)) for i, (b, e) in enumerate([(0, 1), (1, 0), (1, 0), (0, 1), (0, 1), (0, 1), (1, 0), (0, 0)])]
    df = spark.createDataFrame(runs, "doc_id long, pos int, n_begin int, n_sep int, n_end int, text string")
    assert rows(fields.field_blocks(df).select("first_run", "last_run", "display", "unterminated")) == [(2, 5, "1234", False), (7, 8, "67", True)]
    assert min(r["depth"] for r in fields.depth(df).collect()) == 0


def test_empty_field_takes_the_later_blob(spark):
    """An empty field with one blob holding record 42: one fix, with the record in the instruction."""
    blob = base64.b64encode(b"<EndNote><Cite><Author>Smith</Author><Year>2020</Year><RecNum>42</RecNum></Cite></EndNote>").decode().rstrip("=")
    df = spark.createDataFrame([(1, 1, "", " ADDIN EN.CITE ", None), (1, 2, "x", None, blob[:20] + "\r\n" + blob[20:]), (2, 1, "", " ADDIN EN.CITE ", None), (2, 2, "", None, "!!not base64!!")], "doc_id long, pos int, text string, instr string, fld_data string")
    got = fields.restore_fields(df).collect()
    assert len(got) == 1 and "&lt;RecNum&gt;42&lt;/RecNum&gt;" in got[0]["instr"]


def test_fields_are_restored_by_every_pattern(spark):
    blob = lambda *recs: base64.b64encode(("<EndNote>" + "".join(f"<Cite><RecNum>{r}</RecNum></Cite>" for r in recs) + "</EndNote>").encode()).decode()
    a, b = " ADDIN EN.CITE ", " ADDIN EN.CITE.DATA "
    data = [
        (1, 1, "x", a, None), (1, 2, "x", a, None), (1, 3, "x", None, blob(1)), (1, 4, "x", b, None), (1, 5, "x" * 3000, None, None),  # the first empty field takes the blob; the data field has only the one before it
        (1, 6, "x", b, None), (1, 7, "x", None, blob(2)), (1, 8, "x", None, blob(3, 4)), (1, 9, "x", None, blob(4)), (1, 10, "x", " ADDIN EN.CITE <RecNum>9</RecNum>", None), (1, 11, "x", None, blob(9)),
    ]
    df = spark.createDataFrame(data, "doc_id long, pos int, text string, instr string, fld_data string")
    assert sorted((r["pos"], r["pattern"], r["blob_pos"]) for r in fields.restore_fields(df).collect()) == [(1, "A", 3), (4, "B-reverse", 3), (6, "B", 7), (8, "C", 8)]


def test_orphan_superscripts_beside_a_field(spark):
    run = lambda pos, b, e, t, instr, v: (1, pos, 1, b, 0, e, t, instr, v)
    df = spark.createDataFrame([run(1, 1, 0, "", None, None), run(2, 0, 0, "5", " ADDIN EN.CITE <RecNum>5</RecNum>", None), run(3, 0, 1, "", None, None), run(4, 0, 0, "5, 6", None, "superscript"), run(5, 0, 0, "7", None, None)], "doc_id long, pos int, para_idx int, n_begin int, n_sep int, n_end int, text string, instr string, vert_align string")
    assert rows(fields.orphan_numbers(df)) == [(1, 4, "5, 6")]
    assert rows(fields.orphan_numbers(df, superscript_only=False)) == [(1, 4, "5, 6"), (1, 5, "7")]


def test_bibliography_sequence_restarts_and_jumps(spark):
    lines = ["1. Alpha", "2. Beta", "1999 was Good", "4. Delta", "40. Far", "1. Again", "2. More", "text"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, para_idx int, text string")
    accepted = extraction.sequence_bibliography(df)
    assert rows(accepted) == [(1, 0, 1, 1), (1, 1, 1, 2), (1, 3, 1, 4), (1, 5, 2, 1), (1, 6, 2, 2)]
    assert rows(extraction.entry_spans(accepted, df))[1] == (1, 2, 1, 2, "2. Beta 1999 was Good")


def test_blocked_matching_equals_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    lib = [(i, name(), "2000", "some title", "journal", "7", "", ["None"]) for i in range(60)]
    refs = [(i, name(), "2000", "") for i in range(60)]
    got = {r["ref_id"]: (r["rec_id"], r["match_kind"]) for r in matching.match_library(spark.createDataFrame(refs, "ref_id long, surname string, year string, hint string"), spark.createDataFrame(lib, "rec_id long, surname string, year string, title string, journal string, volume string, pages string, authors array<string>")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    for i, s, _, _ in refs:
        like = lambda t: 1 - edits(s, t) / max(len(s), len(t))  # noqa: B023, E731
        cands = [r for r in lib if like(r[1]) >= 0.85 or r[1].startswith(s[:4]) or s.startswith(r[1][:4])]
        if len(cands) == 1:
            assert got[i] == (cands[0][0], "exact")
        elif cands:
            assert got[i] == (cands[0][0], "ambiguous")
        else:
            far = [(like(r[1]) + 0.2 * (r[1][:5] == s[:5]) + 0.2, -r[0]) for r in lib if like(r[1]) >= 0.8 or r[1][:5] == s[:5]]
            best = max(far, default=(0, 0))
            assert got[i] == ((-best[1], "near") if best[0] >= 0.9 - 1e-12 else (None, "none"))


@pytest.mark.parametrize("similarity", ["edits", "sequence"])
@pytest.mark.parametrize("like", [0.85, 0.8])
def test_like_names_of_any_length_meet(spark, similarity, like):
    """All pairs, by brute force, of names of 2 to 40 letters of which many are several typos apart."""
    from difflib import SequenceMatcher

    rng = random.Random(int(like * 100))
    letters = "abcdefghij-é"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 40))) for _ in range(120)] + ["featherstonehaugh-brown", "ab", "aa", "aaaaaaaaaaaa"]

    def typos(x):
        x = list(x)
        for _ in range(rng.randint(1, max(1, len(x) // 5 + 1))):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        return "".join(x) or "a"

    others = sorted({typos(x) for x in names for _ in range(4)} | {"qfetherstonhaugh-brwn", "acb"})
    make = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r["sl"], r["ll"]) for r in matching.name_pairs(make(names, "sl"), make(others, "ll"), 4, like, similarity).where(F.col("ratio") >= like).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    value = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if similarity == "sequence" else (lambda a, b: 1.0 - edits(a, b) / max(len(a), len(b)))
    want = {(a, b) for a in names for b in others if abs(len(a) - len(b)) <= 12 and value(a, b) >= like}
    assert got == want and len(want) > 150 and any(len(a) > 30 for a, _ in want)


def test_reconcile_uses_each_extra_once(spark):
    m = spark.createDataFrame([(1, "lee", "Fractures growing"), (2, "lee", "growing bones")], "pos long, surname string, title string")
    e = spark.createDataFrame([(7, "lee", "The growing child"), (8, "kim", "growing")], "pos long, surname string, title string")
    assert rows(matching.reconcile(m, e)) == [("lee", 1, 7)]


def test_reading_order_keeps_the_line_anchor(spark):
    w = [(1, 1, 600.0, 10.0, 20.0, 0.0, "a"), (1, 1, 600.0, 30.0, 40.0, 2.5, "b"), (1, 1, 600.0, 50.0, 60.0, 5.0, "c"), (1, 1, 600.0, 400.0, 420.0, 0.0, "right")]
    df = spark.createDataFrame(w, "doc_id long, page int, page_width double, x0 double, x1 double, top double, text string")
    assert rows(layout.reading_order(df)) == [(1, 1, 0, 1, "a b"), (1, 1, 0, 2, "c"), (1, 1, 1, 1, "right")]


def test_renames_are_literal_and_counted_in_turn(spark):
    df = spark.createDataFrame([("A.b a.b axb",)], "t string")
    r = rewriting.batch_rename(df, "t", [("a.b", "$1"), ("$1", "z")], whole_words=False).first()
    assert (r["renamed"], r["counts"]) == ("z z axb", "2,2")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 99), min_size=1, max_size=6))
def test_number_maps_keep_what_they_lack(spark, numbers):
    text = ", ".join(map(str, numbers))
    got = spark.createDataFrame([(text,)], "t string").select(citations.applied_number_map(F.col("t"), F.create_map(F.lit("7"), F.lit("70")))).first()[0]
    assert got == ", ".join("70" if n == 7 else str(n) for n in numbers)


DOC = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:ins><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>1</w:t></w:r></w:ins></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> ADDIN EN.CITE </w:instrText></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:body></w:document>"""


def test_packages_become_runs_and_bad_ones_are_kept_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOC)
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    got = readers.read_packages(spark, str(tmp_path))
    r = [x for x in got.collect() if x["error"] is None]
    assert [(x["para_idx"], x["text"], x["vert_align"], x["tracked"], x["n_begin"]) for x in sorted(r, key=lambda x: (x["para_idx"], x["run_idx"]))] == [(0, "Hello", None, "none", 0), (0, "1", "superscript", "ins", 0), (1, "", None, "none", 1), (1, "", None, "none", 0), (1, "gone", None, "del", 0)]
    assert readers.package_health(got).where("error is not null").count() == 1


LIB = """<xml><records><record><rec-number>7</rec-number><foreign-keys><key app="EN" db-id="abcdefghij0123456789xyz">7</key></foreign-keys><contributors><authors><author><style face="normal">Smith, J.</style></author><author>Doe, A.</author></authors></contributors>
<titles><title><style>Bones &amp; </style><style>joints</style></title><secondary-title>J Bone</secondary-title></titles><dates><year><style>2020</style></year></dates><volume>3</volume><pages>1-9</pages></record><record><rec-number>8</rec-number><titles></titles></record></records></xml>"""


def test_library_export(spark, tmp_path):
    (tmp_path / "lib.xml").write_text(LIB)
    r = readers.read_library_xml(spark, str(tmp_path)).collect()
    assert [(x["rec_id"], x["authors"], x["surname"], x["year"], x["title"], x["journal"], x["db_id"]) for x in r] == [(7, ["Smith, J.", "Doe, A."], "Smith", "2020", "Bones & joints", "J Bone", "abcdefghij0123456789xyz")]
    assert readers.read_db_id(spark, str(tmp_path)).first()["db_id"] == "abcdefghij0123456789xyz"


def test_sheets_are_sniffed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Fig #,New caption\n1.1,A\n,B\n1.2,\n")
    assert rows(readers.read_naming_sheet(spark, str(tmp_path / "s.csv"))) == [("1.1", "A")]
    (tmp_path / "r.csv").write_text("Old name,New name\nx,y\nz,z\n")
    assert rows(readers.read_naming_sheet(spark, str(tmp_path / "r.csv"), rename=True)) == [("x", "y")]
    with pytest.raises(ValueError):
        readers.read_naming_sheet(spark, str(tmp_path / "s.csv"), rename=True)


def test_catalogue_dumps(spark, tmp_path):
    a = {"DOI": "10.1/X", "type": "book-chapter", "title": ["T", "U"], "container-title": ["J"], "author": [{"family": "Lee", "given": "A"}, {"name": "Group"}], "issued": {"date-parts": [[2001, 2]]}, "published-print": {"date-parts": [[2002]]}, "volume": "1", "page": "3-4", "ISSN": ["1-2"]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    r = readers.read_catalog_articles(spark, str(tmp_path / "a.json")).first()
    assert (r["doi"], r["type"], r["authors"], r["title"], r["journal"], r["year"]) == ("10.1/x", "Book Section", ["Lee, A", "Group"], "T", "J", "2002")
    d = {"uid": "9", "title": "T.", "authors": [{"name": "Family II"}], "articleids": [{"idtype": "pii", "value": "p"}, {"idtype": "doi", "value": "10.2/Y"}], "fulljournalname": "", "source": "Jr", "pubdate": "Winter", "epubdate": "2011 Jan", "issn": "", "essn": "5"}
    (tmp_path / "d.json").write_text(json.dumps(d))
    r = readers.read_catalog_docsums(spark, str(tmp_path / "d.json")).first()
    assert (r["doi"], r["authors"], r["title"], r["journal"], r["year"], r["issn"]) == ("10.2/y", ["Family, II"], "T", "Jr", "2011", "5")


def test_scan_cache_counts_only_with_the_current_page_count(spark, tmp_path):
    fig = {"source": "scan", "page_num": 3, "fig_type": "Fig", "fig_num": "1", "label": "Fig 1", "caption": "c", "caption_y": 5, "include": True, "crop_top": 1, "crop_bot": 2}
    for name, n in (("a", 10), ("b", 11)):
        (tmp_path / f"{name}.scan.json").write_text(json.dumps({"page_count": n, "figures": [fig]}, indent=1))
    now = spark.createDataFrame([("a", 10), ("b", 12)], "project string, page_count int")
    assert [r["project"] for r in readers.read_scan_cache(spark, str(tmp_path), now).collect()] == ["a"]


def test_lines_are_written_as_text(spark, tmp_path):
    rec = spark.createDataFrame([(1, "Book", ["A & B"], "T<x>", "J", "1999", "2", "3", "4-5", None)], "rec_id long, type string, authors array<string>, title string, journal string, year string, volume string, issue string, pages string, doi string")
    writers.write_lines(writers.library_xml(rec), str(tmp_path / "out"))
    assert "<author>A &amp; B</author>" in spark.read.text(str(tmp_path / "out")).first()[0]
    assert writers.ris(rec).first()["value"].split("\n")[-1] == "ER  - "


def test_stream_counts_as_the_table_does(spark, tmp_path):
    import time

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streams.decision_stream(stream).writeStream.format("memory").queryName("decided").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("decided")) == rows(streams.decision_stream(src))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
_RUN = lambda text, rest="": f"<w:r>{rest}<w:t>{text}</w:t></w:r>"
_FULL = f"""<w:document {_NS}><w:body><w:p w14:paraId="AA"><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:commentRangeStart w:id="3"/>{_RUN("Intro")}<w:commentRangeEnd w:id="3"/><w:r><w:commentReference w:id="3"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p w14:paraId="BB">{_RUN("cell")}</w:p></w:tc></w:tr></w:tbl>
<w:p w14:paraId="AA"><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> ADDIN EN.CITE </w:instrText></w:r>{_RUN("(Lee)")}<w:r><w:fldChar w:fldCharType="end"/></w:r><w:ins>{_RUN("1", '<w:rPr><w:vertAlign w:val="superscript"/></w:rPr>')}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
<w:p><w:r><w:drawing/></w:r><w:r><w:pict><w:txbxContent><w:p>{_RUN("boxed")}</w:p></w:txbxContent></w:pict></w:r></w:p></w:body></w:document>"""
_NOTES = f'<w:footnotes {_NS}><w:footnote w:id="2"><w:p>{_RUN("a note")}</w:p></w:footnote></w:footnotes>'
_COMMENTS = f'<w:comments {_NS}><w:comment w:id="3" w:author="Ann"><w:p>{_RUN("why")}</w:p><w:p>{_RUN("so")}</w:p></w:comment></w:comments>'


def _package(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)


def test_packages_become_tables_that_the_field_operators_take(spark, tmp_path):
    _package(tmp_path / "a.docx", document=_FULL, footnotes=_NOTES, comments=_COMMENTS)
    _package(tmp_path / "b.docx", document=_FULL, footnotes=_NOTES)
    _package(tmp_path / "cut.docx", document=_FULL[:900])
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    tables = packages.read_package_tables(spark, str(tmp_path))
    own = lambda name: tables[name].where("path like '%/a.docx'")
    assert [tuple(r) for r in own("paragraphs").orderBy("part", "para_idx").select("part", "para_idx", "style", "text", "has_image").collect()] == [
        ("body", 0, "Heading1", "Intro", False), ("body", 2, None, "(Lee)1", False), ("body", 3, None, "", True), ("body", 4, None, "boxed", False), ("comment", 0, None, "why", False), ("comment", 1, None, "so", False), ("footnote", 0, None, "a note", False), ("table", 1, None, "cell", False),
    ]
    assert rows(tables["comments"].select("comment_id", "author", "text")) == [("3", "Ann", "why\nso")]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in tables["quarantine"].collect()) == ["bad.docx", "cut.docx"]
    runs = packages.document_runs(tables["runs"])
    assert runs.where("doc_id like '%cut%'").count() == 0
    block = {r["doc_id"][-6:]: r["display"] for r in fields.field_blocks(runs).collect()}
    assert block == {"a.docx": "(Lee)", "b.docx": "(Lee)"}
    ids = tables["paragraphs"].where("xml_id is not null").select(F.col("path").alias("doc_id"), "xml_id")
    damage = fields.merge_damage(runs.drop("xml_id").withColumn("xml_id", F.lit(None).cast("string")), spark.createDataFrame([(r["doc_id"], 1) for r in runs.select("doc_id").distinct().collect()], "doc_id string, num int")).collect()
    assert {(r["begins"], r["seps"], r["ends"], r["ins_count"], r["del_count"], r["note_refs"], r["comment_marks"], r["cited_count"], r["lost_in_merge"], r["balanced"]) for r in damage} == {(1, 0, 1, 1, 1, 1, 3, 1, 0, False)}
    assert sorted(r["xml_id"] for r in citations.duplicate_ids(ids, "xml_id").collect()) == ["AA", "AA"]
    marks = runs.where("comment_mark is not null").select("doc_id", "comment_mark")
    with_part = tables["comments"].select(F.col("path").alias("doc_id")).distinct()
    assert {r["doc_id"][-6:] for r in fields.drop_orphan_comments(marks, with_part).collect()} == {"b.docx"}
    counts = fields.health_counts(runs).join(fields.orphan_comments(marks, with_part), "doc_id", "left").fillna(0).withColumns({c: F.lit(0) for c in ("orphans", "garbled", "dup_ids")})
    assert {(r["doc_id"][-6:], r["issue_id"]) for r in fields.health_issues(counts).collect()} == {("a.docx", "broken_fields"), ("b.docx", "broken_fields"), ("a.docx", "unbalanced_fields"), ("b.docx", "unbalanced_fields"), ("b.docx", "orphan_comments")}


def test_incremental_scan_parses_what_is_new_or_changed(spark, tmp_path):
    import time

    put, out = tmp_path / "p", str(tmp_path / "o")
    put.mkdir()
    text = lambda x: f"<w:document {_NS}><w:body><w:p>{_RUN(x)}</w:p></w:body></w:document>"

    def scan():
        streams.incremental_scan(spark, str(put), out, str(tmp_path / "k"))
        got = streams.scanned(spark, out)
        return {r["path"][-6:]: r["text"] for r in got["paragraphs"].collect()}, {r["path"][-6:] for r in got["quarantine"].collect()}, {r["path"][-6:]: r["batch"][:4] for r in got["files"].collect()}

    _package(put / "a.docx", document=text("one"))
    (put / "b.docx").write_bytes(b"x")
    assert scan() == ({"a.docx": "one"}, {"b.docx"}, {"a.docx": "new0", "b.docx": "new0"})
    time.sleep(1.1)
    _package(put / "b.docx", document=text("mended"))
    _package(put / "c.docx", document=text("three"))
    assert scan() == ({"a.docx": "one", "b.docx": "mended", "c.docx": "three"}, set(), {"a.docx": "new0", "b.docx": "chan", "c.docx": "new1"})
    time.sleep(1.1)
    _package(put / "a.docx", document=text("changed"))
    assert scan() == ({"a.docx": "changed", "b.docx": "mended", "c.docx": "three"}, set(), {"a.docx": "chan", "b.docx": "chan", "c.docx": "new1"})
    figures = spark.createDataFrame([("x", 3), ("y", 4)], "project string, page_count int")
    assert rows(streams.stale_figures(figures, spark.createDataFrame([("x", 3), ("y", 5), ("z", 1)], "project string, page_count int"))) == [("y", 5), ("z", 1)]


def test_abstracts_are_found_by_author_year_and_title_words(spark):
    catalog = [(5, "Lee", "2001", "Growing bones in children", "b5"), (3, "Lee", "2001", "Growing bones and tendons of children", "b3"), (4, "Lee", "2002", "Growing bones in children", "b4"), (6, "Kim", "2001", "A to z", "b6"), (7, "Kim", "2001", "Spine", "")]
    refs = [(1, "Lee, A. B.", "2001", "Growing Bones"), (2, "lee", "2001", "Children's growing tendons"), (3, "Lee", "2001", "Growing muscles"), (4, "Kim, C", "2001", "On it"), (5, "?", "2001", "Growing bones"), (6, "Lee", "2001", "Growing bones in children outgrow words"), (7, "Lee A", "2001", "Growing Bones")]
    got = matching.catalog_abstracts(spark.createDataFrame(refs, "ref_id long, author string, year string, title string"), spark.createDataFrame(catalog, "rec_id long, surname string, year string, title string, abstract string"))
    assert rows(got) == [(1, 3, "b3"), (2, 3, "b3"), (4, 6, "b6"), (7, 3, "b3")]


def test_reference_lists_start_at_a_heading_or_a_number(spark):
    said = [(1, "Text of 2001"), (1, "REFERENCES"), (1, "Lee A. Bones. 1999; 2003"), (1, " "), (1, "2) Kim B. Joints 1850"), (1, "bibliography"), (1, "last"), (2, "before"), (2, "7. First 2010"), (2, "goes on"), (3, "1.none"), (3, "no list")]
    df = spark.createDataFrame([(d, i, x) for i, (d, x) in enumerate(said)], "doc_id long, para_idx int, text string")
    assert rows(extraction.reference_paragraphs(df)) == [(1, 1, "Lee A. Bones. 1999; 2003", "1999"), (1, 2, "Kim B. Joints 1850", ""), (1, 3, "last", ""), (2, 1, "First 2010", "2010"), (2, 2, "goes on", "")]
    twice = spark.createDataFrame([(1, 0, "3a. one"), (1, 1, "3a) two"), (1, 2, " 4. x "), (1, 3, "5.y")], "doc_id long, para_idx int, text string")
    assert rows(extraction.numbered_entries(twice)) == [(1, "3a", "3a) two"), (1, "4", "4. x")]


def test_article_xml(spark, tmp_path):
    author = "<Author><LastName>{}</LastName><Initials>AB</Initials></Author>".format
    (tmp_path / "a.xml").write_text(f"""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><JournalIssue><Volume>7</Volume><Issue>2</Issue><PubDate><MedlineDate>1999 Spring</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>J Bone</ISOAbbreviation></Journal>
<ArticleTitle>Bones &amp; <i>joints</i></ArticleTitle><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination><Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract><AuthorList>{"".join(map(author, "abcdefgh"))}<Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><Title>Whole name</Title><JournalIssue><PubDate><Year>2004</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>""")
    got = {r["pmid"]: r.asDict() for r in readers.read_catalog_article_xml(spark, str(tmp_path)).collect()}
    assert got["11"] == {"source": "articles", "doi": "10.1/x", "pmid": "11", "pmc": "PMC5", "authors": [f"{x} AB" for x in "abcdef"], "title": "Bones & joints", "journal": "J Bone", "year": "1999", "volume": "7", "issue": "2", "pages": "1-9", "abstract": "First. Second."}
    assert (got["12"]["journal"], got["12"]["year"], got["12"]["authors"], got["12"]["doi"], got["12"]["abstract"]) == ("Whole name", "2004", [], "", "")


def test_folds_are_linear_in_a_document(spark):
    import time

    n = 100_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("para_idx"), F.concat((1 + F.col("id") % 900).cast("string"), F.lit(". Entry")).alias("text"))
    words = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.lit(600.0).alias("page_width"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("x1"), (F.col("id") * 1.0).alias("top"), F.lit("w").alias("text"))
    began = time.time()
    got = extraction.sequence_bibliography(lines)
    assert got.count() == n and got.agg(F.max("section")).first()[0] == 112
    assert layout.reading_order(words).count() == n // 4
    assert time.time() - began < 60


def chains_of(pairs):
    """All order-preserving chains of pairs (t, s, weight), by brute force."""
    out = [[]]
    for p in sorted(pairs):
        out += [c + [p] for c in out if not c or (p[0] > c[-1][0] and p[1] > c[-1][1])]
    return out


def test_chosen_sources_follow_the_table_of_the_alignment():
    rng = random.Random(9)
    for _ in range(300):
        pairs = [(t, s, rng.choice([1, 2, 2, 3, 5]) * 100_000) for t in range(4) for s in range(5) if rng.random() < 0.5]
        best = max(chains_of(pairs), key=lambda c: (sum(x[2] for x in c), [v for x in c for v in x[:2]]))
        assert transplant.aligned(pairs) == best


def test_fallback_takes_free_sources_and_order_fills_gaps():
    pairs = [(1, 30, 600_000), (2, 10, 500_000), (3, 30, 450_000)]
    run = lambda by_order: transplant.chosen_sources(pairs, [(1, True), (2, True), (3, True), (4, False), (5, True)], [10, 20, 30, 40], 400_000, 120_000, by_order)
    assert run(False) == [(1, None, 600_000, None), (2, 10, 500_000, "context"), (3, 30, 450_000, "context"), (5, None, 0, None)]
    assert run(True) == [(1, None, 600_000, None), (2, 10, 500_000, "context"), (3, 30, 450_000, "context"), (5, 40, 0, "position")]
    del pairs[2]  # now the first pair is the whole alignment, and the second target takes its source out of order
    assert run(False)[:3] == [(1, 30, 600_000, "context"), (2, 10, 500_000, "context"), (3, None, 0, None)]


def test_broken_citations_and_identity_bonus(spark):
    schema = "doc_id long, pos long, kind string, text string, instr string, surname string, year string, title string"
    field = lambda d, pos, instr, sur, year, title: (d, pos, "field", "x", instr, sur, year, title)
    t = spark.createDataFrame([field(1, 1, "INVALID CITATION <RecNum>5</RecNum>", "Lee", "2001", "growing bones fracture"), field(1, 2, "<RecNum>0</RecNum>", "Lee", "1999", "else"), field(1, 3, "<RecNum>7</RecNum>", None, None, None), (1, 4, "bare", "5", None, None, None, None), (1, 5, "text", "words", None, None, None, None)], schema)
    s = spark.createDataFrame([field(1, 10, "<RecNum>5</RecNum>", "lee", "2001", "bones growing"), field(1, 20, "<RecNum>6</RecNum>", "Lee", "2001", "bones at rest"), field(1, 30, None, "Lee", "2001", "bones")], schema)
    targets, sources = transplant.marked_broken(t), transplant.marked_broken(s)
    assert [(r["pos"], r["broken"]) for r in targets.orderBy("pos").collect()] == [(1, True), (2, True), (3, False), (4, True)]
    bonus = transplant.identity_bonus(targets, sources)
    assert rows(bonus.where("s < 30")) == [(1, 1, 10, 0.2, 2), (1, 1, 20, pytest.approx(0.15), 1), (1, 2, 10, 0.03, 0), (1, 2, 20, 0.03, 0)]
    sims = spark.createDataFrame([(1, 1, 10, 0.3), (1, 4, 20, 0.5)], "doc_id long, t long, s long, sim double")
    chosen = transplant.transplant(targets, sources, transplant.scored_pairs(sims, bonus))
    assert rows(chosen) == [(1, 1, 10, 0.5, "context", "ambiguous"), (1, 2, None, 0.03, None, "no match"), (1, 4, 20, 0.5, "context", "transplanted")]
    assert rows(transplant.transplant_summary(chosen)) == [(1, 3, 2, 2, 0, 1, 1)]


def test_library_scores_weigh_authors_and_pages(spark):
    """Two records of one surname and year: the second author's name and a page tell them apart."""
    lib = [(1, "lee", "2000", "bones", "journal", "7", "10-19", ["Lee, A.", "Kim, B."]), (2, "lee", "2000", "bones", "journal", "8", "30-39", ["Lee, A.", "Park, C."])]
    lib = spark.createDataFrame(lib, "rec_id long, surname string, year string, title string, journal string, volume string, pages string, authors array<string>")
    refs = spark.createDataFrame([(1, "Lee", "2000", "lee and park, bones 8:30"), (2, "Lee", "2000", "lee and park, bones in a journal"), (3, "Lee", "2000", ""), (4, None, "2000", "x"), (5, "Lee", None, "x")], "ref_id long, surname string, year string, hint string")
    got = {r["ref_id"]: (r["rec_id"], r["match_kind"], r["score"]) for r in matching.match_library(refs, lib).collect()}
    assert got[1] == (2, "exact", pytest.approx(2.6)) and got[2] == (2, "near", pytest.approx(2.6)) and got[3] == (1, "ambiguous", 0.0) and got[4] == (None, "none", 0.0) and got[5][:2] == (1, "near")


def test_relinking_decides_by_sets_and_records(spark):
    groups = spark.createDataFrame([(1, "body", 1, 1, 1), (1, "body", 1, 2, 2), (1, "body", 2, 1, 3), (1, "notes", 3, 1, 9), (1, "body", 4, 1, 4), (1, "body", 5, 1, 5)], "doc_id long, part string, group_order int, k int, num int")
    bib = spark.createDataFrame([(1, 1, "Lee", "2000", "x"), (1, 2, "Kim", "1999", "x"), (1, 3, "Roe", "2001", "bones growing"), (1, 4, "Roe", "2001", "else"), (1, 5, "Doe", "1980", "x")], "doc_id long, num int, surname string, year string, text string")
    src = spark.createDataFrame([(1, 7, "kim", "1999", 11, "t", "j", "1", ""), (1, 7, "lee", "2000", 12, "t", "j", "1", ""), (1, 8, "Roe", "2001", 13, "bones growing up", "j", "1", ""), (1, 9, "Roe", "2001", 14, "other", "j", "1", "")], "doc_id long, group_id long, surname string, year string, rec_id long, title string, journal string, volume string, pages string")
    got = rows(matching.relink(groups, bib, src, src).drop("doc_id"))
    assert got == [("body", 1, "1,2", "exact", ""), ("body", 2, "3", "constructed", ""), ("body", 4, "4", "constructed", "4"), ("body", 5, "5", "placeholder", ""), ("notes", 3, "9", "placeholder", "")]


def test_published_ratio_equals_sliding_over_all_windows(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    word = lambda: rng.choice("bone growth plate fracture of the child limb long short surgery outcome".split())
    texts = {i: " ".join(word() for _ in range(120)) for i in range(3)}
    claims = {1: texts[0][100:220], 2: " ".join(texts[1].split()[20:30] + ["quite", "other"] + texts[1].split()[32:40]), 3: "zebra " * 10, 4: "short"}
    got = {r["claim_id"]: (r["ratio"], r["text_id"]) for r in matching.published_ratio(spark.createDataFrame(list(claims.items()), "claim_id long, text string"), spark.createDataFrame(list(texts.items()), "text_id long, text string"), k=1).collect()}
    for i, c in claims.items():
        c, step = c.strip(), max(20, len(c.strip()) // 2)
        ratio = lambda t: max((SequenceMatcher(None, c, t[k : k + len(c) + 40]).ratio() for k in range(0, max(1, len(t) - len(c)), step)), default=0)  # noqa: B023, E731
        best = max((round(ratio(t), 6), -d) for d, t in texts.items()) if len(c) >= 25 and set(c.split()) & set(" ".join(texts.values()).split()) else (0, None)
        assert got[i] == (best[0], None if best[1] is None else -best[1])


def _sliding(claim, text, least=25, extra=40):
    from difflib import SequenceMatcher

    plain = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip(" ")
    c, t = re.sub(r"\d+", "", plain(claim)), plain(text)
    step = max(20, len(c) // 2)
    return max((SequenceMatcher(None, c, t[k : k + len(c) + extra]).ratio() for k in range(0, len(t) - len(c), step)), default=0.0) if len(c) >= least else 0.0


def test_window_ratios_equal_sliding_over_all_windows(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))

    def edited(c, share):
        return "".join(rng.choice("abc ") if rng.random() < share else x for x in c)

    texts = {1: some(400), 2: some(60), 3: "Größe  über\tAlles " + some(30) + " 𝛼𝛽𝛾", 4: None, 5: "", 6: "aaaa " * 200, 7: some(3)}
    pairs, claim = [], 0
    for t, text in texts.items():
        for n in (10, 24, 25, 47, 60, 150, 190, 260, 700):
            for share in (0, 0.05, 0.2, 0.5):
                at = rng.randint(0, max(0, len(text or "") - n))
                body = edited((text or some(40))[at : at + n], share)
                pairs.append((claim := claim + 1, t, rng.choice([body, body.upper(), body[: n // 2] + " 12, 13 " + body[n // 2 :]])))
        pairs += [(claim + 1, t, None), (claim + 2, t, ""), (claim + 3, t, some(12)), (claim + 4, t, text), (claim + 5, 99, some(12))]
        claim += 5
    left = spark.createDataFrame(pairs, "claim_id long, text_id long, text string")
    right = spark.createDataFrame(list(texts.items()), "text_id long, text string").withColumn("part", F.lit(1)).withColumn("body", F.lit("x"))
    truth = {(c, t): _sliding(body, texts.get(t)) for c, t, body in pairs}
    assert sum(r > 0.7 for r in truth.values()) > 15 and sum(0 < r <= 0.7 for r in truth.values()) > 50
    for above, per_group in ((0.0, 256), (0.0, 3), (0.7, 10)):
        got = {(r["claim_id"], r["text_id"]): r["ratio"] for r in matching.window_ratios(left, right, above, per_group=per_group).collect()}
        assert got == {k: round(v, 6) if v > above else 0.0 for k, v in truth.items()}
    none = matching.window_ratios(left.limit(0), right)
    assert none.count() == 0 and none.columns == ["claim_id", "text_id", "ratio"]


def test_window_ratios_search_a_long_text_without_measuring_all_of_it(spark, monkeypatch):
    from refweave.functions import similarity

    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    measured = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *a: measured.append(1) or __import__("difflib").SequenceMatcher(*a))
    placed, claim = similarity.PlacedText(text), text[40_000:40_150]
    found = similarity.best_window(claim, placed, 0.7, 40)
    assert found == _sliding(claim, text) > 0.7 and len(measured) < 10
    assert similarity.best_window(" ".join(rng.choice(words) for _ in range(25)), placed, 0.7, 40) == 0.0 and len(measured) < 10
    long = text[40_000:40_180]
    assert similarity.best_window(long, placed, 0.7, 40) == 0.0 and similarity.best_window(long, placed, 0.7, 40, popular=True) > 0.7


def test_verdicts_take_the_ratio_of_the_published_version(spark):
    from refweave.plans import resolving

    sf = "/root/testdata/sf0.001"
    claims = [r.asDict() for r in resolving._claims(spark, sf).where("doc_id < 400").collect()]
    kept = {}
    for c in sorted(claims, key=lambda c: c["claim_id"]):
        if c["kept"]:
            kept.setdefault(c["doc_id"], []).append(c["claim"])
    truth = {c["claim_id"]: round(_sliding(c["claim"], " ".join(kept.get(c["doc_id"], []))), 6) for c in claims}
    got = {r["claim_id"]: r["published"] for r in resolving.tier_published(spark, sf).collect() if r["claim_id"] in truth}
    assert got == truth and max(truth.values()) > 0.7
    tiers = {r["claim_id"]: r["topical"] for r in resolving.tier_topical(spark, sf).collect()}
    abstracts = {r["claim_id"]: r["c"] for r in resolving.tier_abstract(spark, sf).collect()}

    def verdict(i):
        a, b, c = tiers[i], truth[i], abstracts.get(i)
        topical = max(a, c or 0)
        if b > 0.7 and topical >= 0.12:
            return "verified"
        if topical >= 0.25 or (c or 0) >= 0.2:
            return "supported"
        return "plausible" if topical >= 0.1 or b > 0.7 else "review"

    verdicts = {r["claim_id"]: r["verdict"] for r in resolving.verify_citations(spark, sf).collect() if r["claim_id"] in truth}
    assert verdicts == {i: verdict(i) for i in truth} and "verified" in verdicts.values()


def test_figure_paragraphs_keep_labels_images_and_caption_styles(spark):
    data = [(1, 1, " fig. 3.2-a Bones", "Normal", None), (1, 2, "Nothing", "Figure Caption", False), (1, 3, None, None, True), (1, 4, "APPENDIX 2", None, None), (1, 5, "Plain", None, False), (1, 6, "", "caption", True), (2, 1, "Figure 3.2 " + "x" * 300, "", False)]
    got = matching_rows(extraction.figure_paragraphs(spark.createDataFrame(data, "doc_id long, para_idx int, text string, style string, has_image boolean")))
    assert got[(1, 1)][:3] == ("Figure", "3.2-a", "fig. 3.2-a Bones") and got[(1, 2)] == ("Caption", "", "Nothing", False, "Figure Caption") and got[(1, 3)] == ("Image", "", "", True, "")
    assert got[(1, 4)][:2] == ("Appendix", "2") and got[(1, 6)][0] == "Image" and (1, 5) not in got and len(got[(2, 1)][2]) == 250


def matching_rows(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def test_image_captions_look_ahead_as_far_as_they_may(spark):
    image = lambda d, i: (d, i, None, True)
    say = lambda d, i, t: (d, i, t, False)
    data = [image(1, 1), say(1, 2, ""), say(1, 3, "short"), say(1, 4, "Figure 1. Bone"), say(1, 5, "goes  on"), say(1, 6, "and ends A B"), say(1, 7, ""), say(1, 8, "not this")]
    data += [image(2, 1), say(2, 2, "a line of more than twenty characters"), say(2, 3, "Figure 2")] + [image(3, 1)]
    data += [image(4, 1)] + [say(4, i, "few") for i in range(2, 9)] + [say(4, 9, "Table 9 is too far away")]
    data += [image(5, 1), say(5, 2, "Video 1")] + [say(5, i, f"more {i}") for i in range(3, 10)] + [image(6, 1), say(6, 2, "Box 1"), say(6, 3, "Box 2")]
    got = matching_rows(extraction.image_captions(spark.createDataFrame(data, "doc_id long, para_idx int, text string, has_image boolean")))
    assert {k[0]: v[0] for k, v in got.items()} == {1: "Figure 1. Bone goes on and ends", 2: "a line of more than twenty characters", 3: "", 4: "", 5: "Video 1 more 3 more 4 more 5 more 6 more 7", 6: "Box 1"}


def test_captions_are_cut_at_labels_and_sentences(spark):
    sentence = "word " * 30 + "end. "
    data = ["Figure 1. A bone  Figure 2. Another", None, "", "Short. " + "x" * 700, sentence * 6, "x" * 650]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in data], "t string").select(extraction.cut_caption(F.col("t"))).collect()]
    # a label is one only behind a word's character
    assert got[0] == "Figure 1. A bone" and got[1] is None and got[2] == "" and got[3] == ("Short. " + "x" * 700)[:600] and got[4] == (sentence * 3).strip() and got[5] == "x" * 600


def test_modes_numbers_and_titles_of_documents(spark):
    runs = spark.createDataFrame([(1, "3, 4;5", "superscript", None, "x EN.CITE y"), (1, "6–7", None, "CitSup", None), (2, "8a", "superscript", None, None), (2, " 9 ", "subscript", "Sup", None), (2, "10", None, "Strong", None), (2, None, "superscript", None, None), (2, ", ", "superscript", None, None)], "doc_id long, text string, vert_align string, style string, instr string")
    spans = spark.createDataFrame([(2,), (3,), (3,)], "doc_id long")
    assert rows(extraction.document_modes(runs, spans)) == [(1, "record"), (2, "superscript"), (3, "span")] and extraction.document_modes(runs.limit(0), spans.limit(0)).count() == 0
    assert rows(extraction.run_numbers(runs)) == [(1, "3"), (1, "4"), (1, "5"), (1, "6"), (1, "7"), (2, "9")]
    lines = ["Growth plates", "small title", "Too long a title with very many words in it", "Care for the fracture", "12", "CHAPTER 3", "1.  First AB.", " goes on ", "", "1012", "1012.e4", "Not a Title", "2a. Second.", "SECTION of it", None]
    got = sorted(tuple(r) for r in extraction.titled_bibliography(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, line_no int, line string")).collect())
    assert got == [(1, 0, "section", "Growth plates"), (1, 6, "entry", "1. First AB. goes on Not a Title"), (1, 12, "entry", "2a. Second.")]


def test_samples_of_numbers_without_an_entry(spark):
    entries = spark.createDataFrame([(1, 1), (1, 1), (2, 7)], "doc_id long, num int")
    cited = spark.createDataFrame([(1, 7, 5), (1, 7, 5), (1, 7, 3), (1, 7, 9), (1, 1, 3), (2, 7, 1), (2, 8, 2)], "doc_id long, num int, para_idx int")
    paragraphs = spark.createDataFrame([(1, 3, " third "), (1, 5, "y" * 200), (1, 9, "ninth")], "doc_id long, para_idx int, text string")
    assert rows(citations.uncovered_samples(entries, cited, paragraphs)) == [(1, 7, 3, ["third", "y" * 120]), (2, 8, 1, [""])]


def test_usage_counts_words_within_longer_ones(spark):
    refs = spark.createDataFrame([(1, "Fracture outcome in children"), (2, "short one")], "ref_id long, title string")
    paras = spark.createDataFrame([(7, "Fractures, outcomes; schoolchildren."), (8, "fracture outcome")], "para_id long, text string")
    assert rows(matching.reference_usage(refs, paras)) == [(1, 7, 3)]


def test_restoring_copies_runs_behind_the_last_one(spark):
    m = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11)], "para_id long, old_id long")
    new = spark.createDataFrame([(2,)], "para_id long")
    old = spark.createDataFrame([(10, 3, "[1]"), (10, 8, "[2]")], "para_id long, run_idx int, text string")
    s = matching.restore_status(m, new, old)
    assert rows(s) == [(1, 10, "restored"), (2, 10, "already"), (3, None, "unmatched"), (4, 11, "plain")]
    runs = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "para_id long, run_idx int")
    assert rows(matching.copied_runs(s, runs, old)) == [(1, 6, "[1]"), (1, 7, "[2]")]


def _brute_ranking(queries, docs, k):
    """Cosines of all pairs, by the definition."""
    import re
    from collections import Counter
    from math import log, sqrt

    def grams(t):
        w = re.findall(r"\w\w+", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    df = Counter(t for _, x in docs for t in grams(x))

    def weights(x):
        w = {t: (1 + log(n)) * (log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in grams(x).items() if t in df}
        norm = sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    held = [(d, weights(x)) for d, x in docs]
    out = []
    for q, x in queries:
        wq = weights(x)
        scores = sorted((-round(sum(v * wd[t] for t, v in wq.items() if t in wd), 6), d) for d, wd in held if wq.keys() & wd.keys())
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("one_level", [0, 3, 256])
@pytest.mark.parametrize("k", [1, 4])
def test_ranking_equals_all_pairs(spark, monkeypatch, one_level, k):
    """With hot terms in levels, and without; ties, copies, texts without known terms."""
    from refweave.operators import ranking

    monkeypatch.setattr(ranking, "ONE_LEVEL", one_level)
    monkeypatch.setattr(ranking, "EASY", 8 if one_level == 3 and k == 4 else 0)
    rng = random.Random(one_level * 10 + k)
    words = ["common", "often"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [60, 25] + [100 / (i + 1) for i in range(40)], k=n))
    docs = [(i, text(rng.choice([2, 5, 9, 30]))) for i in range(150)] + [(200 + i, f"common w{i}") for i in range(40)] + [(300 + i, "common often") for i in range(9)] + [(400, ""), (401, "? !")]
    queries = [(i, text(rng.choice([1, 3, 8]))) for i in range(80)] + [(100, "common"), (101, "often common"), (102, "common w39 unknown"), (103, ""), (104, "nothing known here"), (105, "common")]
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = sorted(tuple(r) for r in matching.top_matches(make(queries), make(docs), k).select("q_id", "d_id", "score", "place").collect())
    assert got == _brute_ranking(queries, docs, k)


def test_a_term_in_every_text_is_not_joined(spark, monkeypatch):
    """Rows that a search joins follow k and the queries, not the pairs that share the hot term."""
    from refweave.operators import ranking

    seen = []
    plain = ranking.joined
    monkeypatch.setattr(ranking, "joined", lambda plan, postings: seen.append(plain(plan, postings)) or seen[-1])
    n = 2000
    docs = [(i, f"common rare{i} " + " ".join(f"f{(i * j) % 97}" for j in range(i % 7))) for i in range(n)] + [(n + i, f"common only{i}") for i in range(n)]
    queries = [(i, f"common rare{i}") for i in range(300)] + [(1000 + i, f"common only{i}") for i in range(300)] + [(2000, "common")]
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = matching.top_matches(make(queries), make(docs), 3).collect()
    assert len(got) == 3 * len(queries) and seen[0].count() <= 12 * len(got) < 601 * 4000 / 50
    assert {r["q_id"]: r["d_id"] for r in got if r["place"] == 1 and r["q_id"] >= 1000} == {1000 + i: n + i for i in range(300)} | {2000: min(r["d_id"] for r in got if r["q_id"] == 2000 and r["place"] == 1)}
