"""Relinking fetches what the catalogue says of records only where an identity has several."""

from __future__ import annotations

from refweave.operators import matching as op

try:
    from conftest import rows
except ImportError:
    from tests.conftest import rows


def test_only_identities_of_several_records_are_scored(spark, monkeypatch):
    groups = spark.createDataFrame([(1, "body", 1, 1, 1), (1, "body", 2, 1, 2), (1, "body", 3, 1, 3), (1, "notes", 4, 1, 9), (2, "body", 1, 1, 1), (2, "body", 1, 2, 2)], "doc_id long, part string, group_order int, k int, num int")
    bibliography = spark.createDataFrame([(1, 1, "Ring", "1960", "small ring 1"), (1, 2, "Bolt", "1970", "hot bolt"), (1, 3, "Gear", "1980", "x"), (2, 1, "Ring", "1960", "y"), (2, 2, "Rod", "1960", "z")], "doc_id long, num int, surname string, year string, text string")
    cited = [(1, 1, "Ring", "1960", 10), (1, 1, "Ring", "1960", 11), (1, 2, "Bolt", "1970", 12), (2, 5, "Ring", "1960", 10), (2, 5, "Rod", "1960", 13)]
    source = spark.createDataFrame(cited, "doc_id long, group_id int, surname string, year string, rec_id long")
    catalog = spark.createDataFrame([(10, "small ring", "LARGE", "1", "5-9"), (11, "small ring", "LARGE", "1", "5-9"), (12, "hot bolt", "SMALL", "2", "1-3"), (13, "rod", "SMALL", "2", "1-3")], "rec_id long, title string, journal string, volume string, pages string")
    written, stage = {}, op.staged

    def staged(df, tag):
        written[tag] = stage(df, tag)
        return written[tag]

    monkeypatch.setattr(op, "staged", staged)
    want = [(1, "body", 1, "1", "constructed", "1"), (1, "body", 2, "2", "exact", ""), (1, "body", 3, "3", "placeholder", ""), (1, "notes", 4, "9", "placeholder", ""), (2, "body", 1, "1,2", "exact", "")]
    full = source.join(catalog, "rec_id")
    assert rows(op.relink(groups, bibliography, source, full)) == want
    assert rows(op.relink(groups, bibliography, source, source, catalog=catalog)) == want
    assert sorted(r["text"] for r in written["relink-entries"].where("text is not null").collect()) == ["small ring 1"]
