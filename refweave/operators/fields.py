"""Field codes in runs: nesting, payloads, damage counts and repairs.

runs: doc_id, pos (order in the document), n_begin, n_sep, n_end, text, instr, fld_data, xml_id, tracked. Windows are per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(order: str = "pos") -> Window:
    return Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def depth(runs: DataFrame) -> DataFrame:
    """Adds depth: begins minus ends so far, where an end outside of any field is ignored (a running sum reflected at zero)."""
    s = F.sum(F.col("n_begin") - F.col("n_end")).over(_upto())
    summed = runs.withColumn("_s", s)
    return summed.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(_upto()))).drop("_s")


def field_blocks(runs: DataFrame) -> DataFrame:
    """doc_id, block_idx, first_run, last_run, display: balanced blocks, nested ones within their outermost; an unterminated block runs to the end of the document."""
    d = depth(runs)
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(0))
    opened = d.withColumns({"before": before}).withColumn("opens", ((F.col("before") == 0) & (F.col("depth") > 0)).cast("int"))
    inside = opened.withColumn("block_idx", F.sum("opens").over(_upto())).where("depth > 0 OR before > 0")
    text = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return inside.groupBy("doc_id", "block_idx").agg(F.min("pos").alias("first_run"), F.max("pos").alias("last_run"), F.array_join(text["text"], "").alias("display"), (F.max_by("depth", "pos") > 0).alias("unterminated"))


def blob_bytes(blob: Column) -> Column:
    """A base64 blob without white space and with its padding mended, as bytes; null where it can't be decoded."""
    bare = F.regexp_replace(blob, r"\s", "")
    return F.try_to_binary(F.rpad(bare, (F.ceil(F.char_length(bare) / 4) * 4).cast("int"), "="), F.lit("base64"))


def decoded(blob: Column) -> Column:
    return F.decode(blob_bytes(blob), "utf-8")


def block_payloads(chunks: DataFrame) -> DataFrame:
    """doc_id, block_idx, payload: chunks of a block joined as bytes in order, decoded, each distinct payload once in order of its first chunk. chunks: doc_id, block_idx, part (which payload), k, data (base64)."""
    joined = chunks.groupBy("doc_id", "block_idx", "part").agg(F.array_sort(F.collect_list(F.struct("k", F.hex(blob_bytes(F.col("data"))).alias("b")))).alias("c"))
    texts = joined.select("doc_id", "block_idx", "part", F.decode(F.unhex(F.array_join("c.b", "")), "utf-8").alias("payload"))
    return texts.groupBy("doc_id", "block_idx", "payload").agg(F.min("part").alias("part"))


def claims(rows: DataFrame, keep: int = 300) -> DataFrame:
    """The text since the previous citation: its last two pieces between . ; : and at most `keep` trailing characters. rows: doc_id, pos, text, is_cite."""
    cites = F.sum(F.col("is_cite").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    grouped = rows.withColumn("cite_idx", F.coalesce(cites, F.lit(0)))
    text = F.array_sort(F.collect_list(F.when(~F.col("is_cite"), F.struct("pos", "text"))))
    g = grouped.groupBy("doc_id", "cite_idx").agg(F.trim(F.array_join(text["text"], " ")).alias("whole"), F.bool_or("is_cite").alias("cited")).where("cited")
    pieces = F.filter(F.split("whole", "[.;:]"), lambda x: F.trim(x) != "")
    last = F.array_join(F.transform(F.when(F.size(pieces) > 2, F.slice(pieces, F.size(pieces) - 1, 2)).otherwise(pieces), lambda x: F.trim(x)), ". ")
    return g.select("doc_id", "cite_idx", F.right(last, F.lit(keep)).alias("claim"))


def run_groups(runs: DataFrame, among: Column | None = None, separators: str = r"[\s,;–-]+") -> DataFrame:
    """Adjacent number runs joined across separators into one group; separators at the ends are trimmed. `among` says which number runs count (all by default); a separator run is all `separators`."""
    number, separator = F.col("text").rlike(r"^\s*\d+\s*$") & (F.coalesce(among, F.lit(False)) if among is not None else F.lit(True)), F.col("text").rlike(f"^{separators}$")
    classed = runs.withColumns({"num": number, "sep": separator})
    order = _upto()
    island = F.sum((~F.col("num") & ~F.col("sep")).cast("int")).over(order)
    held = classed.withColumn("island", island).where("num")
    nums = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return held.groupBy("doc_id", "island").agg(F.min("pos").alias("first_run"), F.max("pos").alias("last_run"), F.array_join(F.transform(nums["text"], lambda x: F.trim(x)), ",").alias("numbers")).drop("island")


def styled_groups(runs: DataFrame, style: str = "citsup") -> DataFrame:
    """Number runs of a citation style, joined across commas and semicolons."""
    return run_groups(runs, F.col("style") == style, r"\s*[,;]\s*")


def superscript_groups(runs: DataFrame) -> DataFrame:
    """Superscript number runs, joined across separators and dashes."""
    return run_groups(runs, F.col("vert_align") == "superscript")


def cued_groups(runs: DataFrame, style: str = "crossref") -> DataFrame:
    """Number runs of a cross-reference style, or in a paragraph whose text so far has a cue (Reference, References or See)."""
    so_far = Window.partitionBy("doc_id", "para_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cued = runs.withColumn("cued", F.coalesce(F.max(F.col("text").rlike(r"\b(?:References?|See)\b").cast("int")).over(so_far), F.lit(0)) > 0)
    return run_groups(cued, (F.col("style") == style) | F.col("cued"))


def dedupe_ids(rows: DataFrame) -> DataFrame:
    """Second and later occurrences of an id get max + 1, max + 2, ... in order. rows: doc_id, pos, id (integer)."""
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos")) > 1
    marked = rows.withColumns({"again": again, "top": F.max("id").over(Window.partitionBy("doc_id"))})
    n = F.sum(F.col("again").cast("int")).over(_upto())
    return marked.select("doc_id", "pos", F.col("id").alias("old"), F.when(F.col("again"), F.col("top") + n).otherwise(F.col("id")).alias("new"))


def concatenated_numbers(runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Where a run ends with x and the next starts with y for one of the (x, y), y is stripped there."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("pos"))
    held = runs.withColumn("before", before)
    hit = [(F.col("before").endswith(x) & F.col("text").startswith(y), len(y)) for x, y in pairs]
    cut = F.lit(0)
    for h, n in hit:
        cut = F.when(F.coalesce(h, F.lit(False)) & (cut == 0), n).otherwise(cut)
    return held.withColumn("cut", cut).where("cut > 0").select("doc_id", "pos", "text", F.expr("substring(text, cut + 1)").alias("fixed"))


def orphan_numbers(runs: DataFrame, superscript_only: bool = True) -> DataFrame:
    """Digit-only runs at depth 0 in paragraphs that hold a citation field."""
    d = depth(runs)
    held = d.withColumn("has", F.bool_or(F.coalesce(F.contains("instr", F.lit("EN.CITE")), F.lit(False))).over(Window.partitionBy("doc_id", "para_idx")))
    out = held.where((F.col("depth") == 0) & (F.col("n_end") == 0) & F.col("has") & F.col("text").rlike(r"^[\d,\s]*\d[\d,\s]*$"))
    return (out.where(F.col("vert_align").eqNullSafe("superscript")) if superscript_only else out).select("doc_id", "pos", "text")


def health_counts(runs: DataFrame) -> DataFrame:
    """Per document: fields in all, empty ones and data ones, blobs, visible and hidden records, begins, separators and ends, tracked changes."""
    seen = F.array_compact(F.collect_set(F.nullif(F.regexp_extract("instr", r"<RecNum>(\d+)</RecNum>", 1), F.lit(""))))
    blobs = F.array_compact(F.collect_set(F.nullif(F.regexp_extract("blob_text", r"<RecNum>(\d+)</RecNum>", 1), F.lit(""))))
    has = lambda s: F.coalesce(F.contains("instr", F.lit(s)), F.lit(False))
    g = runs.withColumn("blob_text", decoded(F.col("fld_data"))).groupBy("doc_id").agg(
        F.count_if(has("EN.CITE")).alias("total_fields"), F.count_if(has("EN.CITE.DATA")).alias("data_fields"), F.count_if(F.trim("instr") == "ADDIN EN.CITE").alias("empty_fields"), F.count("fld_data").alias("blobs"), seen.alias("v"), blobs.alias("b"),
        F.sum("n_begin").alias("begins"), F.sum("n_sep").alias("seps"), F.sum("n_end").alias("ends"), F.count_if(F.col("tracked") != "none").alias("tracked_runs"),
    )
    return g.select("doc_id", "total_fields", "data_fields", "empty_fields", "blobs", F.size("v").alias("visible_refs"), F.size(F.array_except("b", "v")).alias("hidden_refs"), "begins", "seps", "ends", "tracked_runs")


def merge_damage(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """health_counts, and what a merge damages: whether begins, separators and ends balance, insertions and deletions, superscript numbers, bibliography entries and those lost (without a superscript number),
    ids that occur twice, notes referred to, and comment marks. runs: also vert_align, xml_id, note_ref, comment_mark; entries: doc_id, num."""
    tracked = lambda *k: F.count_if(F.col("tracked").isin(*k))
    per = runs.groupBy("doc_id").agg(tracked("ins", "moveTo").alias("ins_count"), tracked("del", "moveFrom").alias("del_count"), F.count_distinct("note_ref").alias("note_refs"), F.count("comment_mark").alias("comment_marks"))
    again = runs.where("xml_id is not null").groupBy("doc_id", "xml_id").count().where("count > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("dup_ids"))
    pieces = F.explode(F.split(F.trim("text"), r"[,;\s]+"))
    above = runs.where("vert_align = 'superscript'").select("doc_id", pieces.alias("p")).select("doc_id", F.regexp_replace("p", r"\.+$", "").alias("p")).where(F.col("p").rlike(r"^\d+$")).select("doc_id", F.col("p").cast("long").alias("num")).distinct()
    listed = entries.select("doc_id", F.col("num").cast("long").alias("num")).distinct()
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    counts = health_counts(runs).join(per, "doc_id")
    for df, name in ((again.select("doc_id", "dup_ids"), None), (above, "cited_count"), (listed, "bib_count"), (listed.join(above, ["doc_id", "num"], "left_anti"), "lost_in_merge")):
        counts = counts.join(n(df, name) if name else df, "doc_id", "left")
    return counts.fillna(0).withColumn("balanced", (F.col("begins") == F.col("seps")) & (F.col("seps") == F.col("ends")))


def orphan_comments(marks: DataFrame, comment_docs: DataFrame) -> DataFrame:
    """doc_id, orphan_comments: comment marks in documents that have no comment part."""
    return marks.join(comment_docs, "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphan_comments"))


def health_issues(counts: DataFrame) -> DataFrame:
    """issues: one row per document and rule that fails. counts: health_counts joined with orphans, garbled, dup_ids, orphan_comments."""
    rules = [("broken_fields", "error", True, F.col("empty_fields") + F.col("data_fields")), ("hidden_refs", "error", True, F.col("hidden_refs")), ("orphan_superscripts", "warning", True, F.col("orphans")), ("garbled_figs", "warning", True, F.col("garbled")), ("dup_ids", "error", True, F.col("dup_ids")),
             ("orphan_comments", "warning", True, F.col("orphan_comments")), ("unbalanced_fields", "error", False, F.when((F.col("begins") != F.col("ends")) | (F.col("begins") != F.col("seps")), F.greatest(F.lit(1), F.abs(F.col("begins") - F.col("ends")))).otherwise(0))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("issue_id"), F.lit(s).alias("severity"), n.cast("long").alias("n"), F.lit(f).alias("fixable")) for i, s, f, n in rules]))
    return counts.select("doc_id", rows.alias("r")).select("doc_id", "r.*").where("n > 0")


def _instruction(payload: Column) -> Column:
    out = F.regexp_replace(payload, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return F.concat(F.lit(" ADDIN EN.CITE "), out)


def restore_fields(runs: DataFrame, ahead: int = 2000, behind: int = 500) -> DataFrame:
    """doc_id, pos, pattern, blob_pos, instr of the fields whose instruction is restored from a blob (distances in characters of text):

    A: an empty EN.CITE instruction, from the next blob, at most `ahead` on; B: an EN.CITE.DATA instruction, likewise (of several fields before one blob, the first within reach takes it);
    B-reverse: an EN.CITE.DATA instruction that B leaves, from the blob before it, at most `behind` back, if that holds records (of several after one blob, the first takes it);
    C: a blob with a record that no instruction shows, restored or not, and no earlier blob holds: a field of its own, before the blob's run.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    at = F.coalesce(F.sum(F.char_length("text")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.when(F.trim("instr") == "ADDIN EN.CITE", "A").when(F.trim("instr") == "ADDIN EN.CITE.DATA", "B")
    placed = runs.select("doc_id", "pos", "text", "instr", "fld_data", at.alias("at"), kind.alias("kind"))
    blob = F.when(F.col("fld_data").isNotNull(), F.struct("pos", "at", "fld_data"))
    seen = placed.withColumns({"next": F.first(blob, ignorenulls=True).over(doc.rowsBetween(1, Window.unboundedFollowing)), "last": F.last(blob, ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))}).where("kind is not null")
    first = lambda df, c: df.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "kind", f"{c}.pos").orderBy("pos"))).where("rn = 1")
    part = lambda df, c, name: df.select("doc_id", "pos", name.alias("pattern"), F.col(f"{c}.pos").alias("blob_pos"), decoded(F.col(f"{c}.fld_data")).alias("payload")).where("payload is not null")
    ahead_of = part(first(seen.where(F.col("next.at") - F.col("at") <= ahead), "next"), "next", F.col("kind"))
    left = seen.where("kind = 'B'").join(ahead_of.where("pattern = 'B'").select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
    behind_of = part(first(left.where(F.col("at") - F.col("last.at") <= behind), "last"), "last", F.lit("B-reverse")).where(F.contains("payload", F.lit("<EndNote>")))
    found = ahead_of.union(behind_of)
    records = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"<RecNum>(\d+)</RecNum>"), F.lit(1)))
    shown = runs.where("instr is not null").select("doc_id", records("instr").alias("rec")).union(found.select("doc_id", records("payload").alias("rec"))).distinct()
    blobs = runs.where("fld_data is not null").select("doc_id", "pos", decoded(F.col("fld_data")).alias("payload")).where(F.contains("payload", F.lit("<EndNote>")))
    held = blobs.select("doc_id", "pos", records("payload").alias("rec")).groupBy("doc_id", "rec").agg(F.min("pos").alias("pos")).join(shown, ["doc_id", "rec"], "left_anti").select("doc_id", "pos").distinct()
    hidden = blobs.join(held, ["doc_id", "pos"], "left_semi").select("doc_id", "pos", F.lit("C").alias("pattern"), F.col("pos").alias("blob_pos"), "payload")
    return found.union(hidden).select("doc_id", "pos", "pattern", "blob_pos", _instruction(F.col("payload")).alias("instr"))


def insert_separators(runs: DataFrame) -> DataFrame:
    """A generated separator run, half a place after its begin, for each top-level block without one."""
    d = depth(runs)
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(0))
    opened = d.withColumn("before", before).withColumn("opens", ((F.col("before") == 0) & (F.col("depth") > 0)).cast("int"))
    blocks = opened.withColumn("block_idx", F.sum("opens").over(_upto())).where("depth > 0 OR before > 0").groupBy("doc_id", "block_idx").agg(F.min("pos").alias("first"), F.sum("n_sep").alias("seps"))
    return blocks.where("seps = 0").select("doc_id", (F.col("first") + F.lit(0.5)).alias("pos"), F.lit("separate").alias("kind"))


def accept_changes(runs: DataFrame) -> DataFrame:
    """Deleted runs go unless they belong to a citation; inserted ones lose their mark."""
    cite = F.coalesce(F.contains("instr", F.lit("EN.CITE")), F.lit(False)) | F.col("fld_data").isNotNull()
    return runs.where(~F.col("tracked").isin("del", "moveFrom") | cite).withColumn("tracked", F.lit("none"))


def merge_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: citations before and after, and the records lost. Both: doc_id, recnum."""
    a = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("before"), F.collect_set("recnum").alias("x"))
    b = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("after"), F.collect_set("recnum").alias("y"))
    lost = F.array_sort(F.array_except("x", F.coalesce("y", F.array().cast("array<string>"))))
    return a.join(b, "doc_id", "left").select("doc_id", "before", F.coalesce("after", F.lit(0)).cast("long").alias("after"), F.array_join(lost, ",").alias("lost"))


def build_payloads(refs: DataFrame) -> DataFrame:
    """Citation payloads per group, base64: a Cite element per reference, the display text in the first alone. refs: doc_id, group_order, ref_pos, author, year, recnum, display."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = F.when(F.col("ref_pos") == 1, F.concat(F.lit("<DisplayText>"), esc("display"), F.lit("</DisplayText>"))).otherwise("")
    cite = F.concat(F.lit("<Cite><Author>"), esc("author"), F.lit("</Author><Year>"), "year", F.lit("</Year><RecNum>"), "recnum", F.lit("</RecNum>"), shown, F.lit("</Cite>"))
    g = refs.groupBy("doc_id", "group_order").agg(F.array_sort(F.collect_list(F.struct("ref_pos", cite.alias("x")))).alias("c"))
    payload = F.concat(F.lit("<EndNote>"), F.array_join("c.x", ""), F.lit("</EndNote>"))
    return g.select("doc_id", "group_order", payload.alias("payload"), F.translate(F.base64(F.encode(payload, "utf-8")), "\r\n", "").alias("blob"))


def drop_orphan_comments(marks: DataFrame, comment_docs: DataFrame) -> DataFrame:
    """Marks of documents that have no comment part: these go."""
    return marks.join(comment_docs, "doc_id", "left_anti")
