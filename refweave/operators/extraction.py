"""What documents say: markers, typed citations, captions, callouts, headings and bibliography entries, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.functions import text as tx
from refweave.operators.folding import ordered_fold

#: What stands for a missing citation, whatever its case.
MISSING = r"(?i)\[CITATION\]|\[REF\]|\[\?\]|\[citation needed\]|\bXXX\b|\[#\]|<citation>|\[ *\]"
TYPED_YEAR = r"(?:18|19|20)\d\d"
CAPTION = r"^(Figure|Fig|Table|Box|Plate|Video|Appendix)\.?\s+([A-Z]?\d+(?:\.\d+)*)[.:]?\s*(.*)$"
CALLOUT = r"\b(?:Figures?|Figs?\.?|Tables?)\s+\d+(?:\.\d+)?(?:\s*(?:,|and|to|&|–|-)\s*\d+(?:\.\d+)?)*"

#: Labels at the start of a figure's paragraph, those of a caption, styles of superscript citations, and what says that a line of a reference list is furniture, or no section title.
FIGURE = r"(?i)^\s*(fig(?:ure)?\.?|table|box|plate|video|appendix)\s*(\d+[\w.-]*)"
LABEL = r"(?i)^\s*(?:fig(?:ure)?\.?|table|box|plate|video)\s*\d"
NEXT_LABEL = r"(\w)\s+(?:Fig(?:ure)?\.?|Table|Box|Plate|Video)\s*[0-9].*$"
SUPERSCRIPT_STYLES = ["citsup", "sup", "superscript", "footnotereference", "endnotebibliography", "endnotereference"]
FURNITURE = r"^(?:(?:CHAPTER|SECTION)\b|\d{3,4}(?:\.e\d+)?$)"
NO_TITLE = r"\b(?:and|for|with|the|of a)\b.*\b(?:fracture|injur)"


def missing_markers(paragraphs: DataFrame, pattern: str = MISSING) -> DataFrame:
    """Placeholders for citations, each with the sentence that holds it. `pattern` is any Java expression, such as one of the user's own."""
    found = paragraphs.select("doc_id", "para_idx", "text", F.posexplode(tx.hits(F.col("text"), pattern)).alias("n", "h"))
    return found.select("doc_id", "para_idx", "n", F.col("h.start").alias("start"), F.col("h.hit").alias("marker"), tx.sentence_at(F.col("text"), F.col("h.start")).alias("sentence"))


def temp_citations(paragraphs: DataFrame) -> DataFrame:
    """`{Author, Year #Rec}` with their parts."""
    pattern = r"\{([^{},]+),\s*(\d{4})\s*#(\d+)\}"
    found = paragraphs.select("doc_id", "para_idx", F.posexplode(tx.hits(F.col("text"), pattern)).alias("n", "h"))
    part = lambda i: F.regexp_extract("h.hit", pattern, i)
    return found.select("doc_id", "para_idx", "n", F.col("h.start").alias("start"), part(1).alias("author"), part(2).alias("year"), part(3).alias("recnum"))


def numbered_markers(paragraphs: DataFrame, bibliography: DataFrame) -> DataFrame:
    """`[[REF n]]`, `[n]` and `(n)`, leftmost first where they overlap; the last two only if the bibliography has one of their numbers. bibliography: doc_id, num."""
    from refweave.operators.citations import expanded_numbers

    pattern = r"\[\[REF\s+[\d,\s–-]+\]\]|\[\d[\d,\s–-]*\]|\(\d[\d,\s–-]*\)"
    found = paragraphs.select("doc_id", "para_idx", F.posexplode(tx.hits(F.col("text"), pattern)).alias("n", "h"))
    inner = F.regexp_extract("h.hit", r"(\d[\d,\s–-]*)", 1)
    kind = F.when(F.col("h.hit").startswith("[["), "ref").when(F.col("h.hit").startswith("["), "bracket").otherwise("paren")
    rows = found.select("doc_id", "para_idx", "n", F.col("h.start").alias("start"), kind.alias("kind"), F.col("h.hit").alias("raw"), expanded_numbers(inner).alias("nums"))
    known = bibliography.select("doc_id", F.col("num").cast("int").alias("num")).distinct().withColumn("listed", F.lit(True))
    by_number = rows.select("*", F.explode_outer("nums").alias("num")).join(known, ["doc_id", "num"], "left")
    marker = ["doc_id", "para_idx", "n", "start", "kind", "raw", "nums"]
    return by_number.groupBy(*marker).agg(F.bool_or(F.coalesce("listed", F.lit(False))).alias("listed")).where("kind = 'ref' or listed").drop("listed")


def typed_citations(paragraphs: DataFrame) -> DataFrame:
    """Pieces of parentheses that hold a year, cut at semicolons, with surname, year and the rest as a hint; pieces without a digit are dropped."""
    found = paragraphs.select("doc_id", "para_idx", F.posexplode(F.regexp_extract_all("text", F.lit(rf"\([^()]*\b{TYPED_YEAR}[^()]*\)"), F.lit(0))).alias("n", "raw"))
    pieces = found.select("doc_id", "para_idx", "n", F.posexplode(F.split(F.expr("substring(raw, 2, length(raw) - 2)"), ";")).alias("k", "piece")).where(F.col("piece").rlike(r"\d"))
    p = F.trim("piece")
    return pieces.select("doc_id", "para_idx", "n", "k", F.regexp_extract(p, r"([A-Z][A-Za-z'-]+)", 1).alias("surname"), tx.first_year(p).alias("year"), p.alias("hint"))


def superscript_citations(runs: DataFrame) -> DataFrame:
    """Superscript runs of digits and separators that are no exponents: not after a unit nor after a single letter that stands alone."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("doc_id", "para_idx").orderBy("run_idx")), F.lit(""))
    exponent = before.rlike(r"(?:^|[\s\d])(?:mm|cm|m|km|kg|s|[a-zA-Z])$")
    return runs.withColumn("exponent", exponent).where(F.col("vert_align").eqNullSafe("superscript") & F.col("text").rlike(r"^[\d,;\s–-]*\d[\d,;\s–-]*$") & ~F.col("exponent")).select("doc_id", "para_idx", "run_idx", "text")


def highlight_groups(runs: DataFrame) -> DataFrame:
    """Consecutive highlighted runs, bridged by separator-only runs between highlighted ones, as one citation."""
    order = Window.partitionBy("doc_id", "para_idx").orderBy("run_idx")
    lit = F.col("highlight").isNotNull()
    plain = ~lit & ~F.col("text").rlike(r"^[\s,;–-]*$")
    flagged = runs.withColumns({"lit": lit, "breaks": F.sum(plain.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    group = F.array_sort(F.collect_list(F.when(F.col("lit"), F.struct("run_idx", "text"))))
    out = flagged.groupBy("doc_id", "para_idx", "breaks").agg(F.min(F.when(F.col("lit"), F.col("run_idx"))).alias("first_run"), F.max(F.when(F.col("lit"), F.col("run_idx"))).alias("last_run"), F.array_join(group["text"], "|").alias("texts"))
    return out.where("first_run is not null").drop("breaks")


def caption_scan(paragraphs: DataFrame) -> DataFrame:
    """Captions with type and number: the first of each label in a document."""
    part = lambda i: F.regexp_extract("text", CAPTION, i)
    kind = F.when(part(1).isin("Figure", "Fig"), "Fig").otherwise(part(1))
    rows = paragraphs.where(F.col("text").rlike(CAPTION)).select("doc_id", "para_idx", kind.alias("fig_type"), part(2).alias("fig_num"), F.concat_ws(" ", kind, part(2)).alias("label"), part(3).alias("caption"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("para_idx"))).where("rn = 1").drop("rn")


def figure_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Every paragraph with a caption's label, an image or a caption style: doc_id, para_idx, fig_type (Image or Caption without a label), fig_num, caption (250 characters), has_image, style. paragraphs: doc_id, para_idx, text, style, has_image; nulls are empty."""
    text, style, image = F.trim(F.coalesce("text", F.lit(""))), F.coalesce("style", F.lit("")), F.coalesce("has_image", F.lit(False))
    word = F.regexp_replace(F.lower(F.regexp_extract(text, FIGURE, 1)), r"\.", "")
    kind = F.when(word.isin("fig", "figure"), "Figure").when(word != "", F.initcap(word)).when(image, "Image").otherwise("Caption")
    kept = paragraphs.where((word != "") | image | F.contains(F.lower(style), F.lit("caption")))
    return kept.select("doc_id", "para_idx", kind.alias("fig_type"), F.regexp_extract(text, FIGURE, 2).alias("fig_num"), F.substring(text, 1, 250).alias("caption"), image.alias("has_image"), style.alias("style"))


def image_captions(paragraphs: DataFrame, within: int = 7, more: int = 5) -> DataFrame:
    """doc_id, para_idx, caption: of each paragraph with an image the caption in the next `within` paragraphs: the first with a label, with up to `more` that follow until a blank one or a label; or the first of over 20 characters, alone; whichever is first. Empty
    without any. Two or more single capitals at the end (panels) are dropped. paragraphs: doc_id, para_idx, text, has_image; nulls are empty."""
    ahead = F.collect_list(F.trim(F.coalesce("text", F.lit("")))).over(Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(1, within + more))
    rows = paragraphs.select("doc_id", "para_idx", "has_image", ahead.alias("ahead")).where("has_image")
    at = lambda texts, cond: F.array_position(F.transform(texts, cond), F.lit(True)).cast("int")
    label = lambda x: x.rlike(LABEL)
    rows = rows.withColumn("hit", at(F.slice("ahead", 1, within), lambda x: label(x) | (F.char_length(x) > 20))).withColumn("first", F.coalesce(F.try_element_at("ahead", F.nullif("hit", F.lit(0))), F.lit("")))
    rows = rows.withColumn("rest", F.when(label(F.col("first")), F.slice("ahead", F.col("hit") + 1, F.lit(more))).otherwise(F.array().cast("array<string>"))).withColumn("stop", at("rest", lambda x: (x == "") | label(x)))
    parts = F.concat(F.array("first"), F.when(F.col("stop") > 0, F.slice("rest", F.lit(1), F.col("stop") - 1)).otherwise(F.col("rest")))
    caption = F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
    return rows.select("doc_id", "para_idx", F.regexp_replace(caption, r"(?:\s+[A-Z]){2,}$", "").alias("caption"))


def cut_caption(text: Column, most: int = 600) -> Column:
    """A caption up to the next label in it; a longer one than `most` up to its last sentence there, or, if that ends within 60 characters, cut."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(one, NEXT_LABEL, "$1")
    sentence = F.regexp_extract(F.substring(cut, 1, most), r"^(.*)\. ", 1)
    return F.when(F.char_length(cut) <= most, cut).when(F.char_length(sentence) > 60, F.concat(sentence, F.lit("."))).otherwise(F.substring(cut, 1, most))


def callouts(paragraphs: DataFrame) -> DataFrame:
    found = paragraphs.select("doc_id", "para_idx", F.posexplode(F.regexp_extract_all("text", F.lit(CALLOUT), F.lit(0))).alias("n", "callout"))
    return found.select("*", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n_in_doc"))


def effective_runs(runs: DataFrame) -> DataFrame:
    """The accept-all view: deleted and moved-away runs gone, inserted and moved-in ones kept."""
    return runs.where(~F.coalesce(F.col("tracked"), F.lit("none")).isin("del", "moveFrom"))


def keyword_filter(rows: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(keyword.lower())), F.lit(False))
    return rows.where(hit)


def page_filter(rows: DataFrame, spec: str, last: int) -> DataFrame:
    """Rows whose page a list such as `45-92,100` names, within 1..last. The list becomes ranges, so that files can be skipped by page."""
    keep = F.lit(False)
    for piece in spec.split(","):
        a, _, b = (x.strip() for x in piece.partition("-"))
        if a.isdigit() and (b.isdigit() or not b):
            keep = keep | F.col("page").between(max(1, int(a)), min(last, int(b or a)))
    return rows.where(keep)


def reference_search(citations: DataFrame, bibliography: DataFrame, keyword: str) -> DataFrame:
    """Bibliography entries that hold a keyword, whether they are cited, and where (the first two paragraphs)."""
    entries = keyword_filter(bibliography, ["text"], keyword)
    where = citations.groupBy("doc_id", "num").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    out = entries.join(where, ["doc_id", "num"], "left")
    return out.select("doc_id", "num", "text", F.col("at").isNotNull().alias("cited"), F.array_join(F.slice(F.col("at").cast("array<string>"), 1, 2), ",").alias("places"))


def printed_labels(headers: DataFrame) -> DataFrame:
    """Printed page number or `N.eM` reference page of a header, after chapter and figure references are stripped."""
    t = F.regexp_replace("header", r"(?i)\b(?:chapter|fig(?:ure)?|table)\.?\s+\d+(?:\.\d+)?", "")
    ref = F.regexp_extract(t, r"\b(\d+\.e\d+)\b", 1)
    return headers.select("doc_id", "page", F.when(ref != "", ref).otherwise(F.regexp_extract(t, r"(?:^|\s)(\d{1,4})(?:\s|$)", 1)).alias("label"))


def citation_mode(runs: DataFrame) -> DataFrame:
    """Documents with live fields are in record mode, others in superscript mode."""
    return runs.groupBy("doc_id").agg(F.when(F.bool_or(F.coalesce(F.contains("instr", F.lit("EN.CITE")), F.lit(False))), "record").otherwise("superscript").alias("mode"))


def document_modes(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, mode: record for documents with live fields, superscript for others that have runs, span for those of which only page layout is at hand. runs: doc_id, instr; spans: doc_id."""
    known = runs.select("doc_id", F.when(F.contains(F.coalesce("instr", F.lit("")), F.lit("EN.CITE")), 2).otherwise(1).alias("rank"))
    best = known.union(spans.select("doc_id", F.lit(0))).groupBy("doc_id").agg(F.max("rank").alias("rank"))
    return best.select("doc_id", F.element_at(F.array(F.lit("span"), F.lit("superscript"), F.lit("record")), F.col("rank") + 1).alias("mode"))


def run_numbers(runs: DataFrame) -> DataFrame:
    """doc_id, num: distinct citation numbers of runs that are superscript, directly or by a character style, and hold only digits and separators. Numbers are as written. runs: doc_id, text, vert_align, style."""
    raised = (F.coalesce("vert_align", F.lit("")) == "superscript") | F.lower(F.coalesce("style", F.lit(""))).isin(SUPERSCRIPT_STYLES)
    cited = runs.where(raised & F.col("text").rlike(r"^[\d,;\s–-]+$"))
    return cited.select("doc_id", F.explode(F.split("text", r"[,;\s–-]+")).alias("num")).where("num <> ''").distinct()


def body_numbers(paragraphs: DataFrame) -> DataFrame:
    """Citation numbers glued to a letter or to one of . , ) in published text."""
    found = paragraphs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z.,)](\d{1,3}(?:[,–-]\d{1,3})*)(?:[^\d.]|$)"), F.lit(1))).alias("x"))
    return found.select("doc_id", F.explode(F.split("x", "[,–-]")).alias("num")).select("doc_id", F.col("num").cast("int").alias("num")).distinct()


def video_index(figures: DataFrame) -> DataFrame:
    return figures.where("fig_type = 'Video'").select("doc_id", "label", F.concat(F.lit("PDF page "), F.col("para_idx").cast("string"), F.lit(", printed "), "fig_num").alias("place"))


def flat_bibliography(paragraphs: DataFrame) -> DataFrame:
    """Numbered entries of 15 characters or more: number, surname with its particles, last year; of duplicate numbers the last wins."""
    pattern = r"^(\d{1,3})[.)]?\s+(.{15,})$"
    rows = paragraphs.where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).cast("int").alias("num"), "para_idx", F.regexp_extract("text", pattern, 2).alias("body"))
    last = rows.groupBy("doc_id", "num").agg(F.max_by("body", "para_idx").alias("body"))
    surname = F.regexp_extract("body", r"^((?:(?:van|von|de|der|den|du|la|le|di|da)\s+)*[A-Za-zÀ-ž'-]+)", 1)
    return last.select("doc_id", "num", surname.alias("surname"), tx.last_year(F.col("body")).alias("year"), "body")


def sectioned_bibliography(paragraphs: DataFrame) -> DataFrame:
    """Entries after a `references` line, keyed by section: short lines without four digits open one."""
    order = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.col("text").rlike(r"^\d{1,3}[.\s]")
    after = paragraphs.withColumn("open", F.max((F.lower(F.trim("text")) == "references").cast("int")).over(order)).where("open = 1 and lower(trim(text)) <> 'references'")
    heading = ~entry & (F.char_length("text") < 45) & ~F.col("text").rlike(r"\d{4}")
    named = after.withColumn("section", F.coalesce(F.last_value(F.when(heading, tx.letters(F.col("text"))), True).over(order), F.lit("")))
    return named.where(entry).select("doc_id", "section", F.regexp_extract("text", r"^(\d{1,3})", 1).cast("int").alias("num"), F.trim(F.regexp_replace("text", r"^\d{1,3}[.\s]\s*", "")).alias("body"))


def bibliography_labels(entries: DataFrame, least: int = 15) -> DataFrame:
    """`section.num` where a document has several sections, else the number; texts of at most `least` characters are dropped."""
    kept = entries.where(F.char_length("body") > least)
    many = F.size(F.collect_set("section").over(Window.partitionBy("doc_id"))) > 1
    return kept.select("doc_id", "section", "num", F.when(many, F.concat_ws(".", F.col("section").cast("string"), F.col("num").cast("string"))).otherwise(F.col("num").cast("string")).alias("label"), "body")


def sequence_bibliography(paragraphs: DataFrame) -> DataFrame:
    """Entries accepted in sequence: the expected number; 1 again opens a section; a jump of up to 8; others belong to the entry before."""
    pattern = r"^[ \t]*(\d{1,3})[a-z]?[.)]?\s+[A-Za-z]"
    cand = paragraphs.where(F.col("text").rlike(pattern)).select("doc_id", "para_idx", F.regexp_extract("text", pattern, 1).cast("int").alias("n"))

    def step(state: tuple, row: tuple) -> tuple:
        section, want = state
        _, para, n = row
        if want <= 4000 and n == 1 and want > 1:
            return (section + 1, 2), (para, section + 1, n)
        if want <= 4000 and want <= n <= want + 8:
            return (section, n + 1), (para, section, n)
        return state, None

    return ordered_fold(cand.select("doc_id", "para_idx", "n"), ["doc_id"], ["para_idx"], (1, 1), step, "para_idx int, section int, num int")


def entry_spans(accepted: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The text of each accepted entry: its paragraph and those up to the next accepted one."""
    nxt = F.lead("para_idx").over(Window.partitionBy("doc_id").orderBy("para_idx"))
    spans = accepted.withColumn("next", nxt)
    marks = paragraphs.join(spans.select("doc_id", "para_idx", "section", "num"), ["doc_id", "para_idx"], "left")
    order = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("entry", F.sum(F.col("num").isNotNull().cast("int")).over(order)).where("entry > 0")
    whole = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return owned.groupBy("doc_id", "entry").agg(F.max("section").alias("section"), F.max("num").alias("num"), F.array_join(whole["text"], " ").alias("body"))


def bibliography_lines(texts: DataFrame) -> DataFrame:
    """`N. text` lines (8 to 200 characters); of each number the first."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pattern = r"^\s*(\d{1,3})[.)]\s*(.{8,200}?)\s*$"
    rows = lines.where(F.col("line").rlike(pattern)).select("doc_id", "line_no", F.regexp_extract("line", pattern, 1).cast("int").alias("num"), F.regexp_extract("line", pattern, 2).alias("body"))
    return rows.groupBy("doc_id", "num").agg(F.min_by("body", "line_no").alias("body"))


def wrapped_bibliography(lines: DataFrame, furniture: str = r"^(?:Page \d+|\d{1,4})$") -> DataFrame:
    """Wrapped lines joined to their entry; page furniture dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.where(~F.col("line").rlike(furniture)).withColumn("entry", F.sum(F.col("line").rlike(r"^\d{1,3}\.\s").cast("int")).over(order)).where("entry > 0")
    whole = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("doc_id", "entry").agg(F.array_join(whole["line"], " ").alias("body"))


def titled_bibliography(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, body: a wrapped list's entries, each with the lines that follow it, and the section titles before the first one. Blank lines, page numbers and running heads are dropped. A title is short, begins with a capital, has no digits and
    no full stop or comma at its end. lines: doc_id, line_no, line."""
    s = F.trim("line")
    start = r"^(\d{1,3}[a-z]?)\.\s+(.*)"
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.select("doc_id", "line_no", s.alias("s")).where((F.col("s") != "") & ~F.col("s").rlike(FURNITURE)).withColumn("entry", F.sum(F.col("s").rlike(start).cast("int")).over(order))
    title = (F.char_length("s") < 45) & ~F.col("s").rlike(r"\d") & F.col("s").rlike(r"^\p{Lu}") & (F.size(F.split("s", r"\s+")) <= 6) & ~F.col("s").rlike(r"[.,;]$") & ~F.lower("s").rlike(NO_TITLE)
    titles = kept.where((F.col("entry") == 0) & title).select("doc_id", "line_no", F.lit("section").alias("kind"), F.col("s").alias("body"))
    whole = F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("s", start, "$1. $2").alias("s"))))
    entries = kept.where("entry > 0").groupBy("doc_id", "entry").agg(F.min("line_no").alias("line_no"), F.array_join(whole["s"], " ").alias("body"))
    return titles.unionByName(entries.select("doc_id", "line_no", F.lit("entry").alias("kind"), "body"))


def parse_reference(references: DataFrame) -> DataFrame:
    """Vancouver references to their fields, once per distinct (surname, year, title key), with how often each occurs."""
    fields = ("authors", "title", "journal", "year", "volume", "issue", "spage", "epage")
    shape = r"^(.+?)\.\s+(.+?)\.\s+([^.]+)\.\s+(\d{4});(\d+)(?:\(([^)]*)\))?:(\d+)(?:-(\d+))?"
    # all groups of one match with a mark between them, or, of a body that has the mark, group by group
    at_once = F.split(F.regexp_replace("body", shape + r"[\s\S]*", "\x01".join(f"${i}" for i in range(1, 9))), "\x01")
    singly = F.array(*[F.regexp_extract("body", shape, i) for i in range(1, 9)])
    matched = references.select("body", F.when(F.contains("body", F.lit("\x01")), singly).otherwise(at_once).alias("m"))
    parts = matched.select("body", *[F.when(F.size("m") == 8, F.col("m")[i]).when(F.col("body").isNotNull(), "").alias(c) for i, c in enumerate(fields)])
    named = parts.withColumns({"n_authors": F.size(F.filter(F.split("authors", r",\s*"), lambda a: a != "")), "surname": F.regexp_extract("authors", r"^([^\s,]+)", 1), "title_key": F.substring(tx.signature(F.col("title")), 1, 40)})
    rest = ["authors", "n_authors", "title", "journal", "volume", "issue", "spage", "epage"]
    return named.groupBy("surname", "year", "title_key").agg(F.min(F.struct(*rest)).alias("r"), F.count(F.lit(1)).alias("n")).select("surname", "year", "title_key", "r.*", "n")


def reference_key(references: DataFrame) -> DataFrame:
    """(surname, year): the words before the initials, without spaces, apostrophes, hyphens and stops; the last year."""
    surname = F.regexp_replace(F.lower(F.regexp_extract("body", r"^([^\d,]*?)\s+[A-Z]{1,3}(?:,|\.|\s|$)", 1)), r"[\s'.-]", "")
    return references.select("doc_id", "num", surname.alias("surname"), tx.last_year(F.col("body")).alias("year"))


def reference_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos (from 1), body, year: the reference list among a document's paragraphs. It starts behind a heading (references or bibliography) or at the first numbered paragraph and takes all that follows, but headings and blank paragraphs;
    numbers go, and the year is the first of 1900 to 2099. paragraphs: doc_id, para_idx, text."""
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    text, number = F.trim("text"), r"^\d+[.)]\s+(.+)"
    heading = text.rlike(r"(?i)^(?:references?|bibliography)$")
    told = paragraphs.where(text != "").withColumns({"t": text, "heading": heading, "starts": heading | text.rlike(number)})
    after = told.withColumn("started", F.max(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("started = 1 and not heading")
    body = F.when(F.col("t").rlike(number), F.regexp_extract("t", number, 1)).otherwise(F.col("t"))
    return after.select("doc_id", F.row_number().over(order).cast("long").alias("pos"), body.alias("body"), F.regexp_extract(body, r"\b((?:19|20)\d\d)\b", 1).alias("year"))


def numbered_entries(paragraphs: DataFrame) -> DataFrame:
    """doc_id, num, body: paragraphs that begin with a number (a letter may follow it) and `.` or `)`, whole; of each number the last. paragraphs: doc_id, para_idx, text."""
    pattern = r"^(\d+[a-z]?)[.)]\s+.+"
    rows = paragraphs.select("doc_id", "para_idx", F.trim("text").alias("body")).where(F.col("body").rlike(pattern)).withColumn("num", F.regexp_extract("body", pattern, 1))
    return rows.groupBy("doc_id", "num").agg(F.max_by("body", "para_idx").alias("body"))


def reference_list(texts: DataFrame) -> DataFrame:
    """A text list: blocks between blank lines, of 20 characters or more, without their leading number, with their first year."""
    blocks = texts.select("doc_id", F.posexplode(F.split("text", r"\n{2,}")).alias("pos", "block")).where(F.char_length(F.trim("block")) >= 20)
    body = F.regexp_replace(F.trim("block"), r"^\d+[.)]\s*", "")
    return blocks.select("doc_id", "pos", body.alias("body"), tx.first_year(body).alias("year"))
