"""Entity resolution and similarity: library matching, TF-IDF lists, set keys, paragraph signatures, claims in text.

Nothing is compared with everything: pairs meet on blocking keys or shared terms. Terms and keys that many rows share are
joined by rows, which adaptive execution splits; counts are summed before they are shuffled.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.functions import text as tx
from refweave.functions.similarity import PlacedText, best_window, seq_ratio
from refweave.operators import ranking
from refweave.operators.folding import ordered_fold
from refweave.sources.staging import staged


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer word: a stand-in, of its own scale, for a matching-blocks ratio."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def _starts(word: Column, prefix: int, own: str, other: str) -> Column:
    """Keys on which two words meet of which one begins with the other's prefix: the prefix, the word itself where it is shorter, and its shorter prefixes. The marks `own` and `other` change places on the other side."""
    short = F.when(F.char_length(word) < prefix, F.array(F.concat(F.lit(own), word))).otherwise(F.array().cast("array<string>"))
    shorter = F.transform(F.sequence(F.lit(1), F.lit(prefix - 1)), lambda i: F.concat(F.lit(other), F.substring(word, F.lit(1), i)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.substring(word, 1, prefix))), short, shorter))


def grams(word: Column) -> Column:
    """The pairs of neighbouring characters of a word with a mark on either side, each with its occurrence number."""
    padded = F.concat(F.lit("\x02"), word, F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(word) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def _least_shared(a: Column, b: Column, like: float, similarity: str) -> Column:
    """How many grams words of a and b characters share at least if they are alike; null if they can't be.

    An edit takes two grams at most. In the matching-blocks ratio m characters match, in one block more than there are characters that don't, at most, and a block of n characters, the marks included, has n - 1 grams.
    """
    if similarity == "sequence":
        m = F.ceil((a + b) * F.lit(like / 2) - 1e-9)
        return F.when(m <= F.least(a, b), 3 * m - a - b + 1)
    edits = F.floor(F.greatest(a, b) * F.lit(1 - like) + 1e-9)
    return F.when(F.abs(a - b) <= edits, F.greatest(a, b) + 1 - 2 * edits)


def alike_pairs(left: DataFrame, right: DataFrame, like: float, similarity: str = "edits") -> DataFrame:
    """sl, ll of all distinct names with a likeness of `like` or more (above 2/3), and some that have less: those that share as many grams as such names do. left: sl; right: ll.

    Names meet on their rarest grams: of n grams of which t must be shared, on the n - t + 1 rarest, t being the least over all lengths that the other name may have.
    """
    sides = [df.select(F.col(c).alias("name")).where("name <> ''").distinct().select(F.lit(i).alias("side"), "name", grams(F.col("name")).alias("grams")) for i, (df, c) in enumerate(((left, "sl"), (right, "ll")))]
    every = staged(sides[0].unionByName(sides[1]), "names")
    counts = every.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = every.select("side", "name", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("side", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("grams"))
    size = F.char_length("name")
    lengths = F.sequence(F.greatest(F.lit(1), F.floor(size * F.lit(like * like)).cast("int")), F.ceil(size / F.lit(like * like)).cast("int"))
    least = F.array_min(F.filter(F.transform(lengths, lambda n: _least_shared(size, n, like, similarity)), lambda t: t.isNotNull()))
    keyed = staged(ranked.withColumn("rare", F.slice("grams", F.lit(1), (F.size("grams") - F.greatest(least, F.lit(1)) + 1).cast("int"))), "name-grams")
    of = lambda side, name, mine: keyed.where(F.col("side") == side).select(F.col("name").alias(name), F.col("grams").alias(mine), F.explode("rare").alias("gram"))
    met = of(0, "sl", "a").join(of(1, "ll", "b"), "gram")
    enough = F.size(F.array_intersect("a", "b")) >= _least_shared(F.char_length("sl"), F.char_length("ll"), like, similarity)
    return met.where(enough).select("sl", "ll").distinct()


def name_pairs(refs: DataFrame, library: DataFrame, prefix: int, like: float, similarity: str = "edits") -> DataFrame:
    """sl, ll, ratio, starts of distinct names that are alike or of which one begins with the other's prefix, all of them. Pairs are made of names, not of rows."""
    a = refs.select("sl").where("sl <> ''").distinct().select("sl", F.explode(_starts(F.col("sl"), prefix, "s:", "t:")).alias("key"))
    b = library.select("ll").where("ll <> ''").distinct().select("ll", F.explode(_starts(F.col("ll"), prefix, "t:", "s:")).alias("key"))
    starts = F.startswith("ll", F.substring("sl", 1, prefix)) | F.startswith("sl", F.substring("ll", 1, prefix))
    pairs = a.join(b, "key").select("sl", "ll").union(alike_pairs(refs, library, like, similarity)).distinct()
    scored = pairs.select("sl", "ll", (seq_ratio if similarity == "sequence" else likeness)(F.col("sl"), F.col("ll")).alias("ratio"), starts.alias("starts"))
    return staged(scored.where((F.col("ratio") >= like) | F.col("starts")), "name-pairs")


#: What scoring asks of a reference and of a record; made once for each, before they are paired.
SAID = ("found", "numbers")
RECORD = ("title_terms", "journal_terms", "volume", "page_numbers")


def _hashed(values: Column) -> Column:
    """Hashes of an array's values: sets of numbers are compared much faster than sets of strings."""
    return F.transform(values, lambda v: F.xxhash64(v))


def said_parts(hint: Column) -> list[Column]:
    """SAID of a reference's hint."""
    return [_hashed(tx.terms(hint)).alias("found"), _hashed(F.regexp_extract_all(hint, F.lit(r"\d+"), F.lit(0))).alias("numbers")]


def record_parts(authors: bool = False) -> list[Column]:
    """RECORD (and author_terms) of columns title, journal, volume, pages (and authors)."""
    terms = lambda c: _hashed(tx.terms(F.coalesce(c, F.lit(""))))
    pages = _hashed(F.regexp_extract_all(F.coalesce("pages", F.lit("")), F.lit(r"\d+"), F.lit(0)))
    own = [terms(F.col("title")).alias("title_terms"), terms(F.col("journal")).alias("journal_terms"), F.when(F.col("volume").isNotNull(), F.xxhash64("volume")).alias("volume"), pages.alias("page_numbers")]
    return own + ([terms(F.array_join("authors", " ")).alias("author_terms")] if authors else [])


def _over(c: str) -> Column:
    """How many of a record's terms the hint has."""
    return (F.size(c) - F.size(F.array_except(F.col(c), F.col("found")))).cast("double")


def _scored(words: Column, of_authors: Column | None, hits: Column) -> Column:
    score = words + 0.5 * F.least(hits, F.lit(2))
    return score if of_authors is None else score + 0.6 * of_authors


def _volume_hits() -> Column:
    return F.coalesce(F.array_contains("numbers", F.col("volume")).cast("int"), F.lit(0))


def content_score(authors: bool = False, pages: bool = True) -> Column:
    """Words of title and journal found in the hint, 0.6 for each author's, and 0.5 for each of its numbers that is the volume or a page, at most two of them. Of columns SAID and RECORD. Without `pages`, as if no page were found."""
    hits = _volume_hits()
    if pages:
        hits = hits + F.size(F.filter("page_numbers", lambda p: F.array_contains("numbers", p)))
    return _scored(_over("title_terms") + _over("journal_terms"), _over("author_terms") if authors else None, hits)


def best_two(pairs: DataFrame, key: str) -> DataFrame:
    """key, n (its candidates), top (score and rec_id of the best; the least id on ties), second (the next best's score), first (the least rec_id). pairs: key, rec_id, score.

    Candidates of one score are counted before anything is shuffled; a key then has as many rows as there are different scores, which are small counts.
    """
    scores = pairs.groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id"))
    listed = scores.groupBy(key).agg(F.sum("n").alias("n"), F.min("rec_id").alias("first"), F.sort_array(F.collect_list(F.struct("score", "rec_id", "n")), False).alias("by_score"))
    return listed.select(key, "n", *_two_of("by_score"), "first")


def _two_of(by_score: str) -> list[Column]:
    """top and second of an array of score, rec_id and n, best first."""
    best, next_best = F.col(by_score)[0], F.try_element_at(by_score, F.lit(2))
    return [F.struct(best["score"].alias("score"), best["rec_id"].alias("rec_id")).alias("top"), F.when(best["n"] > 1, best["score"]).otherwise(next_best["score"]).alias("second")]


def best_records(asked: DataFrame, records: DataFrame, names: DataFrame | None = None, authors: bool = False) -> DataFrame:
    """What `best_two` says of the content scores of each reference with all records of its name and year, without making these pairs. asked: ident, name, year, SAID; records: name, year, rec_id, RECORD (and author_terms); names: name, called (under which records of that name stand), or nothing.

    References that have the same words meet records that have the same words and volume, each kind once, as if no number were found. Of such a list the two best scores remain, and of each volume's part of it. A number that is a volume
    then moves so many records from one score to a higher one, and a page moves one record; only those numbers meet. Moved records rise, so the two best are among the two best of before and the moved ones; a score whose records
    have all moved counts none. A score that is the best has lost none of its records, so its least id stands.
    """
    words = lambda c: [F.size(c), F.col(c)]
    by = ["title_terms", "journal_terms", "volume"] + (["author_terms"] if authors else [])
    called = (lambda df: df) if names is None else (lambda df: df.withColumnRenamed("name", "called").join(names, "called").drop("called"))
    asked = staged(asked.withColumn("f", F.xxhash64(*words("found"))), "asked")
    kinds = called(records.groupBy("name", "year", *by).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id")))
    of_authors = _over("author_terms") if authors else F.lit(0.0)
    met = asked.groupBy("f", "name", "year").agg(F.first("found").alias("found")).join(kinds, ["name", "year"])
    met = met.select("f", "name", "year", "volume", (_over("title_terms") + _over("journal_terms")).alias("words"), of_authors.alias("of_authors"), "n", "rec_id")
    met = staged(met.groupBy("f", "name", "year", "volume", "words", "of_authors").agg(F.sum("n").alias("n"), F.min("rec_id").alias("rec_id")), "kinds-met")
    score = lambda hits: _scored(F.col("words"), F.col("of_authors") if authors else None, F.lit(hits))

    def two(df: DataFrame, *keys: str) -> DataFrame:
        """Of each key all records, the least id, and the records of the two best scores."""
        scores = df.groupBy(*keys, score(0).alias("score"), score(1).alias("risen")).agg(F.sum("n").alias("n"), F.min("rec_id").alias("rec_id"))
        if "volume" not in keys:  # scores of different words and authors may be equal
            scores = scores.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.min("rec_id").alias("rec_id"), F.min("risen").alias("risen"))
        nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("score").desc()))
        every = scores.select("*", nth.alias("nth"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"), F.min("rec_id").over(Window.partitionBy(*keys)).alias("first"))
        return every.where("nth <= 2").groupBy(*keys).agg(F.first("total").alias("total"), F.first("first").alias("first"), F.collect_list(F.struct("score", "risen", "n", "rec_id")).alias("best"))

    place = ["f", "name", "year"]
    plain = asked.select("ident", *place).join(two(met, *place), place)
    numbers = asked.select("ident", *place, F.explode(F.array_distinct("numbers")).alias("volume"))
    moved = lambda x: F.array(F.struct(x["score"].alias("score"), (-x["n"]).alias("n"), F.lit(None).cast(kind).alias("rec_id")), F.struct(x["risen"].alias("score"), x["n"].alias("n"), x["rec_id"].alias("rec_id")))
    kind = records.schema["rec_id"].dataType.simpleString()
    volumes = numbers.join(two(met.where("volume is not null"), *place, "volume"), [*place, "volume"])
    paged = called(records.select("name", "year", "rec_id", F.explode(F.array_distinct("page_numbers")).alias("volume"))).distinct()
    on_pages = numbers.drop("f").join(paged, ["name", "year", "volume"]).select("ident", "rec_id").distinct()
    held = on_pages.join(asked.select("ident", "name", "year", *SAID), "ident").join(called(records).drop("n"), ["name", "year", "rec_id"])
    pages = held.select("ident", "rec_id", F.lit(1).cast("long").alias("n"), content_score(authors, pages=False).alias("score"), content_score(authors).alias("risen"))
    none = F.lit(None).cast("long").alias("total"), F.lit(None).cast(kind).alias("first")
    rows = (
        plain.select("ident", "total", "first", F.explode(F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["n"].alias("n"), x["rec_id"].alias("rec_id")))).alias("x"))
        .unionByName(volumes.select("ident", *none, F.explode(F.flatten(F.transform("best", moved))).alias("x")))
        .unionByName(pages.select("ident", *none, F.explode(moved(F.struct("score", "risen", "n", "rec_id"))).alias("x")))
    )
    scores = rows.repartition("ident").groupBy("ident", F.col("x.score").alias("score")).agg(F.sum("x.n").alias("n"), F.min("x.rec_id").alias("rec_id"), F.max("total").alias("total"), F.min("first").alias("first"))
    listed = scores.groupBy("ident").agg(F.max("total").alias("n"), F.min("first").alias("first"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("score", "rec_id", "n"))), False).alias("by_score"))
    return listed.select("ident", "n", *_two_of("by_score"), "first")


def _decided() -> Column:
    top, second = F.col("top.score"), F.col("second")
    return F.when(F.col("n") == 1, "exact").when((top >= 2.0) & (top - second >= 1.5), "exact").when((top >= 1.0) & (top > second), "near").otherwise("ambiguous")


def match_library(refs: DataFrame, library: DataFrame, like: float = 0.85, far_like: float = 0.8, similarity: str = "edits") -> DataFrame:
    """ref_id, rec_id, score, match_kind (exact, near, ambiguous, none). refs: ref_id, surname, year, hint; library: rec_id, surname, year, title, journal, volume, pages, authors.

    Candidates have the same year and a surname alike or sharing a prefix of 4. One is exact; of several, what the hint holds of title, journal, authors,
    volume and pages decides. Without candidates, the whole library is searched for a like surname or a shared prefix of 5.
    Surnames of any length are compared completely, by edits or, with similarity="sequence", by the matching-blocks ratio. References that say the same are matched once.
    """
    r = staged(refs.select("ref_id", F.lower(F.coalesce("surname", F.lit(""))).alias("sl"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce("hint", F.lit("")).alias("hint")).withColumn("ident", F.xxhash64("sl", "year", "hint")), "refs")
    says = r.select("ident", "sl", "year", "hint").dropDuplicates(["ident"])
    lib = library.withColumn("ll", F.lower("surname"))
    recs = staged(lib.select(F.col("ll").alias("name"), "year", "rec_id", *record_parts(authors=True)), "library-parts")
    named = says.where("year <> ''").select("ident", F.col("sl").alias("name"), "year", *said_parts(F.col("hint")))
    names = name_pairs(r, lib, 4, like, similarity).select(F.col("sl").alias("name"), F.col("ll").alias("called"))
    kinds = staged(best_records(named, recs, names, authors=True).withColumn("match_kind", _decided()), "ref-candidates")
    unclear = F.col("match_kind") == "ambiguous"
    near = kinds.select("ident", F.when(unclear, F.col("first")).otherwise(F.col("top.rec_id")).alias("rec_id"), F.when(F.col("n") == 1, 1.0).when(unclear, 0.0).otherwise(F.col("top.score")).alias("score"), "match_kind")
    rest = staged(says.where("sl <> ''").join(kinds.select("ident"), "ident", "left_anti"), "refs-without-candidates")
    first = lib.groupBy("ll").agg(F.min("rec_id").alias("rec_id"))
    starts = F.substring("sl", 1, 5) == F.substring("ll", 1, 5)
    close = name_pairs(rest, lib, 5, far_like, similarity).where((F.col("ratio") >= far_like) | starts).join(first, "ll")
    value = F.col("ratio") + F.when(starts, 0.2).otherwise(0.0) + 0.2 + F.when(F.contains(F.lower("hint"), F.substring("ll", 1, 4)), 0.3).otherwise(0.0)
    far = rest.join(close, "sl").select("ident", "rec_id", value.alias("score"))
    best = far.groupBy("ident").agg(F.min(F.struct((-F.col("score")).alias("s"), "rec_id")).alias("b")).where(F.col("b.s") <= -0.9).select("ident", "b.rec_id", (-F.col("b.s")).alias("score"), F.lit("near").alias("match_kind"))
    return r.select("ref_id", "ident").join(near.unionByName(best), "ident", "left").select("ref_id", "rec_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("match_kind", F.lit("none")).alias("match_kind"))


def resolve_cited(identities: DataFrame, records: DataFrame) -> DataFrame:
    """identity (ident, surname, year, hint) to embedded record (rec_id, surname, year, title, journal, volume, pages): exact, near or ambiguous (the top-scored, the first on ties), or none."""
    said = identities.select("ident", "surname", "year", "hint", F.xxhash64("surname", "year", "hint").alias("says"))
    asked = said.select("says", "surname", "year", "hint").dropDuplicates(["says"]).select(F.col("says").alias("ident"), F.col("surname").alias("name"), "year", *said_parts(F.col("hint")))
    held = staged(records.dropDuplicates(["surname", "year", "rec_id"]).select("rec_id", F.col("surname").alias("name"), "year", *record_parts()), "record-parts")
    out = best_records(asked, held).select(F.col("ident").alias("says"), F.col("top.rec_id").alias("rec_id"), F.col("top.score").alias("score"), _decided().alias("match_kind"))
    return said.select("ident", "says").join(out, "says", "left").drop("says").fillna({"match_kind": "none"})


def relink(groups: DataFrame, bibliography: DataFrame, source_groups: DataFrame, records: DataFrame, construct: bool = True, catalog: DataFrame | None = None) -> DataFrame:
    """doc_id, part, group_order, numbers, kind, verify for groups of citation numbers, part by part (body, notes).

    groups: doc_id, part, group_order, k, num; bibliography: doc_id, num, surname, year, text; source_groups: doc_id, group_id, surname, year (what the intact version cites together);
    records: doc_id, surname, year, rec_id, title, journal, volume, pages (embedded there; with `catalog`, which has the last four by rec_id, not needed there). A group whose numbers are all known is exact if its identities are a source group's and none of them
    has several records; else constructed if each has a record (verify: the numbers whose record stays ambiguous); the others become placeholders.
    """
    name = F.concat_ws("|", F.lower("surname"), "year").alias("ident")
    bib = bibliography.select("doc_id", "num", name, "text")
    # an identity of one record needs no score: only those of several, and the entries that say them, go on with their texts
    about = [] if catalog is not None else ["title", "journal", "volume", "pages"]
    each = records.select("doc_id", name, "rec_id", *about).repartition("doc_id").dropDuplicates(["doc_id", "ident", "rec_id"]).withColumn("n_records", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "ident")))
    cited = staged(each.withColumns({c: F.when(F.col("n_records") > 1, F.col(c)) for c in about}), "relink-cited")
    several = cited.groupBy("doc_id", "ident").agg(F.first("n_records").alias("n_records"))
    entries = staged(bib.join(several, ["doc_id", "ident"], "left").withColumn("text", F.when(F.col("n_records") > 1, F.col("text"))), "relink-entries")
    held = groups.join(entries.drop("text"), ["doc_id", "num"], "left")
    unclear = cited.where("n_records > 1").drop("n_records")
    unclear = (unclear if catalog is None else unclear.join(catalog, "rec_id")).select("doc_id", "ident", "rec_id", *record_parts())
    said = entries.where("n_records > 1").dropDuplicates(["doc_id", "num"])
    scored = said.select("doc_id", "num", "ident", *said_parts(F.col("text"))).join(unclear, ["doc_id", "ident"]).select(F.struct("doc_id", "num").alias("key"), "rec_id", content_score().alias("score"))
    resolved = best_two(scored, "key").select("key.doc_id", "key.num", _decided().alias("match_kind"))
    sets = lambda df, *by: df.repartition("doc_id").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("ident")), ";").alias("idents"))
    known_sets = sets(source_groups.select("doc_id", "group_id", name), "doc_id", "group_id").select("doc_id", "idents").distinct().withColumn("reused", F.lit(True))
    full = held.join(resolved, ["doc_id", "num"], "left").repartition("doc_id")
    by_place = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("k", "num")))), lambda x: x["num"].cast("string")), ",")
    g = full.groupBy("doc_id", "part", "group_order").agg(
        by_place(F.lit(True)).alias("numbers"), F.bool_and(F.col("ident").isNotNull()).alias("known"), F.bool_and(F.col("n_records").isNotNull()).alias("recorded"), F.bool_or(F.coalesce("n_records", F.lit(0)) > 1).alias("several"),
        by_place(F.col("match_kind") == "ambiguous").alias("verify"), F.array_join(F.array_sort(F.collect_set("ident")), ";").alias("idents"),
    ).join(known_sets, ["doc_id", "idents"], "left")
    kind = F.when(F.col("known") & F.col("reused") & ~F.col("several"), "exact").when(F.lit(construct) & F.col("known") & F.col("recorded"), "constructed").otherwise("placeholder")
    return g.withColumn("kind", kind).select("doc_id", "part", "group_order", "numbers", "kind", F.when(F.col("kind") == "constructed", F.col("verify")).otherwise("").alias("verify"))


def group_reuse(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Target groups whose identity set equals a source group's. Both: group_id, ident."""
    keyed = lambda df: df.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("ident")), "|").alias("ids"))
    src = keyed(sources).groupBy("ids").agg(F.min("group_id").alias("source_id"))
    return keyed(targets).join(src, "ids").select("group_id", "source_id", "ids")


def tfidf_weights(docs: DataFrame, vocabulary: int = 50_000) -> DataFrame:
    """id, term, w: sublinear term frequency times smooth idf, of unit length per text; the `vocabulary` most frequent terms (ties by term). docs: id, text."""
    tf = ranking.term_counts(docs)
    w = tf.join(ranking.vocabulary_of(docs, vocabulary), "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def compare_lists(a: DataFrame, b: DataFrame, matched: float = 0.28, review: float = 0.08, vocabulary: int = 50_000) -> DataFrame:
    """side, a_id, b_id, score, status: each reference of A with its best of B (lowest id on ties): matched, review or only_a; and those of B that are no matched best, only_b. Both: id, text; ids are unique over both lists."""
    a, b = a.select("id", "text"), b.select("id", "text")
    best = ranking.ranked(a, b, ranking.vocabulary_of(a.union(b), vocabulary), 1).select(F.col("q_id").alias("a_id"), F.col("d_id").alias("b_id"), "score")
    left = a.select(F.col("id").alias("a_id")).join(best, "a_id", "left")
    status = F.when(F.col("score") >= matched, "matched").when(F.col("score") >= review, "review").otherwise("only_a")
    rows = left.select("a_id", F.when(F.col("score") >= review, F.col("b_id")).alias("b_id"), F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"))
    used = rows.where("status = 'matched'").select(F.col("b_id").alias("id"))
    only = b.select("id").join(used, "id", "left_anti").select(F.lit(None).cast("long").alias("a_id"), F.col("id").alias("b_id"), F.lit(0.0).alias("score"), F.lit("only_b").alias("status"))
    return rows.unionByName(only)


def top_matches(queries: DataFrame, docs: DataFrame, k: int = 5, vocabulary: int = 50_000) -> DataFrame:
    """q_id, d_id, score, place: the k best documents of each query (score, then id), in the vocabulary fitted on the documents. Both: id, text; ids are unique in each."""
    return ranking.ranked(queries.select("id", "text"), docs.select("id", "text"), ranking.vocabulary_of(docs, vocabulary), k)


def audit_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two bibliographies by (surname, year), with multiplicity: both, missing (only in a) or extra (only in b)."""
    n = lambda df, c: df.groupBy("surname", "year").agg(F.count(F.lit(1)).alias(c))
    j = n(a, "n_a").join(n(b, "n_b"), ["surname", "year"], "full_outer").fillna(0, ["n_a", "n_b"])
    return j.select("surname", "year", "n_a", "n_b", F.when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "extra").otherwise("both").alias("status"))


def reconcile(missing: DataFrame, extra: DataFrame) -> DataFrame:
    """Missing entries re-paired with extra ones of the same surname that share a title word of 5 letters or more; greedy in order of missing, then extra, each extra once. Both: pos, surname, title.

    Pairs are not made: of a surname the extra ones come first, then the missing ones, each side in order, and are gone through once. Held are a surname's extra ones that are left, by their words, of which only those of the words
    that the next missing one has are looked at; a position stands once for each of its words."""
    side = lambda df, is_missing: df.select("surname", F.lit(is_missing).alias("is_missing"), "pos", F.array_join(F.array_sort(tx.terms(F.col("title"), 5)), " ").alias("words")).where("surname is not null and words <> ''")

    def start() -> dict:
        return {"queues": {}, "taken": set(), "last": None}

    def step(held: dict, row: tuple) -> tuple:
        _, is_missing, pos, words = row
        queues, taken = held["queues"], held["taken"]
        if not is_missing:
            for w in words.split(" "):
                queues.setdefault(w, deque()).append(pos)
            return held, None
        if pos == held["last"]:
            return held, None
        best = None
        for w in words.split(" "):
            queue = queues.get(w, ())
            while queue and queue[0] in taken:
                queue.popleft()
            if queue and (best is None or queue[0] < best):
                best = queue[0]
        if best is None:
            return held, None
        taken.add(best)
        held["last"] = pos
        return held, (pos, best)

    every = side(missing, 1).unionByName(side(extra, 0))
    return ordered_fold(every, ["surname"], ["is_missing", "pos"], start, step, "missing_pos long, extra_pos long")


def match_paragraphs(new: DataFrame, old: DataFrame, least: int = 15) -> DataFrame:
    """New paragraphs to old ones by the first 80 of their letters and digits; else, if there are more than 40, by the first 50. The first old one wins. Both: para_id, text."""
    n = new.where(F.char_length("text") >= least).select("para_id", tx.signature(F.col("text")).alias("sig"))
    o = old.where(F.char_length("text") >= least).select(F.col("para_id").alias("old_id"), tx.signature(F.col("text")).alias("osig"))
    first = lambda k: o.groupBy(F.substring("osig", 1, k).alias("k")).agg(F.min("old_id").alias("old_id"))
    by80 = n.join(first(80), F.substring("sig", 1, 80) == F.col("k"), "left").drop("k")
    rest = by80.where("old_id is null and length(sig) > 40").drop("old_id").join(first(50), F.substring("sig", 1, 50) == F.col("k"), "left").select("para_id", "old_id")
    out = by80.where("old_id is not null or length(sig) <= 40").select("para_id", "old_id").union(rest)
    return out.withColumn("status", F.when(F.col("old_id").isNull(), "unmatched").otherwise("matched"))


def restore_status(matched: DataFrame, new_cites: DataFrame, old_cites: DataFrame) -> DataFrame:
    """para_id, old_id, status of new paragraphs matched to old ones: unmatched, already (it cites itself), restored (the old one cites), or plain (neither does). new_cites, old_cites: para_id of runs that cite."""
    has = lambda df, c, flag: df.select(F.col("para_id").alias(c)).distinct().withColumn(flag, F.lit(True))
    at = matched.select("para_id", "old_id").join(has(new_cites, "para_id", "mine"), "para_id", "left").join(has(old_cites, "old_id", "theirs"), "old_id", "left")
    status = F.when(F.col("old_id").isNull(), "unmatched").when(F.col("mine"), "already").when(F.col("theirs"), "restored").otherwise("plain")
    return at.select("para_id", "old_id", status.alias("status"))


def copied_runs(statuses: DataFrame, new_runs: DataFrame, old_cites: DataFrame) -> DataFrame:
    """para_id, run_idx, text: the old paragraphs' citing runs, in order after the last run of each restored paragraph that has one. new_runs: para_id, run_idx; old_cites: para_id, run_idx, text."""
    last = new_runs.groupBy("para_id").agg(F.max("run_idx").alias("last"))
    j = statuses.where("status = 'restored'").join(last, "para_id").join(old_cites.select(F.col("para_id").alias("old_id"), F.col("run_idx").alias("k"), "text"), "old_id")
    return j.select("para_id", (F.col("last") + F.row_number().over(Window.partitionBy("para_id").orderBy("k"))).alias("run_idx"), "text")


def section_lookup(markers: DataFrame, headings: DataFrame, bibliography: DataFrame) -> DataFrame:
    """As-of join: a marker's section is that of the last heading before it; its entry that section's, else the flat one. markers: doc_id, pos, num; headings: doc_id, pos, section; bibliography: doc_id, section, num, body ('' is the flat section)."""
    every = markers.select("doc_id", "pos", "num", F.lit(None).cast("string").alias("section"), F.lit(1).alias("is_marker")).unionByName(headings.select("doc_id", "pos", F.lit(None).cast("long").alias("num"), "section", F.lit(0).alias("is_marker")))
    order = Window.partitionBy("doc_id").orderBy("pos", "is_marker").rowsBetween(Window.unboundedPreceding, 0)
    at = every.withColumn("section", F.coalesce(F.last_value("section", True).over(order), F.lit(""))).where("is_marker = 1")
    own = bibliography.select("doc_id", "section", "num", F.col("body").alias("own"))
    flat = bibliography.where("section = ''").select("doc_id", "num", F.col("body").alias("flat"))
    return at.join(own, ["doc_id", "section", "num"], "left").join(flat, ["doc_id", "num"], "left").select("doc_id", "pos", "num", "section", F.coalesce("own", "flat").alias("body"))


#: Characters up to which texts and claims that may meet are compared as lists of shingles.
SHORT = 1 << 14


def claim_containment(claims: DataFrame, texts: DataFrame, k: int = 5, within: tuple[str, ...] = ()) -> DataFrame:
    """claim_id, text_id, shared, n: the share of a claim's k-word shingles that a text holds, for texts that hold one. claims: claim_id, text; texts: text_id, text; both with the columns `within` that must agree."""

    def shingled(df: DataFrame, *keys: str) -> DataFrame:
        """keys and hs, the different shingles of each text; null where it has none."""
        s = df.select(*keys, F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
        hs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(k)), " "))))
        return s.select(*keys, F.when(F.size("w") >= k, hs).alias("hs"))

    if within:
        # whole texts are dealt out by it, and not their shingles, which are many times as large: those that meet are in one task then. Texts that are short together are compared as lists, others by their shingles' rows
        kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((claims, "claim_id"), (texts, "text_id"))}
        no = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        every = claims.select(*within, "claim_id", no("text_id"), "text").unionByName(texts.select(*within, no("claim_id"), "text_id", "text")).repartition(*within)
        own = Window.partitionBy(*within)
        sized = every.withColumn("size", F.sum(F.char_length("text")).over(own))
        listed = shingled(sized.where(F.col("size") <= SHORT), *within, "claim_id", "text_id").withColumn("texts", F.collect_list(F.when(F.col("text_id").isNotNull(), F.struct("text_id", F.col("hs").alias("theirs")))).over(own))
        few = listed.where("claim_id is not null").select("claim_id", "hs", F.explode("texts").alias("x")).select("claim_id", "x.text_id", F.size(F.array_intersect("hs", "x.theirs")).cast("long").alias("shared"), F.size("hs").cast("long").alias("n")).where("shared > 0")
        each = shingled(sized.where(F.col("size") > SHORT), *within, "claim_id", "text_id").withColumn("n", F.size("hs")).withColumn("h", F.explode_outer("hs")).drop("hs").where("h is not null")
        met = each.withColumn("texts", F.collect_list("text_id").over(Window.partitionBy(*within, "h"))).where("claim_id is not null and size(texts) > 0")
        many = met.select(*within, "claim_id", "n", F.explode("texts").alias("text_id")).groupBy(*within, "claim_id", "text_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n").cast("long").alias("n"))
        return few.unionByName(many.drop(*within)).select("claim_id", "text_id", "shared", "n", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))
    c = shingled(claims, "claim_id").select("claim_id", F.explode("hs").alias("h"))
    n = c.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    hit = shingled(texts, "text_id").select("text_id", F.explode("hs").alias("h")).join(c, "h").groupBy("claim_id", "text_id").agg(F.count(F.lit(1)).alias("shared"))
    return hit.join(n, "claim_id").select("claim_id", "text_id", "shared", "n", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def window_ratios(pairs: DataFrame, texts: DataFrame, above: float = 0.0, least: int = 25, extra: int = 40, per_group: int = 256, popular: bool = False) -> DataFrame:
    """claim_id, text_id, ratio: the best matching-blocks ratio of each pair's claim with a window of its text; 0 where no window exceeds `above`, the claim has fewer than `least` characters without its digits, or the text is not longer than the claim.

    pairs: claim_id, text_id, text (the claim); texts: text_id (unique), text. No id is null; a null text is an empty one. Windows and `popular`: see `best_window`. A text goes once to every `per_group` of its claims, which are dealt out by hash: it
    doesn't stand beside each claim, and a text that most claims name is searched by many tasks.
    """
    body = F.regexp_replace(_plain("text"), r"\d+", "")
    asked = pairs.select("claim_id", "text_id", F.when(F.char_length(body) >= least, body).otherwise("").alias("body"))
    groups = asked.groupBy("text_id").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("int").alias("groups"))
    kind = pairs.schema["claim_id"].dataType.simpleString()
    digits = F.translate(_plain("text"), "123456789", "0" * 9)  # no claim has a digit, so which one it is doesn't matter, and more windows are equal
    dealt = asked.join(groups, "text_id").select("text_id", F.pmod(F.xxhash64("claim_id"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("is_claim"), "claim_id", "body")
    sent = texts.join(groups, "text_id").select("text_id", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("is_claim"), F.lit("0").cast(kind).alias("claim_id"), F.coalesce(digits, F.lit("")).alias("body"))

    def step(placed: PlacedText | None, row: tuple) -> tuple:
        _, _, is_claim, claim_id, body = row
        if not is_claim:
            return PlacedText(body), None
        return placed, (claim_id, round(best_window(body, placed, above, extra, popular), 6) if placed else 0.0)

    return ordered_fold(sent.unionByName(dealt), ["text_id", "part"], ["is_claim", "claim_id"], None, step, f"claim_id {kind}, ratio double", spread=True).select("claim_id", "text_id", "ratio")


def published_ratio(claims: DataFrame, texts: DataFrame, least: int = 25, extra: int = 40, k: int = 4) -> DataFrame:
    """claim_id, ratio, text_id: the best ratio (`window_ratios`) of each claim with any of the texts that share a k-word shingle with it, and the least id of the texts that reach it; 0 and null without any. claims: claim_id, text; texts: text_id, text; ids are unique."""
    undigited = claims.select("claim_id", F.regexp_replace(_plain("text"), r"\d+", "").alias("text"))
    pairs = claim_containment(undigited.where(F.char_length("text") >= least), texts.select("text_id", _plain("text").alias("text")), k).select("claim_id", "text_id").join(undigited, "claim_id")
    pairs = staged(pairs, "ratio-pairs")
    best = window_ratios(pairs, texts, least=least, extra=extra).groupBy("claim_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "text_id")).alias("b"))
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", F.coalesce(-F.col("b.r"), F.lit(0.0)).alias("ratio"), F.col("b.text_id").alias("text_id"))


def reference_usage(references: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that hold at least min(3, n) of a reference's first 5 title words of more than 5 characters, also as parts of longer words. references: ref_id, title; paragraphs: para_id, text.

    Key words meet the distinct words of all paragraphs on six characters, and the paragraphs then meet those words.
    """
    split = lambda c: F.split(F.lower(c), r"[^a-z0-9]+")
    keys = references.select("ref_id", F.slice(F.array_distinct(F.filter(split("title"), lambda w: F.char_length(w) > 5)), 1, 5).alias("ks")).where("size(ks) > 0")
    need = keys.select("ref_id", F.least(F.lit(3), F.size("ks")).alias("need"), F.explode("ks").alias("key"))
    tokens = paragraphs.select("para_id", F.explode(F.array_distinct(F.filter(split("text"), lambda w: F.char_length(w) > 5))).alias("w"))
    grams = tokens.select("w").distinct().select("w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("w") - 5), lambda i: F.substring(F.col("w"), i, F.lit(6))))).alias("gram"))
    holds = need.select("key").distinct().withColumn("gram", F.substring("key", 1, 6)).join(grams, "gram").where(F.contains("w", F.col("key"))).select("key", "w")
    found = tokens.join(holds, "w").select("para_id", "key").distinct()
    return need.join(found, "key").groupBy("ref_id", "para_id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("ref_id", "para_id", "n")


def naming_xref(captions: DataFrame, sheet: DataFrame) -> DataFrame:
    """Captions against a naming sheet (number, label): match, mismatch or not listed."""
    j = captions.join(sheet.select(F.col("number").alias("fig_num"), F.col("label").alias("listed")), "fig_num", "left")
    return j.select("doc_id", "fig_num", "caption", "listed", F.when(F.col("listed").isNull(), "not listed").when(F.contains(F.lower("caption"), F.lower("listed")), "match").otherwise("mismatch").alias("status"))


def apply_saved(figures: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved crop values over scanned ones, by label."""
    s = saved.select("label", F.col("crop_top").alias("st"), F.col("crop_bot").alias("sb"))
    return figures.join(s, "label", "left").select("doc_id", "label", F.coalesce("st", "crop_top").alias("crop_top"), F.coalesce("sb", "crop_bot").alias("crop_bot"), F.col("st").isNotNull().alias("saved"))


def catalog_lookup(references: DataFrame, first: DataFrame, second: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """Up to k candidates of each reference (id, text) in the first catalogue; in the second for references without any; else notfound."""
    a = top_matches(references, first, k).where(F.col("score") >= least).withColumn("source", F.lit("first"))
    rest = references.join(a.select(F.col("q_id").alias("id")).distinct(), "id", "left_anti")
    b = top_matches(rest, second, k).where(F.col("score") >= least).withColumn("source", F.lit("second"))
    found = a.union(b)
    none = references.join(found.select(F.col("q_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("q_id"), F.lit(None).cast("long").alias("d_id"), F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.lit("notfound").alias("source"))
    return found.unionByName(none)


def topical(claims: DataFrame) -> DataFrame:
    """Share of a claim's terms (4 letters or more, no stop words) found in each reference's title and keywords, the greatest over its references. claims: claim_id, claim, titles."""
    # the claim's terms are a column: within the function they would be made anew for each title
    named = claims.select("claim_id", "titles", tx.topic_terms(F.col("claim")).alias("mine"))
    most = F.array_max(F.transform("titles", lambda t: F.size(F.array_intersect("mine", tx.terms(t)))))
    return named.select("claim_id", F.round(F.coalesce(most / F.greatest(F.size("mine"), F.lit(1)), F.lit(0.0)), 6).alias("topical"))


def _title_words(title: Column) -> Column:
    return F.regexp_extract_all(F.lower(title), F.lit("[a-z]{5,}"), F.lit(0))


def catalog_abstracts(references: DataFrame, catalog: DataFrame, words: int = 4) -> DataFrame:
    """ref_id, rec_id, abstract: of each reference the first record of the catalogue (the least id) of its author and year whose title has all of the reference's first `words` words of five letters or more.

    references: ref_id, author, year, title; catalog: rec_id, surname, year, title, abstract. The author's name is its first word before a comma. References that ask the same are looked up once; they meet records on
    author, year and that of their words which the fewest records have, so that a name or word that many share brings few rows together. Those without such words meet all records of author and year. Records of the same author,
    year and title words are one. Files of records and references are much smaller than their rows, so what is read from them is joined by a merge.
    """
    name = F.lower(F.split_part(F.trim(F.split_part("author", F.lit(","), F.lit(1))), F.lit(" "), F.lit(1)))
    asked = references.select("ref_id", name.alias("name"), F.col("year").alias("year"), F.array_distinct(F.slice(_title_words(F.col("title")), 1, words)).alias("asked")).where("name not in ('', '?')")
    says = staged(asked.withColumn("says", F.xxhash64("name", "year", "asked")), "catalog-asked")
    once = says.select("says", "name", "year", "asked").dropDuplicates(["says"])
    titled = catalog.select("rec_id", F.lower("surname").alias("name"), "year", F.array_sort(F.array_distinct(_title_words(F.col("title")))).alias("held")).groupBy("name", "year", "held").agg(F.min("rec_id").alias("rec_id"))
    counts = titled.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by_word = once.select("says", F.explode("asked").alias("word")).join(counts, "word", "left").groupBy("says").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("rarest"))
    keyed = once.join(by_word, "says", "left").withColumn("key", F.coalesce("rarest", F.lit("")))
    offered = titled.select("rec_id", "name", "year", "held", F.explode(F.array_append("held", F.lit(""))).alias("key"))
    met = keyed.join(offered, ["name", "year", "key"]).where(F.size(F.array_except("asked", "held")) == 0)
    found = met.groupBy("says").agg(F.min("rec_id").alias("rec_id"))
    held = found.join(catalog.select("rec_id", "abstract").hint("merge"), "rec_id")
    return says.select("ref_id", "says").hint("merge").join(held, "says").select("ref_id", "rec_id", "abstract")


def abstract_share(claims: DataFrame, abstracts: DataFrame) -> DataFrame:
    """claim_id, c: the share of a claim's terms that the abstract found for its first reference holds. claims: claim_id, claim; abstracts: ref_id (the claim's id), abstract. Claims without an abstract are left out."""
    mine = tx.topic_terms(F.col("claim"))
    share = F.round(F.size(F.array_intersect(mine, tx.terms(F.col("abstract")))) / F.greatest(F.size(mine), F.lit(1)), 6)
    return claims.join(abstracts.where("abstract <> ''").hint("merge"), F.col("claim_id") == F.col("ref_id")).select("claim_id", share.alias("c"))


def verdicts(scores: DataFrame) -> DataFrame:
    """scores: claim_id, a (topical), b (published), c (abstract; null if not looked up)."""
    t, b = F.greatest("a", F.coalesce("c", F.lit(0.0))), F.coalesce("b", F.lit(0.0))
    v = F.when((b > 0.7) & (t >= 0.12), "verified").when((t >= 0.25) | (F.coalesce("c", F.lit(0.0)) >= 0.2), "supported").when((t >= 0.1) | (b > 0.7), "plausible").otherwise("review")
    order = F.when(v == "review", 0).when(v == "plausible", 1).when(v == "supported", 2).otherwise(3)
    return scores.select("claim_id", v.alias("verdict"), order.alias("verdict_order"))


def context_lists(rows: DataFrame, stops: list[str], before: int = 20, after: int = 12) -> DataFrame:
    """rows and `words`: the content words around each citation, each once; null in other rows. rows: doc_id, pos, text, is_cite, and others, one row to a place.

    Rows with words are numbered through the document. Of each at most the words that can count are looked at, and of the numbers before and after a citation as many as words are wanted, so rows that are dealt out by document stay where they are."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), lambda x: ~x.isin(stops) if stops else F.lit(True))
    none = F.array().cast("array<string>")
    doc, out = Window.partitionBy("doc_id"), rows.columns
    ws = rows.withColumn("_ws", F.when(F.col("is_cite"), none).otherwise(F.coalesce(w, none)))
    numbered = ws.withColumn("_nth", F.count_if(F.size("_ws") > 0).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))
    near = lambda part, low, high: F.flatten(F.collect_list(F.when(F.size("_ws") > 0, part)).over(doc.orderBy("_nth").rangeBetween(low, high)))
    placed = numbered.withColumn("_before", near(last(F.col("_ws"), before), 1 - before, 0)).withColumn("_after", near(F.slice("_ws", 1, after), 1, after))
    words = F.array_distinct(F.concat(last(F.col("_before"), before), F.slice("_after", 1, after)))
    return placed.select(*out, F.when(F.col("is_cite"), words).alias("words"))


def context_words(rows: DataFrame, stops: list[str], before: int = 20, after: int = 12) -> DataFrame:
    """doc_id, cite, word: the content words around each citation. rows: doc_id, pos, text, is_cite."""
    return context_lists(rows, stops, before, after).where("is_cite").select("doc_id", F.col("pos").alias("cite"), F.explode("words").alias("word"))


def context_idf(bags: DataFrame, windows: int | None = None) -> DataFrame:
    """word, idf over all windows. bags: doc_id, cite, word; or, where the number of windows with a word is given, word alone."""
    n = bags.select("doc_id", "cite").distinct().agg(F.count(F.lit(1))).scalar() if windows is None else F.lit(windows)
    return bags.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", "df", F.round(F.log((n + 1) / (F.col("df") + 0.5)) + 1, 6).alias("idf"))


#: Words up to which their weights are sent to every task.
SENT_WORDS = 1 << 20


def context_similarity(targets: DataFrame, sources: DataFrame, idf: DataFrame) -> DataFrame:
    """Weighted Jaccard of target and source windows in the same pair of documents that share a word. Both: doc_id, cite, word."""
    side = lambda df, k: df.select("doc_id", F.lit(k).alias("side"), "cite", "word")
    every = side(targets, 0).unionByName(side(sources, 1)).groupBy("doc_id", "side", "cite").agg(F.collect_set("word").alias("words"))
    return similar_windows(every, idf)


def similar_windows(windows: DataFrame, idf: DataFrame) -> DataFrame:
    """doc_id, t, s, sim: context_similarity of windows as lists. windows: doc_id, side (0: targets, 1: sources), cite, words. Lists are dealt out by document, and nothing after that."""
    weights = idf.select("word", "idf")
    weights = F.broadcast(weights) if weights.limit(SENT_WORDS + 1).count() <= SENT_WORDS else weights
    each = windows.repartition("doc_id").select("doc_id", "side", "cite", F.explode_outer("words").alias("word")).join(weights, "word")
    sized = each.withColumn("n", F.sum("idf").over(Window.partitionBy("doc_id", "side", "cite")))
    met = sized.withColumn("ss", F.collect_list(F.when(F.col("side") == 1, F.struct(F.col("cite").alias("s"), F.col("n").alias("ns")))).over(Window.partitionBy("doc_id", "word"))).where("side = 0 and size(ss) > 0")
    j = met.select("doc_id", F.col("cite").alias("t"), "idf", F.col("n").alias("nt"), F.explode("ss").alias("x")).groupBy("doc_id", "t", "x.s").agg(F.sum("idf").alias("shared"), F.first("nt").alias("nt"), F.first("x.ns").alias("ns"))
    return j.select("doc_id", "t", "s", F.round(F.col("shared") / (F.col("nt") + F.col("ns") - F.col("shared")), 6).alias("sim"))


def fill_by_order(targets: DataFrame, sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """Unmatched targets between confident anchors, zipped with the unused sources of the same gap. targets: doc_id, t; sources: doc_id, s; anchors: doc_id, t, s."""
    order_t, order_s = Window.partitionBy("doc_id").orderBy("t"), Window.partitionBy("doc_id").orderBy("s")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    a = anchors.select("doc_id", "t", F.lit(1).alias("anchor"))
    b = anchors.select("doc_id", "s", F.lit(1).alias("anchor"))
    gap = lambda w: F.coalesce(F.sum("anchor").over(upto(w)), F.lit(0))
    rank = lambda c: F.row_number().over(Window.partitionBy("doc_id", "gap").orderBy(c))
    t = targets.join(a, ["doc_id", "t"], "left").withColumn("gap", gap(order_t)).where("anchor is null").withColumn("k", rank("t"))
    s = sources.join(b, ["doc_id", "s"], "left").withColumn("gap", gap(order_s)).where("anchor is null").withColumn("k", rank("s"))
    return t.select("doc_id", "gap", "k", "t").join(s.select("doc_id", "gap", "k", "s"), ["doc_id", "gap", "k"]).select("doc_id", "t", "s")
