"""Column expressions over text: hits with their places, sentences, cleaning, reference parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>>: non-overlapping matches with 1-based places, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        return F.struct((start + F.char_length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """A text cut at white space after `.`, `!` or `?`."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_at(text: Column, place: Column) -> Column:
    """The first sentence whose cumulative length (one more for each) reaches the place."""
    state = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("s"))

    def step(acc: Column, s: Column) -> Column:
        n = acc["n"] + F.char_length(s) + 1
        return F.struct(n.alias("n"), F.when(acc["s"].isNull() & (n >= place), s).otherwise(acc["s"]).alias("s"))

    return F.coalesce(F.aggregate(sentences(text), state, step, lambda acc: acc["s"]), text)


def cleaned(text: Column) -> Column:
    """Soft hyphens healed, control characters dropped, white space made single, a trailing panel letter dropped."""
    out = F.regexp_replace(text, "­\\s*", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, r"\s+[A-H]$", "")


def first_year(text: Column) -> Column:
    """The first of 1800 to 2099, else empty."""
    return F.regexp_extract(text, r"\b((?:18|19|20)\d\d)", 1)


def last_year(text: Column) -> Column:
    years = F.regexp_extract_all(text, F.lit(r"\b(?:18|19|20)\d\d\b"), F.lit(0))
    return F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def signature(text: Column) -> Column:
    """Letters and digits only, lower-case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def terms(text: Column, least: int = 4) -> Column:
    """Distinct lower-case runs of letters that are long enough."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


#: Words that say nothing of a topic.
STOP_WORDS = (
    "the a an of and or to in for with on at by from is are was were be as that this "
    "these those it its their his her not no can may might also been being have has had "
    "which who whom into than then thus such between among during after before over under "
    "but if when while where each per due via about within without"
).split()


def topic_terms(text: Column) -> Column:
    """Terms of four letters or more that aren't stop words."""
    return F.array_except(terms(text), F.array(*map(F.lit, STOP_WORDS)))
