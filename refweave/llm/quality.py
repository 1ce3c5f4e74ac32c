"""Quality rules (2): a short-circuit cascade whose rules are ordered by rejection per cost, estimated on a sample.

Each rule reads lazily computed features of one text and rejects it or not. On a bounded sample the rules are
run and timed; the cascade takes the rule that rejects most per second of what the rules before it leave, and stops at a document's
first rejection. The order changes only the cost and ``rejected_by``: a document is kept iff no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import WORD, bounded_batches

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Features:
    """Features of one text, each computed when first asked for. Null counts as an empty text."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def copy(self) -> Features:
        """One that has the features computed so far."""
        out = Features(self.text)
        out.__dict__.update(self.__dict__)
        return out

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more in the text, the first occurrence included."""
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        n = end = 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                n += i + 3 - max(i, end)
                end = i + 3
        return n

    @cached_property
    def n_upper(self) -> int:
        return len(_UPPER.findall(self.text))

    @cached_property
    def n_lettered(self) -> int:
        """Words that hold a letter."""
        return sum(1 for w in self.words if any(map(str.isalpha, w)))


@dataclass(frozen=True)
class Rule:
    """Rejects a text when `rejects` is true of its features."""

    name: str
    rejects: Callable[[Features], bool]


#: The production rules: those of the base verdict, then symbols, capitals, repeated lines and words without letters.
RULES = (
    Rule("too_short", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("capitals", lambda f: 10 * f.n_upper > 3 * f.word_chars),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 35 * len(f.lines)),
    Rule("few_letters", lambda f: 10 * f.n_lettered < 7 * f.n_words),
)
#: Rows and characters at most, about, on which cost and selectivity are estimated; the verdicts don't depend on them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000_000


def plan_cascade(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[int]:
    """Positions of the rules in the cascade's order.

    The next rule is always the one with the most rejections per second among the texts that the rules before it leave, with the features that those have computed already; ties keep the rules' order.
    """
    order, left, alive = [], list(range(len(rules))), [Features(x) for x in texts]
    while left:
        scored = []
        for i in left:
            copies = [f.copy() for f in alive]
            began = time.perf_counter()
            n = sum(rules[i].rejects(f) for f in copies)
            scored.append((-(n / max(1, len(alive))) / max(time.perf_counter() - began, 1e-9), i))
        best = min(scored)[1]
        order.append(best)
        left.remove(best)
        alive = [f for f in alive if not rules[best].rejects(f)]
    return order


def first_rejection(f: Features, order: list[int], rules: tuple[Rule, ...] = RULES) -> str | None:
    return next((rules[i].name for i in order if rules[i].rejects(f)), None)


def sampled_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[int]:
    """The cascade's order for these documents, from a bounded sample of whole texts that the texts' hashes choose. The rules are timed in a task, and only their order comes to the driver."""
    part = max(1, docs.count() // (2 * rows))
    sample = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(part)) == 0).limit(rows)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, n = [], 0
        for b in batches:
            for x in b["t"]:
                if n < chars:
                    texts.append(x if isinstance(x, str) else None)
                    n += len(texts[-1] or "")
        yield pd.DataFrame({"order": [plan_cascade(texts, rules)]})

    found = sample.repartition(1).mapInPandas(plan, "order array<int>").first()
    return list(found["order"]) if found else list(range(len(rules)))


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, the base features, base_failed, kept and rejected_by (the first rule of the cascade that rejects it, else null).

    The base features are returned, so the two base rules are always evaluated; the other rules run in the cascade's order
    until one rejects. Null and empty texts have no words and fail; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored whatever their names.
    """
    bounded_batches(docs.sparkSession)
    order = sampled_order(docs, text, rules)
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b["t"]:
                f = Features(x if isinstance(x, str) else None)
                failed = f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words
                why = first_rejection(f, order, rules)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and why is None, why))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])
            out.insert(0, "doc_id", b["d"].array)
            yield out

    return docs.select(F.col(id_col).alias("d"), F.col(text).alias("t")).mapInPandas(
        judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    )


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, with all their columns whatever their names, that no rule rejects. Null and empty texts are rejected; rows that repeat are kept or rejected alike; an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    order = sampled_order(docs, text, rules)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([first_rejection(Features(x if isinstance(x, str) else None), order, rules) is None for x in texts])

    return docs.where(kept(F.col(text)))
