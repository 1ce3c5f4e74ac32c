"""Chat formatting (10): incremental black-box rendering of conversations.

The template is a black box ``render(messages) -> str``. Successive turn prefixes are rendered and consecutive outputs
compared: what the output of the first k turns adds to that of k - 1 is turn k's span. An output that doesn't begin with
the one before shows a template that rewrites history, and the conversation is flagged. Where a text
stands is found by rendering the same prefix with two probe texts: what both outputs share is header and footer, if the real output has them too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches

Message = tuple[str, str]
Span = tuple[int, int]

#: Control strings of the plain template and what stands for them inside roles and texts.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c", "\n": "\\n"}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_BACK = {v: k for k, v in ESCAPES.items()}


def escape(text: str, role: bool = False) -> str:
    """Reversible: backslash first, then the control strings, leftmost first; afterwards none of them is left."""
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m[0]], text)


def render_plain(messages: list[Message]) -> str:
    """``### role: text</turn>`` and a line end per turn."""
    return "".join(f"### {escape(role, True)}: {escape(text)}</turn>\n" for role, text in messages)


def parse_plain(formatted: str) -> list[Message]:
    """The messages that render_plain was given."""
    out = []
    for turn in formatted.split("</turn>\n")[:-1]:
        role, _, text = turn.removeprefix("### ").partition(": ")
        out.append((unescape(role), unescape(text)))
    return out


def common_prefix(a: str, b: str) -> int:
    """How many characters both begin with, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_span(messages: list[Message], k: int, output: str, render: Callable[[list[Message]], str]) -> Span | None:
    """Where the text of turn k stands in `output`, which is what the messages render to; None if it isn't there, or if the output around it depends on it.

    Two probe texts are rendered in its place: what both outputs share is what stands before and behind, and the real output must have that too.
    """
    role = messages[k][0]
    a, b = (render([*messages[:k], (role, probe), *messages[k + 1 :]]) for probe in ("a", "b"))
    head = common_prefix(a, b)
    before, behind = a[:head], a[head + 1 :]
    if len(a) <= head or a[head] != "a" or b != f"{before}b{behind}" or len(output) < len(a) - 1 or not output.startswith(before) or not output.endswith(behind):
        return None
    return head, len(output) - len(behind)


def turn_spans(messages: list[Message], render: Callable[[list[Message]], str] = render_plain) -> tuple[str, list[Span | None], list[Span | None], bool]:
    """The whole output; for each turn its span there, and its text's span there; and whether the template rewrites history.

    What the output of the first k turns adds to that of k - 1 is turn k's span, or, where it doesn't begin with that (which shows a template that rewrites history), what follows their first difference.
    No messages give an empty output without spans; equal messages have spans of their own. If history is rewritten, the texts are located anew in the whole output, and a turn whose output isn't part of it as it was has no span.
    """
    done, spans, texts, rewrites = "", [], [], False
    for k in range(len(messages)):
        now = render(messages[: k + 1])
        start = len(done)
        if not now.startswith(done):
            rewrites, start = True, common_prefix(done, now)
        spans.append((start, now))
        if not rewrites:
            texts.append(text_span(messages[: k + 1], k, now, render))
        done = now
    if rewrites:
        texts = [text_span(messages, k, done, render) for k in range(len(messages))]
    return done, [(start, len(now)) if done.startswith(now) else None for start, now in spans], texts, rewrites


def format_conversations(turns: DataFrame, render: Callable[[list[Message]], str] = render_plain, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (begin and end code points of each text of `trained_role` in it), turn_spans, rewrites_history.

    A span is null if `formatted` doesn't hold the text or turn, because the template rewrote it, or if what stands around a text depends on it. Turns are ordered by turn, then role, then text, so that ties and repeated rows have one order; null roles and texts
    are empty; rows with a null conv_id form one conversation; an empty table gives no rows; other columns are ignored. A conversation is rendered
    once per turn, so it must fit into a task, as must any formatted conversation.
    """
    bounded_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("m"))

    named = lambda s: None if s is None else {"begin": s[0], "end": s[1]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for turns_of in b["m"]:
                messages = [(x["role"], x["text"]) for x in turns_of]
                formatted, spans, texts, rewrites = turn_spans(messages, render)
                out.append((formatted, [named(s) for s, m in zip(texts, messages) if m[0] == trained_role], list(map(named, spans)), rewrites))
            made = pd.DataFrame(out, columns=["formatted", "loss_spans", "turn_spans", "rewrites_history"])
            made.insert(0, "conv_id", b["conv_id"].array)
            yield made

    return grouped.mapInPandas(run, f"conv_id {kind}, formatted string, loss_spans array<struct<begin:long,end:long>>, turn_spans array<struct<begin:long,end:long>>, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns (role, text), loss_text (unescaped text under the loss mask) and formatted_chars.

    Spans that are null add nothing to loss_text; a conversation whose texts are all empty has empty ones again; an empty table gives no rows. Only what the plain template made is parsed."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [parse_plain(x) for x in b["formatted"]]
            loss = ["".join(unescape(x[s["begin"] : s["end"]]) for s in spans if s is not None) for x, spans in zip(b["formatted"], b["loss_spans"])]
            yield pd.DataFrame({"conv_id": b["conv_id"].array, "n_turns": [len(x) for x in turns], "turns_text": ["".join(f"{r}\n{t}\n" for r, t in x) for x in turns], "loss_text": loss, "formatted_chars": [len(x) for x in b["formatted"]]})

    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_text string, loss_text string, formatted_chars long")
