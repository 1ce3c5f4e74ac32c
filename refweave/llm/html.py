"""HTML extraction (7): tree scoring.

A page's tags become a small tree. Blocks of text give points for their length and commas to their parent (all) and
grandparent (half); a container's points are discounted by the share of its text that stands in links. The best container
is kept whole, with those siblings that are of its kind or read like it; navigation, footers, sidebars, notices, comments and adverts are
dropped wherever they stand, by their element or by a class, id or role that names nothing else.

Some elements are judged by what they hold, once the page is read: a form goes unless it wraps text, much of it for each of its fields; inside an article a container that only its id names goes if it is made of links, has no
prose or holds readers' comments, for ids are also slugs of headings; a header outside an article stays if it is the title of the best container.

Every step is linear in the page: what a node needs of its ancestors is noted when it is made, sums go up the tree once, and marks go down once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.common import bounded_batches

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav footer aside button menu dialog svg object canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(["body", "html"])
#: An opening tag of the first kind ends open elements of the second kinds, up to a boundary of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: What an end tag of an inline element doesn't reach beyond.
SCOPES = frozenset("article main td th".split())
ARTICLE = frozenset("article main".split())
HOLDERS = frozenset("div section article main body #root td".split())
#: Elements that are no containers of an article by themselves.
PARTS = frozenset("p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th".split())
#: Elements that an id may name as no part of the article. Others, as headings and paragraphs, have slugs for ids.
NAMED_BY_ID = BLOCK - frozenset("h1 h2 h3 h4 h5 h6 hgroup p li dt dd blockquote pre figure figcaption address caption hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of forms that readers fill in, and characters of unlinked text for each of them that a form which wraps text has at least.
FIELDS, CHARS_A_FIELD = frozenset("input select textarea button".split()), 100
#: Words that name readers' comments.
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that name what isn't the article; and words that may stand beside them in a name without changing that.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus dialog footer header login menu menubar modal nav navbar navigation newsletter notice notices alert pager pagination popup promo related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
BESIDE = frozenset("site page main top bottom left right upper lower primary secondary global box block bar banner wrapper wrap container inner outer list listing links link item items section area region panel row col column unit slot text title body form button buttons icons sticky fixed inline small large mobile desktop posts articles content group holder stories privacy policy bar".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|))*+)>")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. `block` is the nearest block element from it upwards, `near` the nearest one of each implied kind or its boundary, `inside` the number of open inline elements by tag within the scope.
    `form`, `header` and `named` are the nearest elements from it upwards that are judged by what they hold; `fields`, `titled` and `prose` are what they are judged by, `gone` the verdict."""

    __slots__ = ("tag", "parent", "names", "dropped", "block", "in_article", "near", "inside", "chars", "linked", "points", "form", "header", "named", "fields", "titled", "prose", "gone")

    def __init__(self, tag: str, parent: Node | None, names: str, dropped: bool, judged: str = ""):
        self.tag, self.parent, self.names, self.dropped = tag, parent, names, dropped
        self.form, self.header, self.named = (self if judged == kind else getattr(parent, kind, None) for kind in ("form", "header", "named"))
        self.fields, self.titled, self.prose, self.gone = 0, False, False, False
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.in_article = tag in ARTICLE or parent is not None and parent.in_article
        self.near = dict(parent.near) if parent is not None and tag in _KINDS_OF else (parent.near if parent is not None else {})
        for kind in _KINDS_OF.get(tag, ()):
            self.near[kind] = self
        self.inside = Counter() if parent is None or tag in SCOPES else parent.inside
        self.chars = self.linked = 0
        self.points = 0.0


_KINDS_OF: dict[str, list[str]] = {}
for _kind, (_ends, _bounds) in IMPLIED.items():
    for _tag_name in _ends | _bounds:
        _KINDS_OF.setdefault(_tag_name, []).append(_kind)


def marked(name: str) -> set[str]:
    """The marks in a class, id or role name, if all of its words are marks or words that go with them; else none. ``share-price`` is no share, ``has-sidebar`` no sidebar."""
    parts = [x.lower() for x in _NAME_PARTS.findall(name)]
    marks = {x for x in parts if x in MARKS}
    return marks if all(x in MARKS or x in BESIDE for x in parts) else set()


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by name; of several of one name, the first."""
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        values.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return values


def _unlikely(tag: str, attrs: dict[str, str], in_article: bool) -> tuple[bool, str]:
    """Whether an element's attributes mark it as no part of the article; and else, by what it is to be judged: header, named or nothing."""
    if tag in ("html", "body", "main"):
        return False, ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(attrs.get("style", "")):
        return True, ""
    marks = [m for k in ("class", "role") for m in map(marked, attrs.get(k, "").split()) if m]
    by_id = marked(attrs.get("id", "")) if tag in NAMED_BY_ID else set()
    if any(m != {"header"} for m in marks) or by_id & REMARKS or by_id - {"header"} and not in_article:
        return True, ""
    if (tag == "header" or marks or by_id == {"header"}) and not in_article:
        return False, "header"
    return False, "named" if by_id - {"header"} else ""


def blocks_of(html: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """The text blocks in page order, each with the block element that holds it, its text and its linked characters; and all elements, parents first."""
    root = Node("#root", None, "", False)
    nodes, at, found, text, linked, links = [root], root, [], [], 0, 0
    holder = root
    open_blocks: Counter[str] = Counter()
    unclosed: set[str] = set()  # raw elements that have no end tag from here on
    last_end = html.rfind(">")

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined and not holder.dropped:
                found.append((holder, joined, linked))
            text, linked = [], 0

    def leave(upto: Node) -> None:
        """Closes open elements until upto is the innermost."""
        nonlocal at, links
        while at is not upto:
            links -= at.tag == "a"
            if at.tag in BLOCK:
                open_blocks[at.tag] -= 1
            else:
                at.inside[at.tag] -= 1
            at = at.parent

    pos, end = 0, len(html)
    while pos < end:
        low = html.find("<", pos)
        if low != pos:
            low = end if low < 0 else low
            piece = unescape(html[pos:low])
            pos = low
        elif (m := _TAG.match(html, pos)) if pos < last_end and html[pos + 1 : pos + 2] not in "!?" else None:
            pos, piece = m.end(), None
        elif html.startswith(("<!", "<?"), pos):
            close = "-->" if html.startswith("<!--", pos) else ">"
            after = html.find(close, pos + 2)
            pos = end if after < 0 else after + len(close)
            continue
        elif pos > last_end and (html[pos + 1 : pos + 2].isalpha() or html[pos + 1 : pos + 2] == "/"):
            break  # the page ends within a tag
        else:
            piece, pos = "<", pos + 1
        if piece is not None:
            if not at.dropped:
                text.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK and open_blocks[tag] or tag not in BLOCK and at.inside[tag] > 0:
                if tag in BLOCK:
                    flush()
                n = at
                while n.tag != tag:
                    n = n.parent
                leave(n.parent)
                holder = at.block
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and at.block.tag == "p":
                leave(at.block.parent)
            if tag in IMPLIED:
                ends, n, hit = IMPLIED[tag][0], at.near.get(tag), None
                while n is not None and n.tag in ends:
                    hit, n = n, n.parent.near.get(tag)
                if hit is not None:
                    leave(hit.parent)
            holder = at.block
        if tag in FIELDS and at.form is not None and not (tag == "input" and _attributes(m[3]).get("type", "").lower() == "hidden"):
            at.form.fields += 1
        if tag in VOID:
            continue
        if tag in RAW:
            if tag not in unclosed:
                close = re.compile(f"</{tag}", re.I).search(html, pos)
                if close is not None:
                    after = html.find(">", close.end())
                    pos = end if after < 0 else after + 1
                    continue
                unclosed.add(tag)
            if tag in ("script", "style"):
                pos = end
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        unlikely, judged = _unlikely(tag, attrs, at.in_article)
        if tag == "form" and at.form is None:
            judged = "form"
        unlikely = unlikely or tag in DROPPED or tag in ("label", "legend") and at.form is not None
        if tag == "nav" and at.header is not None:
            at.header.fields += 1
        at = Node(tag, at, attrs.get("class", ""), at.dropped or unlikely, judged)
        if tag in ARTICLE and at.form is not None:
            at.form.titled = True
        if tag in HEADINGS and at.header is not None:
            at.header.titled = True
        nodes.append(at)
        links += tag == "a"
        if tag in BLOCK:
            open_blocks[tag] += 1
        else:
            at.inside[tag] += 1
        holder = at.block
    flush()
    return found, nodes


def _reads(holder: Node, text: str, linked: int) -> bool:
    """Whether a paragraph reads like prose: long, or ended like a sentence, and with few links."""
    share = linked / len(text)
    return holder.tag == "p" and share < 0.25 and (len(text) > 80 or not share and text[-1] in ".!?")


def _sums(found: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    """Characters and linked characters of all elements."""
    for n in nodes:
        n.chars = n.linked = 0
    for holder, text, linked in found:
        holder.chars += len(text)
        holder.linked += linked
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked


def _density(n: Node) -> float:
    return min(1.0, n.linked / n.chars) if n.chars else 0.0


def _judged(found: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks that no form, and no container that only its id names, takes away."""
    _sums(found, nodes)
    for holder, text, linked in found:
        if holder.named is not None and _reads(holder, text, linked):
            holder.named.prose = True
    for n in reversed(nodes):
        if n.named is n and n.prose and n.parent.named is not None:
            n.parent.named.prose = True
    for n in nodes[1:]:
        if n.form is n:
            n.gone = not n.titled and n.chars - n.linked < CHARS_A_FIELD * n.fields
        elif n.named is n:
            n.gone = not n.prose or _density(n) >= 0.25 or bool(n.fields) or n.parent.named is not None and n.parent.named.gone
    return [x for x in found if not (x[0].form is not None and x[0].form.gone or x[0].named is not None and x[0].named.gone)]


def extract(html: str | None) -> str:
    """The main text: the kept blocks in page order, one a line; empty if there is none."""
    found, nodes = blocks_of(html or "")
    found = _judged(found, nodes)
    scored = [x for x in found if x[0].header is None]
    if not scored:
        return ""
    _sums(scored, nodes)
    for holder, text, _ in scored:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        parent = holder if holder.tag in HOLDERS or holder.parent is None else holder.parent
        parent.points += points
        if parent.parent is not None:
            parent.parent.points += points / 2
    final = lambda n: n.points * (1 - _density(n)) + 25 * (n.tag in ARTICLE and n.chars > 0)
    best = max(nodes, key=final)  # the first of equals
    while best.tag in PARTS and best.parent is not None:
        best = best.parent
    # the child of best's parent that each block stands in, and whether it is kept
    side: dict[Node, Node | None] = {}
    for n in nodes:
        side[n] = n if n.parent is best.parent else side[n.parent] if n.parent is not None else None
    floor, kept = max(10.0, 0.2 * final(best)), {best: True}
    has_title, prose = False, set()
    for holder, text, linked in scored:
        has_title = has_title or holder.tag == "h1" and side[holder] is best
        if _reads(holder, text, linked):
            prose.add(side[holder])
    out = []
    for holder, text, linked in found:
        n = side[holder]
        if holder.header is not None:
            # its own title, if it has no other, and not that of the whole page
            h = holder.header
            own = n is best and best.tag not in ("body", "html", "#root")
            if own and h.titled and not h.fields and not has_title and linked <= len(text) / 2:
                out.append(text)
            continue
        if best.parent is None:
            out.append(text)
            continue
        if n is None:
            continue
        if n not in kept:
            same = n.tag == best.tag and n.names == best.names and (n.tag == "article" or bool(n.names))
            kept[n] = same or _density(n) < 0.25 and (final(n) >= floor or n in prose)
        if kept[n] or _reads(holder, text, linked):
            out.append(text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) per page.

    Null and empty html give an empty text; broken markup is read as far as it goes (a page that ends within a tag loses that tag); repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(x if isinstance(x, str) else None) for x in b["h"]]
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"].array, "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select("page_id", "url", F.col(html).alias("h")).mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
