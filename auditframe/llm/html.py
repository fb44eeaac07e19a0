"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its root-to-leaf tag path. Text length, punctuation
and link text are summed per path; the ratios per node are smoothed over the blocks in page order, more
between like paths, and fused with what tag and class names say of the path. Paths above the threshold
are content, on pages with marks like <article> as on others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from auditframe.llm.common import text_slices
from auditframe.session import ship

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؛؟·«»\"“”()]").findall

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_SILENT = frozenset("script style noscript template svg iframe object canvas select button textarea title math audio video head".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tags that end an open paragraph.
_ENDS_P = _BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
#: Start tags that end an open element of the given kinds, up to a border.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Parts of class, id and role values that name page furniture.
_NAMES = frozenset(
    "nav navbar navigation menu header masthead topbar footer contentinfo sidebar aside complementary ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond replies reply disqus"
    " social share sharing related recommended breadcrumb breadcrumbs widget pagination pager search toolbar skip".split()
)
#: Parts that name cards, but wrappers of the main content too.
_CARDS = frozenset("card cards teaser teasers tile tiles".split())
_COMMENTS = frozenset("comment comments respond replies reply disqus".split())
_CONTENT = frozenset({"article", "main"})
#: An <article> in one of these is a card.
_BESIDE = frozenset("nav header footer aside menu dialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that hold an article's own text, where div or section may hold anything.
_TEXT_TAGS = frozenset("p li dt dd td th blockquote pre figcaption caption summary".split()) | _HEADINGS
#: Terms of the fused score beside the ratio (0 to 1): marked content, a text tag in it, text beside the
#: marked content, a card, and the share of link text.
_INSIDE, _TEXT_TAG, _OUTSIDE, _CARD, _LINKS = 0.2, 0.3, -0.4, -0.8, -0.5
_THRESHOLD = 0.5
_SPLIT_NAME = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "path", "parent", "silent", "furniture", "named", "wholly", "card", "content", "holds_content", "inline")

    def __init__(self, tag: str, parent: _Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.inline = tag not in _BLOCKS
        self.path = parent.path if self.inline and parent else (f"{parent.path}/{tag}" if parent else tag)
        self.silent = bool(parent and parent.silent) or tag in _SILENT
        self.furniture = self.named = self.wholly = self.card = self.content = self.holds_content = False


def _names(attrs: str) -> tuple[list[set[str]], bool]:
    """Parts of each class, id and role, and whether the element is hidden."""
    found: list[set[str]] = []
    hidden = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in {"class", "id", "role"}:
            found += [parts for word in value.split() if (parts := {x for x in _SPLIT_NAME.split(word) if x})]
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return found, hidden


def parse_blocks(page: str) -> list[tuple[str, _Element, int]]:
    """Blocks of a page in order: text with white space made one blank, the block's element, characters in links."""
    root = _Element("html", None)
    stack = [root]
    blocks: list[tuple[str, _Element, int]] = []
    held: list[str] = []
    marks: list[tuple[int, _Element]] = []
    links = in_link = 0
    holder = root
    lower = None

    def flush() -> None:
        nonlocal held, links
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            blocks.append((text, holder, links))
        held, links = [], 0

    def add(text: str) -> None:
        nonlocal links, holder
        top = stack[-1]
        if top.silent:
            return
        if not held:
            holder = top
            while holder.inline and holder.parent:
                holder = holder.parent
        held.append(text)
        if in_link:
            links += len(text)

    def close(k: int) -> None:
        nonlocal in_link
        for e in stack[k:]:
            if e.tag == "a":
                in_link = max(0, in_link - 1)
        if any(not e.inline for e in stack[k:]):
            flush()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(html.escape(m["cdata"]))
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                add(" ")
            elif tag == "p" and not any(e.tag == "p" for e in stack):
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in _BLOCKS and not stack[k].inline:
                        break  # an inline end tag does not reach out of its block
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in {"html", "body"}:
            if tag == "body" and all(e.tag != "body" for e in stack):
                for k in range(1, len(stack)):
                    if stack[k].tag == "head":
                        close(k)
                        break
                stack.append(_Element(tag, stack[-1]))
            continue
        if tag in _BLOCKS and stack[-1].silent:
            for k in range(1, len(stack)):
                if stack[k].tag == "head":  # a block ends an unclosed head
                    close(k)
                    break
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if not stack[k].inline:
                    break
        if tag in _IMPLIED:
            kinds, border = _IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in kinds:
                    close(k)
                    break
                if stack[k].tag in border:
                    break
        if tag in _VOID:
            if tag in {"br", "wbr"}:
                add(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in _BLOCKS:
            flush()
        element = _Element(tag, stack[-1])
        if tag in _FURNITURE:
            element.furniture = True
        words, hidden = _names(attrs) if attrs.strip() else ([], False)
        names = set().union(*words)
        if hidden:
            element.silent = True
        # "main-menu" or "ad" name nothing but furniture; "has-sidebar" may be said of a wrapper.
        element.wholly = any(parts & _NAMES and parts <= _NAMES | {"main"} for parts in words)
        element.card = not names.isdisjoint(_CARDS)
        main = tag in {"div", "section"} and any("main" in parts and not parts & _NAMES for parts in words)
        if (tag in _CONTENT or main) and not element.wholly and not names & _COMMENTS:
            if tag == "article" and any(e.tag in _BESIDE for e in stack):
                element.named = True
            else:
                rank = max(2 * e.wholly or int(e.named) for e in stack)
                if tag in _CONTENT or not rank:
                    marks.append((max(rank, int(element.card and tag == "article")), element))
        elif names & _NAMES:
            element.named = True
        if tag == "a":
            in_link += 1
        if not attrs.rstrip().endswith("/") or tag in _BLOCKS or tag in _SILENT:
            stack.append(element)
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{tag}", at)
            at = size if end < 0 else end
    flush()
    # The marks with the least doubt hold the content, among articles and among the others; other articles are cards.
    for kind in (True, False):
        own = [(rank, e) for rank, e in marks if (e.tag == "article") == kind]
        for rank, e in own:
            if rank > min(own, key=lambda x: x[0])[0]:
                e.named = True
                continue
            e.content = True
            up = e.parent
            while up is not None:
                up.holds_content, up = True, up.parent
    return blocks


def _articles(element: _Element | None) -> list[_Element]:
    """The articles around an element, the nearest first."""
    found = []
    while element is not None:
        if element.tag == "article":
            found.append(element)
        element = element.parent
    return found


def _drop_nested(blocks: list[tuple[str, _Element, int]]) -> None:
    """Articles within an article that has more text of its own are comments or cards."""
    own: dict[_Element, int] = {}
    for text, element, _ in blocks:
        if around := _articles(element):
            own[around[0]] = own.get(around[0], 0) + len(text)
    for e, chars in own.items():
        if any(own.get(outer, 0) > chars for outer in _articles(e.parent)):
            e.content, e.named, e.holds_content = False, True, False


def _place(element: _Element) -> tuple[bool, bool, bool]:
    """Whether the element lies in page furniture, whether in an element for the main content, whether in a card."""
    inside = card = False
    furniture = False
    e: _Element | None = element
    while e is not None:
        if e.content:
            inside = True
        elif e.card and not e.holds_content:
            card = True
        # A header inside the main content is the article's own; a wrapper around it is no furniture.
        if e.furniture and not e.holds_content and not (e.tag == "header" and _within_content(e)):
            furniture = True
        if e.named and not e.holds_content and not e.content:
            furniture = True
        e = e.parent
    return furniture, inside, card


def _within_content(element: _Element) -> bool:
    e = element.parent
    while e is not None:
        if e.content:
            return True
        e = e.parent
    return False


def _distance(a: str, b: str) -> int:
    """Tags to go up from one path and down to the other, the longer of both ways."""
    x, y = a.split("/"), b.split("/")
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return max(len(x), len(y)) - k


def main_text(page: str) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = parse_blocks(page)
    if not blocks:
        return ""
    _drop_nested(blocks)
    known: dict[_Element, tuple[bool, bool, bool]] = {}
    for _, e, _ in blocks:
        if e not in known:
            known[e] = _place(e)
    open_ = [k for k, b in enumerate(blocks) if not known[b[1]][0]]
    if not open_:
        return ""
    marked = any(known[blocks[k][1]][1] for k in open_)
    # Cards count as such beside more other text; a page may lie in one as a whole.
    chars = [0, 0]
    for k in open_:
        _, inside, card = known[blocks[k][1]]
        if inside or not marked:
            chars[card] += len(blocks[k][0])
    # Sums per path and place: nodes, text, punctuation, link text.
    keys: list[tuple[str, bool, bool]] = []
    sums: dict[tuple[str, bool, bool], list[int]] = {}
    for k in open_:
        text, element, links = blocks[k]
        keys.append((element.path, known[element][1], known[element][2] and chars[0] > chars[1]))
        s = sums.setdefault(keys[-1], [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION(text))
        s[3] += links
    ratio = {p: float(np.log1p(s[1] / s[0]) * np.log1p(s[2] / s[0])) * max(0.0, 1 - s[3] / s[1]) for p, s in sums.items()}
    most = max(ratio.values()) or 1.0
    weights: dict[tuple[str, str], float] = {}
    smooth: dict[tuple[str, bool, bool], list[float]] = {}
    for j, key in enumerate(keys):
        total, weight = 0.5 * ratio[key], 0.5
        for other in (keys[max(j - 1, 0)], keys[min(j + 1, len(keys) - 1)]):
            pair = (key[0], other[0])
            w = weights.get(pair)
            if w is None:
                w = weights[pair] = 0.25 * float(np.exp(-2.0 * _distance(*pair)))
            total, weight = total + w * ratio[other], weight + w
        smooth.setdefault(key, []).append(total / weight / most)
    content = {}
    for key, values in smooth.items():
        path, inside, card = key
        links = min(1.0, sums[key][3] / sums[key][1])
        score = sum(values) / len(values) + _CARD * card + _LINKS * links
        if marked:
            score += _INSIDE + _TEXT_TAG * (path.rsplit("/", 1)[-1] in _TEXT_TAGS) if inside else _OUTSIDE
        content[key] = score >= _THRESHOLD - 1e-9 and (inside or links <= 0.5)
    picked = [content[key] for key in keys]
    # Headings belong to the content that follows them at once. Inside marked content one that is a link may be the title.
    titles = {}
    for j, k in enumerate(open_):
        if keys[j][1] and not keys[j][2] and blocks[k][1].tag in _HEADINGS:
            titles.setdefault(next((e for e in _articles(blocks[k][1]) if e.content), None), j)
    for j in range(len(open_) - 2, -1, -1):
        if blocks[open_[j]][1].tag in _HEADINGS and picked[j + 1] and keys[j][1:] == keys[j + 1][1:] and (not blocks[open_[j]][2] or j in titles.values()):
            picked[j] = True
    return "\n\n".join(blocks[k][0] for k, yes in zip(open_, picked, strict=True) if yes)


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add the main text and its length in code points to every page; one pass, no shuffle.

    Null and empty pages have an empty text. Input columns named like an output are replaced,
    others pass through; repeated rows stay repeated.
    """
    ship(pages.sparkSession)
    made = ["text", "n_chars"]
    base = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c == column or c not in made])
    schema = StructType(list(base.schema.fields)).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column):
            texts = [main_text(p) if p else "" for p in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*part.schema.names, *made])

    return base.mapInArrow(run, schema)
