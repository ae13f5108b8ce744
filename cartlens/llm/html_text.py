"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides a block by what
holds it (menus, footers, adverts and the like are out), the share of its
characters inside links, its length and the share of stop words. Short blocks
without links, and middling ones, stay undecided; pass two gives each of them
the label of the nearest decided block, inside the article if there is one.
The stop words are English, German, French and Spanish; on a page where no block
reaches their share, long blocks are decided by length and links alone.
A mark by class, id or role does not count on the page itself, on a main element,
or on what is wrapped around the article that has the fewest such marks, and a name
that tells what a page or element has or is laid out as (``has-sidebar``,
``login-page``) is no mark. Where both are there, the article wins over the main
element around it, if the first long block of the main element lies in it.
Inside an article a block goes for its links only if it is little else, and then
decides nothing about its neighbours.
Pages are independent, so this is one map without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: a block with a larger share of characters inside links is out
LINKS = 0.33
#: the same inside an article
ARTICLE_LINKS = 0.9
#: characters from which a block is long enough to be decided
SHORT = 70
#: shares of stop words: text, and perhaps text
DENSE, THIN = 0.25, 0.12

STOP_WORDS = frozenset("""
    the of and to in a is that it for as was with be by on not he his but at are this have from
    or had an they which you were her she all their there been one we who
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
    werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont
    avec son aux elle mais ou comme nous
    el y los del las por con una su para es al lo como más o pero sus le ha me si sin sobre este
    ya entre cuando todo esta ser son dos también fue había
""".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>=]+|=)*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?"""
    r"""|([^<]+|<)""", re.S)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object",
        "annotation", "annotation-xml", "select", "head"}
_OUT = {"nav", "footer", "aside", "form", "header", "menu", "button", "dialog", "fieldset"}
_MAIN = {"article", "main"}
#: tags that no class, id or role marks as not the article
_NEVER = {"html", "body", "main"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCK = _OUT | _MAIN | _HEADING | {
    "address", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "figcaption", "figure", "hr", "html", "label", "legend", "li", "ol", "optgroup", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_EMPTY = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source",
          "track", "wbr", "param"}
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
#: words in a class, id or role that mark what is not the article
_BOILERPLATE = frozenset("""
    ad ads adv advert advertisement adverts advertising banner bottombar breadcrumb breadcrumbs
    comment comments commentlist consent contentinfo cookie cookies copyright disqus dialog
    discussion footer form gdpr header login masthead menu menubar modal nav navbar navigation
    newsletter notice notices notification overlay pagination pager paywall popup promo promoted
    promotion reactions recommended related replies reply respond search share sharing sidebar
    sidebars signup social sponsor sponsored subscribe subscription tags teaser teasers toc
    toolbar topbar widget widgets
""".split())
#: words of a name that tells what is there or how a page is laid out, and last words of such
_STATE = frozenset("no not has have with without".split())
_LAYOUT = frozenset("page layout template".split())
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    out: bool  # inside something that is never part of an article
    main: bool  # inside the article
    heading: bool
    article: bool = False  # inside an article element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def links(self) -> bool:
        """Whether the block is out for its links."""
        return self.linked > (ARTICLE_LINKS if self.main else LINKS) * len(self.text)

    def label(self, words: bool = True) -> bool | None:
        """Pass one: text, not text, or undecided; ``words``: by stop words too."""
        if self.out:
            return False
        n = len(self.text)
        if self.links:
            return False
        if n < SHORT or self.heading:
            return None
        if self.main:
            return True
        w = _LETTERS.findall(self.text.lower())
        if not words:
            return bool(w)
        share = sum(x in STOP_WORDS for x in w) / max(1, len(w))
        return True if share >= DENSE else None if share >= THIN else False


def _named(attributes: str) -> bool:
    """Whether a class, id or role marks an element as not the article."""
    if not attributes:
        return False
    names = " ".join(_NAMES.findall(attributes)).replace("'", " ").replace('"', " ")
    for name in names.split():
        split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()
        words = [x for x in re.split(r"[^a-z]+", split) if x]
        if (not _BOILERPLATE.isdisjoint(words) and _STATE.isdisjoint(words)
                and words[-1] not in _LAYOUT):
            return True
    return False


def _hidden(attributes: str) -> bool:
    return bool(_HIDDEN.search(attributes))


Token = tuple[int, str | None, str, bool, str]


def _tokens(page: str) -> Iterator[Token]:
    """(place, text, tag, whether it closes, attributes) of all runs of text and tags."""
    unclosed: set[str] = set()  # raw elements that nothing closes from here on
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m.group(7) is not None:
            yield m.start(), m.group(7), "", False, ""
            continue
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1) or m.group(4))
        attributes = m.group(3) or m.group(6) or ""
        if name in _RAW and not closing:
            if name not in unclosed and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
                    at = size if name in ("script", "style") else at
            continue
        yield m.start(), None, name, closing, attributes


def _wrappers(tokens: list[Token]) -> set[int]:
    """Places of the elements that are marked by a name but hold the article.

    That is an article or main element under the fewest marks; deeper marks and
    marked elements without an article stay out. Empty if an article has no mark.
    """
    stack: list[tuple[str, int, int, bool]] = []  # tag, place, marks so far, never text
    depth: dict[int, int] = {}  # of marked elements that hold an article
    least, seen = None, 0  # ``seen``: open elements that are known to hold one
    for place, _, name, closing, attributes in tokens:
        if name not in _BLOCK or name in _EMPTY:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            seen = min(seen, len(stack))
            continue
        if stack and stack[-1][0] in ("p", *_HEADING):
            stack.pop()
            seen = min(seen, len(stack))
        _, _, marks, never = stack[-1] if stack else ("", 0, 0, False)
        named = name not in _NEVER and _named(attributes)
        never = never or _hidden(attributes) or name in _OUT
        stack.append((name, place, marks + named, never))
        if name in _MAIN and not never:
            least = marks + named if least is None else min(least, marks + named)
            for i in range(seen, len(stack)):
                if stack[i][2] > (stack[i - 1][2] if i else 0):
                    depth[stack[i][1]] = stack[i][2]
            seen = len(stack)
    return {place for place, marks in depth.items() if marks <= least}


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks, in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open blocks: tag, out, main, article
    tokens = list(_tokens(page))
    lower = page.lower()
    unclosed: dict[str, bool] = {}
    wrappers: set[int] | None = None
    now: Block | None = None
    link = 0

    def ends(name: str) -> bool:
        """Whether the page closes every such element it opens."""
        if name not in unclosed:
            unclosed[name] = lower.count(f"</{name}") >= len(re.findall(rf"<{name}[\s>/]", lower))
        return unclosed[name]

    for place, run, name, closing, attributes in tokens:
        if run is not None:
            if now is None:
                tag, out, main, article = stack[-1] if stack else ("", False, False, False)
                now = Block(out, main, tag in _HEADING, article)
                found.append(now)
            run = html.unescape(run)
            now.parts.append(run)
            if link:
                now.linked += len(run.strip())
        elif name == "a":
            link = 0 if closing else 1
        elif name == "br":
            if now is not None:
                now.parts.append(" ")
        elif name in _BLOCK:
            now, link = None, 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in _EMPTY:
                if stack and stack[-1][0] in ("p", *_HEADING):
                    stack.pop()
                marked = name not in _NEVER and _named(attributes)
                if marked:
                    if wrappers is None:
                        wrappers = _wrappers(tokens)
                    marked = place not in wrappers
                marked = marked or _hidden(attributes)
                if name in _MAIN and not marked:
                    # an element that is never closed ends where the article starts
                    while stack and stack[-1][1] and not ends(stack[-1][0]):
                        stack.pop()
                out, main, article = stack[-1][1:] if stack else (False, False, False)
                begins = name in _MAIN and not out and not marked
                main, article = main or begins, article or (begins and name == "article")
                inner = name == "header" and main  # an article's own header has its heading
                stack.append((name, out or marked or (name in _OUT and not inner), main, article))
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def main_text(page: str | None) -> str:
    """Blocks judged to be the article, joined by two line feeds."""
    all_blocks = blocks(page) if page else []
    if any(b.main and not b.out for b in all_blocks):
        for b in all_blocks:
            b.out = b.out or not b.main
        own = [b for b in all_blocks if not b.out]
        lead = next((i for i, b in enumerate(own) if b.label()), None)
        if lead is not None and own[lead].article:  # headings before it may stand outside
            own = [b for i, b in enumerate(own) if b.article or (b.heading and i < lead)]
    else:
        own = all_blocks
    labels = [b.label() for b in own]
    if True not in labels:
        labels = [b.label(words=False) for b in own]
    before, after, last = [], [], None
    for i, x in enumerate(labels):
        tells = x is not None and not (own[i].main and own[i].links)
        last = (i, x) if tells else last
        before.append(last)
    last = None
    for i in range(len(labels) - 1, -1, -1):
        tells = labels[i] is not None and not (own[i].main and own[i].links)
        last = (i, labels[i]) if tells else last
        after.append(last)
    after.reverse()
    kept = []
    for i, (b, x) in enumerate(zip(own, labels, strict=True)):
        if x is None:
            left, right = before[i], after[i]
            if left is None and right is None:  # nothing is decided: trust the article tag
                x = b.main
            elif left is None or right is None:
                x = (left or right)[1]
            else:
                d, e = i - left[0], right[0] - i
                x = right[1] if e < d or (e == d and b.heading) else left[1]
        if x:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            ) -> DataFrame:
    """The columns ``keep`` of every row, ``text`` (empty if none) and ``n_chars``.

    Null and empty pages give an empty text; repeated rows are extracted one by
    one; broken, cut-off and very long markup is read as far as it goes; an empty
    table stays empty. Columns of ``keep`` named ``text`` or ``n_chars`` give way to
    the extracted ones; other columns of any name may be there.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    rows = pages.select(*keep, F.col(page).alias(fresh("page", pages)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, schema.schema)
