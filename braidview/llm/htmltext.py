"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags, in one walk over its tags. Pass one decides blocks by rule: those inside menus, page headers and footers,
sidebars, notices, adverts, forms, comments and the like are out; so are blocks that are mostly link text; longer blocks are in if enough of
their words are stop words, inside the article as outside. The others stay open. In pass two an open block takes the label of the
nearest decided block of its section (article or not); if two are as near and disagree, or there is none, it is in. Where no block of a section is in by rule, long open blocks are.

Names of furniture count at either end of a class, id or role (``ad-slot``, ``main-nav``, ``commentBox``), not in names of layouts (``has-sidebar``, ``content-sidebar-wrap``), and
not on an h1. Inside an article or main element a name decides alone only if it says nothing else (``user_reply``, ``cookieBanner``); with a word of its own (``related-work``,
``share-price``) it merely halves the share of links that is let pass, and the text decides. If every article or main element of a page stands within such names, the names around them are void, but for lists of comments and of other articles. So are
they around the largest part of the running text (``RUNNING`` letters or more) of a page that has none elsewhere.

Defined cases. Null and empty pages give an empty text. Unclosed elements, comments and scripts end with the page; stray closing tags are ignored; a tag without its ``>`` is text.
A slash at the end of a tag closes nothing but void elements. Of furniture inside furniture the ``DEPTH`` innermost names count.
Markup without any block tag is one block. Repeated rows give a row each. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SHORT = 60
LINKS = 0.5
STOPS = 0.12
DEPTH = 50
RUNNING = 500

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in is that it for was on with as be by this are at from or an he have not which but
    le la les de des du et en un une que qui dans pour par sur au est pas plus avec ne se ce il
    der die das und ist von zu den mit sich auf für im ein eine nicht dem des als auch er es an
    el los las del y a se con para por como más pero sus su al lo no o si una
    """.split()
)
# Elements by what they mean for the text.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul
    """.split()
)
OUT = frozenset("nav footer aside form head noscript template iframe object svg button select menu dialog canvas audio video map".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark page furniture.
FURNITURE = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|disclaimer|"
    r"comments?|commentlist|disqus|respond|repl(?:y|ies)|footer|masthead|site-?header|page-?header|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|"
    r"search\w*|pagination|pager|popup|modal|overlay|toolbar|widget|copyright|skip-?link|contentinfo|complementary|navigation)",
    re.I,
)
#: Those that hold articles other than the page's.
OTHERS = re.compile(r"comments?|commentlist|disqus|respond|repl(?:y|ies)|related|recommend\w*", re.I)
#: Parts of class names that tell of a page's layout or state, beside furniture or the lack of it.
LAYOUT = frozenset("has have no not non with without layout off closed disabled".split())
#: Parts of names that say nothing of what is inside.
PLAIN = frozenset(
    """
    area areas bar block body bottom box button buttons card cell column container content footer form global group head header heading holder icon icons in inner input item items left
    link links list main message messages module outer page panel post posts primary reader readers right row secondary section site slot text thread title top unit user users view visitor wrap wrapper
    """.split()
)
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
NAME_END = re.compile(r"[\s/>]")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("doubted", "linked", "main", "marks", "out", "parts")

    def __init__(self, main: bool, out: bool, doubted: bool, marks: tuple[int, ...]) -> None:
        self.parts: list[str] = []
        self.linked, self.main, self.out, self.doubted, self.marks = 0, main, out, doubted, marks


@lru_cache(maxsize=10_000)
def _named_furniture(token: str) -> tuple[str, bool] | None:
    """The furniture that a class, id or role names at its start or end, if any, and whether the name says nothing else."""
    parts = [p.lower() for p in NAME_PARTS.findall(token)]
    low = set(parts)
    if low & LAYOUT or ("content" in low and ("sidebar" in low or {"side", "bar"} <= low)):
        return None
    for n in (1, 2):  # words of two parts: side-bar
        for word, rest in (("-".join(parts[:n]), parts[n:]), ("-".join(parts[-n:]), parts[:-n])):
            if FURNITURE.fullmatch(word):
                return word, all(p in PLAIN or FURNITURE.fullmatch(p) for p in rest)
    return None


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _furniture(attributes: dict[str, str]) -> list[tuple[str, bool]]:
    """The furniture that an element's class, id and role name, and whether they name nothing else."""
    return [w for k in ("class", "id", "role") for t in attributes.get(k, "").split() if (w := _named_furniture(t))]


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """Texts ("", False, text), opening tags (name, False, attributes) and closing tags (name, True, ""), in one walk over the page.

    Comments, declarations and the inside of scripts and the like are left out. A quote in a tag that nothing closes is a letter as any other; a tag that nothing closes is text.
    """
    at, end = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    closers: dict[str, re.Pattern] = {}
    since = 0  # text that is still to be given out
    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 >= end:
            break
        kind = page[start + 1]
        if kind == "!" or kind == "?":
            comment = page.startswith("<!--", start)
            stop = page.find("-->" if comment else ">", start + (4 if comment else 2)) if last[">"] > start else -1
            after = end if stop < 0 else stop + (3 if comment else 1)
            name, closing, inside = "", False, ""
        else:
            closing = kind == "/"
            first = start + 2 if closing else start + 1
            if last[">"] < first or not (page[first].isascii() and page[first].isalpha()):
                at = start + 1
                continue
            stop = page.index(">", first)
            name = page[first:stop]
            if not name.isalnum():
                cut = i = NAME_END.search(page, first).start()
                while True:
                    m = TAG_STOP.search(page, i)
                    if m is None or m[0] == ">":
                        break
                    i = page.index(m[0], m.end()) + 1 if m.end() <= last[m[0]] else m.end()
                name, stop = page[first:cut], m.start() if m else page.index(">", cut)
            inside, after = page[first + len(name) : stop], stop + 1
            name = name.lower()
        if start > since:
            yield "", False, page[since:start]
        at = since = after
        if name:
            yield name, closing, "" if closing else inside
            if name in RAW and not closing:
                close = closers.setdefault(name, re.compile(rf"</{name}(?=[\s/>])", re.I)).search(page, at)
                stop = page.find(">", close.end()) if close else -1
                at = since = end if stop < 0 else stop + 1
    if since < end:
        yield "", False, page[since:]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what their place in the page says of them."""
    found: list[Block] = []
    # name, inside the article, inside furniture, inside a link, inside a doubtful name, and the elements around that are furniture by name only
    open_tags: list[tuple[str, bool, bool, bool, bool, tuple[int, ...]]] = []
    opened: dict[str, int] = {}  # how many of a name are open
    large: list[int] = []  # which of them are block elements
    main = out = link = doubt = False
    marks: tuple[int, ...] = ()
    around: set[int] = set()  # marked elements around an article or main, or such themselves
    clear = False  # an article or main stands outside all furniture
    block: Block | None = None

    def close(k: int) -> None:
        nonlocal main, out, link, doubt, marks
        _, main, out, link, doubt, marks = open_tags[k]
        for x in open_tags[k:]:
            opened[x[0]] -= 1
        del open_tags[k:]
        while large and large[-1] >= k:
            large.pop()

    for number, (name, closing, inside) in enumerate(tokens(page)):
        if not name:
            if block is None:
                block = Block(main, out, doubt, marks)
                found.append(block)
            block.parts.append(inside)
            block.linked += len(inside.strip()) if link else 0
            continue
        if name in BLOCKS:
            block = None
        elif name == "br" and block is not None:
            block.parts.append(" ")
        if closing:
            if opened.get(name):
                k = len(open_tags) - 1
                while open_tags[k][0] != name:
                    k -= 1
                close(k)
                if name in OUT:
                    block = None
            continue
        if name in RAW or name in VOID:
            continue
        if name == "p" and large and open_tags[large[-1]][0] == "p":
            close(large[-1])  # a paragraph ends an unclosed one, and what was left open inside it
        if name == "a" and open_tags and open_tags[-1][0] == "a":
            close(len(open_tags) - 1)
        attributes = _attributes(inside) if inside else {}
        if name in BLOCKS:
            large.append(len(open_tags))
        open_tags.append((name, main, out, link, doubt, marks))
        opened[name] = opened.get(name, 0) + 1
        article = name in ("article", "main")
        if article:
            main = True
        named = _furniture(attributes) if attributes and name not in ("html", "body", "h1") else []
        if main and named:
            whole = [x for x in named if x[1]]
            if not whole:
                doubt, block = True, None
            named = whole
        hidden = attributes and name not in ("html", "body") and ("hidden" in attributes or NO_DISPLAY.search(attributes.get("style", "")))
        if name in OUT or (name == "header" and not main) or hidden or (not article and any(OTHERS.fullmatch(w) for w, _ in named)):
            out = True
            block = None
        elif named:
            marks = (*marks, number)[-DEPTH:]
            block = None
        if article and not out:
            around.update(marks)
            clear = clear or not marks
        if name == "a" and "href" in attributes:
            link = True
    void = set() if clear else around
    for b in found:
        b.marks = tuple(x for x in b.marks if x not in void)
    return found


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0


def decide(text: str, linked: int, out: bool, doubted: bool = False) -> bool | None:
    """Pass one: whether a block is in by its place, links, length and stop words; None if they leave it open."""
    if out or linked > (LINKS / 2 if doubted else LINKS) * len(text):
        return False
    return True if len(text) > SHORT and stop_density(text) >= STOPS else None


def inherit(rows: list[tuple[int, bool, bool, bool | None]]) -> list[bool]:
    """Pass two, over (length, in the article, in furniture, label): an open block takes the label of the nearest decided block of its section.

    It is in if two are as near and disagree, or there is none. Furniture inside the article says nothing of what stands beside it. In a section where no block is in by rule, the
    words are of no language that the list knows: long open blocks are in.
    """
    known = {main for _, main, _, label in rows if label}
    near: list[list[tuple[int, bool]]] = [[] for _ in rows]
    for order in (range(len(rows)), range(len(rows) - 1, -1, -1)):
        last: dict[bool, tuple[int, bool]] = {}
        for i in order:
            _, main, out, label = rows[i]
            if label is None:
                if main in last:
                    near[i].append((abs(i - last[main][0]), last[main][1]))
            elif not (main and out):
                last[main] = (i, label)
    labels = []
    for (size, main, _, label), around in zip(rows, near):
        if label is None:
            closest = {x for d, x in around if d == min(y[0] for y in around)}
            label = closest != {False} or (size > SHORT and main not in known)
        labels.append(label)
    return labels


def _spared(held: list[tuple[Block, str]]) -> set[int]:
    """Elements that are furniture by name, on a page whose running text stands nowhere else: those with most of it, if that is ``RUNNING`` letters at least."""
    inside: dict[int, int] = {}
    for b, text in held:
        if b.marks and decide(text, b.linked, b.out, b.doubted):
            for x in b.marks:
                inside[x] = inside.get(x, 0) + len(text)
    most = max(inside.values(), default=0)
    return {x for x, n in inside.items() if n == most} if most >= RUNNING else set()


def main_text(page: str | None) -> str:
    """The main text of a page, a line per block."""
    if not page:
        return ""
    held = [(b, text) for b in blocks(page) if (text := " ".join(entities.unescape("".join(b.parts)).split()))]
    spared = set() if any(not b.marks and decide(text, b.linked, b.out, b.doubted) for b, text in held) else _spared(held)
    rows = []
    for b, text in held:
        out = b.out or any(x not in spared for x in b.marks)
        rows.append((len(text), b.main, out, decide(text, b.linked, out, b.doubted)))
    return "\n".join(text for (_, text), label in zip(held, inherit(rows)) if label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id url text n_chars`` of every row of ``pages``; no shuffle."""
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return small_batches(rows).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


query = extract
