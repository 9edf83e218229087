"""Main text of web pages by two-pass block rules.

The first pass cuts a page into blocks and decides those it can: a block in a
menu, header, footer, sidebar, form, notice, advert or comment section, one
that says no more than a label of such a section, or one that is mostly links,
is boilerplate; a block of some length is content if stop words are dense
enough in it, and outside any article boilerplate if they aren't. All others,
the short ones above all, stay open. In the second pass an open block takes
the label of its nearest decided neighbours.

Inside the article its own blocks alone are neighbours, those of sections that
were taken out of it are not, and its edges count as content: an open block
there is boilerplate where both neighbours are, else content. Outside any
article both sides must agree, or the nearer one decides. Where the article
has a block that is content by itself, nothing outside belongs to the text;
else long blocks outside are judged as on a page without an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    (
        "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with "
        "au aux avec ce ces dans de des du elle en est et il la le les mais ne on ou par pas pour qui que sur un une "
        "als am auch auf das dem den der des die durch ein eine einer es für im ist mit nach nicht oder sich sie und von zu "
        "al como con del e el ella es esta ha las lo los más me no o para pero por se su sus una y"
    ).split()
)
#: Elements whose text is never part of the main text.
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form select button textarea "
    "dialog menu audio video map title".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
# Names of class, id and role that mark a container as boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies "
    "reply responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split()
)
# Words that such a name can have beside a mark and still be one (``left-sidebar``, ``ad-slot``).
BESIDE = frozenset(
    "alert area bar block bottom box button buttons column container content cloud global icons inner item items left "
    "level link links list main message mobile nav outer page panel policy posts primary right row secondary section site "
    "slot sticky strip sub text thread top unit user wrap wrapper zone".split()
)
# Words that go with names of comment sections only.
COMMENTS, OF_ARTICLE = frozenset("comment comments disqus replies responses".split()), frozenset("article entry post story".split())
# Blocks that say only this are labels of adverts and of buttons.
LABELS = frozenset(
    (
        "advertisement|advertisements|advert|ad|sponsored|sponsored content|promoted|promoted content|share|share this|"
        "share this article|share this page|share this post|tweet|print|email|subscribe|subscribe now|sign up|log in|login|"
        "read more|read also|related|related articles|related posts|leave a comment|leave a reply|comments|no comments|"
        "skip to content|back to top|continue reading|anzeige|werbung|publicité|publicidad|anuncio"
    ).split("|")
)
#: Containers of comments and of other articles' teasers: an article or main element in them is part of them.
CLOSED = frozenset("comment comments disqus promoted related replies reply responses sponsored".split())
#: Blocks under so many characters are left to the second pass.
SHORT = 70
#: Share of a block's characters inside links above which it is boilerplate.
LINK_DENSITY = 0.5
#: Share of stop words from which a block outside any article is content.
STOP_DENSITY = 0.12

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    dropped: bool
    in_article: bool
    content: bool | None = None


def _marked(attributes: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a whole name in class, id or role is a mark.

    A name of several terms is one if each of them is a mark or a word that goes
    with marks: ``ad-slot`` and ``left-sidebar`` are, ``entry-header``,
    ``has-sidebar`` and ``search-results`` are about something else.
    """
    for _, a, b, c in _NAMED.findall(attributes):
        for name in (a or b or c).lower().split():
            parts = [p for p in _PARTS.findall(name) if len(p) > 1 or len(name) == 1]
            beside = BESIDE | OF_ARTICLE if COMMENTS.intersection(parts) else BESIDE
            if any(p in marks for p in parts) and all(p in MARKS or p in beside for p in parts):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with white space folded; empty ones left out."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, dropped, in the article, dropped with any article in it
    parts: list[str] = []
    links = 0
    anchors = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            _, dropped, inside, _ = stack[-1] if stack else ("", False, False, False)
            found.append(Block(text, links, dropped, inside))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if anchors:
            links += len("".join(text.split()))

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            anchors = 0 if closing else 1
        if closing:
            if name not in INLINE:
                close()
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if deep is not None:
                if name not in INLINE or deep == len(stack) - 1:
                    close() if stack[deep][1] else None
                    del stack[deep:]
            continue
        if name not in INLINE:
            close()
            while stack and stack[-1][0] in ("p", *(["li"] if name == "li" else [])) and name not in VOID:
                stack.pop()
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE and name in ("br", "hr"):
            continue
        _, dropped, inside, shut = stack[-1] if stack else ("", False, False, False)
        opens = name in ("article", "main")
        article = inside or opens
        marked = _marked(attributes) if attributes and name not in ("body", "html", "article", "main") else False
        if name in ("article",) and attributes and _marked(attributes) and inside:
            marked = True
        # a mark of an outer wrapper doesn't reach the article in it; what an element or a closed section drops stays so
        held = dropped and (shut or inside or not opens)
        gone = held or name in DROPPED or marked or (name == "header" and not inside)
        shut = held and shut or name in DROPPED or marked and (inside or _marked(attributes, CLOSED))
        if name in INLINE:
            if gone != dropped:  # an advert or a notice in an inline element is a block of its own
                close()
                stack.append((name, gone, article, shut))
            continue
        stack.append((name, gone, article, shut))
    close()
    return found


def judge(block: Block) -> bool | None:
    """First pass: whether the block is content by itself, None if that can't be said."""
    letters = len("".join(block.text.split()))
    if block.dropped or block.link_chars > LINK_DENSITY * letters:
        return False
    if " ".join(_LETTERS.findall(block.text.lower())) in LABELS:
        return False
    if len(block.text) < SHORT:
        return None
    spoken = [w.lower() for w in _LETTERS.findall(block.text)]
    if spoken and sum(w in STOP_WORDS for w in spoken) >= STOP_DENSITY * len(spoken):
        return True
    return None if block.in_article else False


def classify(found: list[Block]) -> list[Block]:
    """Sets ``content`` of every block; see the module's description."""
    decided = [judge(b) for b in found]
    article = any(b.in_article and not b.dropped for b in found)
    alone = any(b.in_article and d for b, d in zip(found, decided, strict=True))
    for b, d in zip(found, decided, strict=True):
        b.content = bool(d) and (b.in_article or not alone)
    inside = [i for i, b in enumerate(found) if b.in_article and not b.dropped]
    for i, before, after in _neighbours(decided, inside):
        found[i].content = before is None or after is None or bool(decided[before] or decided[after])
    if not article:
        for i, before, after in _neighbours(decided, list(range(len(found)))):
            near = [j for j in (before, after) if j is not None]
            # of two the nearer one, of two as near the first
            found[i].content = bool(decided[min(near, key=lambda j: abs(j - i))]) if near else True
    return found


def _neighbours(decided: list[bool | None], among: list[int]) -> Iterator[tuple[int, int | None, int | None]]:
    """Each open block of ``among`` with its nearest decided ones before and after in it."""
    after: list[int | None] = []
    last = None
    for i in reversed(among):
        last = i if decided[i] is not None else last
        after.append(last)
    last = None
    for i, following in zip(among, reversed(after), strict=True):
        if decided[i] is None:
            yield i, last, following
        else:
            last = i


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page)) if b.content) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, in the order of the input.

    Defined cases: null or empty html gives the empty text; null identifiers and
    urls are passed on; repeated rows give repeated results; markup that ends
    early, unclosed elements and stray ``<`` are read as far as they go; pages of
    any length are read whole; an empty table gives no rows; extra columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    src = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html"),
    )
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
