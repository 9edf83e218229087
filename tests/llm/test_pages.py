"""Main-text extraction: the block rules against a plain second version, and pages of many shapes."""

from __future__ import annotations

import random
import re

import pytest

from oddrank.llm import html_text

LONG = "The story of the town is told in this book and it was read by all of them for many years."
ODD = "Zqx vrmp trrl kkst bnnq plrg xxvd mnop qrst wvxy zzkl prtq hhjk llmn bbvc ddfg ttrw qqpl mmnk vvbx."


def plain_classify(blocks):
    """The rules as the module's description states them, block by block and without shared state."""
    own = []
    for b in blocks:
        letters = len(re.sub(r"\s", "", b.text))
        spoken = [w.lower() for w in re.findall(r"[^\W\d_]+", b.text)]
        dense = bool(spoken) and sum(w in html_text.STOP_WORDS for w in spoken) / len(spoken) >= html_text.STOP_DENSITY
        if b.dropped or b.link_chars > letters / 2 or " ".join(spoken) in html_text.LABELS:
            own.append("bad")
        elif len(b.text) < html_text.SHORT:
            own.append("open")
        else:
            own.append("good" if dense else "open" if b.in_article else "bad")
    article = [b.in_article and not b.dropped for b in blocks]
    settled = any(b.in_article and o == "good" for b, o in zip(blocks, own))
    out = []
    for i, b in enumerate(blocks):
        if own[i] != "open":
            out.append(own[i] == "good" and (b.in_article or not settled))
        elif b.in_article:
            left = next((own[j] for j in range(i - 1, -1, -1) if article[j] and own[j] != "open"), "good")
            right = next((own[j] for j in range(i + 1, len(blocks)) if article[j] and own[j] != "open"), "good")
            out.append("good" in (left, right))
        elif any(article):
            out.append(False)
        else:
            far = sorted((abs(j - i), j) for j in range(len(blocks)) if own[j] != "open")
            sides = [next(((d, j) for d, j in far if (j < i) == before), None) for before in (True, False)]
            sides = [s for s in sides if s]
            out.append(own[min(sides)[1]] == "good" if sides else True)
    return out


def test_classify_against_the_plain_rules():
    rng = random.Random(8)
    texts = [LONG, ODD, "Short one.", "Home", "Share this", "12 345", LONG + " " + LONG, "a", "An other short line of text."]
    for _ in range(3000):
        blocks = []
        for _ in range(rng.randrange(9)):
            text = rng.choice(texts)
            blocks.append(html_text.Block(text, rng.choice([0, 0, 0, len(text), len(text) // 3]), rng.random() < 0.2, rng.random() < 0.5))
        want = plain_classify(blocks)
        assert [b.content for b in html_text.classify(blocks)] == want, blocks


P = f"<p>{LONG}</p>"
SHAPES = {
    "article heading and labels": ('<main><article><header class="entry-header"><h1>Head</h1></header><p>Body</p><p>Advertisement</p><p>Share this</p></article></main>', "Head Body"),
    "wrapper named after a search": (f'<div class="search-results-form post-related">{P}</div><p>tail</p>', f"{LONG} tail"),
    "no article": (f"<div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{P}<p>Short one.</p>{P}</div>", f"{LONG} Short one. {LONG}"),
    "footer, aside, nav": (f"<nav>N</nav><aside>A</aside>{P}<footer>F</footer>", LONG),
    "aside in the article": (f"<article><p>a</p><aside>{P}</aside><p>b</p></article>", "a b"),
    "sections between short lines": ("<article><p>a</p><aside>x</aside><p>b</p><aside>y</aside><p>c</p></article>", "a b c"),
    "links around a short line": ("<article><p>a</p><p><a href=x>one link</a></p><p>between</p><p><a href=y>other link</a></p><p>b</p></article>", "a b"),
    "links before a short line": ("<article><p><a href=x>one link</a></p><p>after</p></article>", "after"),
    "few stop words in the article": (f"<article>{P}<p>{ODD}</p>{P}</article>", f"{LONG} {ODD} {LONG}"),
    "few stop words outside": (f"<div>{P}<p>{ODD}</p></div>", LONG),
    "a teaser beside the article": (f"<div>{P}</div><article><p>{LONG} {LONG}</p></article>", f"{LONG} {LONG}"),
    "a short article and long text outside": (f"<article><h1>Head</h1></article><div>{P}</div>", f"Head {LONG}"),
    "comments after the article": (f'<article>{P}</article><div id="comments"><p>{LONG}</p></div>', LONG),
    "comments in the article": (f'<article>{P}<section class="post-comments"><p>{LONG}</p></section></article>', LONG),
    "cookie notice": (f'<div class="cookie-notice"><p>{LONG}</p></div>{P}', LONG),
    "role names": (f'<div role="navigation"><p>{LONG}</p></div><div role="main">{P}</div><div role="complementary"><p>{LONG}</p></div>', LONG),
    "form": (f"<form><p>{LONG}</p><input><button>Go</button></form>{P}", LONG),
    "inline advert": (f'<article><p>{LONG}<span class="ad">Buy now</span></p></article>', LONG),
    "script, style, comment": ('<article><script>"</p>"</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><noscript><p>no</p></noscript></article>', "yes"),
    "character references": ("<article><p>a &amp; b &lt;c&gt; &#228; &#x41; &nbsp;d &unknown; &eacute;</p></article>", "a & b <c> ä A d &unknown; é"),
    "white space": ("<article><p> a\n\t b <br> c</p>\n\n<p> </p><p>d</p></article>", "a b c d"),
    "unclosed elements": (f"<article><h1>T<p>one<p>two<ul><li>x<li>y</ul><b>bold", "T one two x y bold"),
    "stray signs": ("<article><p>1 < 2 and 3 > 2 <</p></article>", "1 < 2 and 3 > 2 <"),
    "table and lists": ("<article><table><tr><td>a<td>b</table><ol><li>c</li></ol><pre>d\n  e</pre></article>", "a b c d e"),
    "nested article": (f'<article>{P}<div class="related-posts"><article><p>{LONG}</p></article></div></article>', LONG),
    "upper case": ("<ARTICLE><P>a</P><NAV>n</NAV><P>b</P></ARTICLE>", "a b"),
    "only short blocks": ("<p>One.</p><p>Two.</p>", "One. Two."),
    "nothing": ("<nav><a href=x>x</a></nav>", ""),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    page, text = SHAPES[shape]
    assert html_text.main_text(page) == text
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>No</title></head><body>{page}</body></html>") == text


def test_names_are_matched_whole():
    for name in ("ad", "left-sidebar", "site-header", "ad_slot", "comment-list", "post-comments", "x ad", "cookie-notice"):
        assert html_text._marked(f'class="{name}"'), name
    for name in ("entry-header", "has-sidebar", "no-comments", "header-less", "post-related", "shadow", "adequate", "article-header"):
        assert not html_text._marked(f'class="{name}"'), name


def test_a_very_long_page_is_read_whole():
    n = 40_000
    page = "<article>" + "".join(f"<p>Line {i} of the very long text, and all of it is read.</p>" for i in range(n)) + "</article>"
    got = html_text.main_text(page)
    assert got.count("Line") == n and got.endswith(f"Line {n - 1} of the very long text, and all of it is read.")
