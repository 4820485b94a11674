"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of tokens: words, which score positive in content-like
places, and tags, which score negative.  The weights are log-odds, learnt from the
labelled pages of ``labelled_pages`` over three features of a token (tag name; the
zone that the word stands in; its block and whether it is linked).  A linear scan
finds the contiguous run of tokens with the largest sum, the content region, which
is widened to whole blocks.  Blocks inside it whose own words sum below zero (an
advert within an article, say) are left out.

A zone is named by an element or by a word of its class, id or role.  A word that is
only part of a longer name gives a weaker zone, with a weight of its own; one beside
a word that names content gives none.  If no run of tokens scores above zero, the
page is read again without the zones that only such words have named, except those
of comments, adverts, notices and forms.

The words of one text run share their features, so the scan runs over text runs and
tags and finds the same region as over single words.

Character references are decoded, white space inside a block becomes one space, the
block is trimmed, and blocks are joined by two line breaks in page order.

Edge cases: null and empty pages give the empty text; a page in which no run of
tokens scores above zero gives the empty text; unclosed tags, stray ``<`` and quotes,
empty and unfinished comments and scripts are read as browsers do, to the end of the
page if need be; pages of any length and depth of nesting are read whole, in linear
time; repeated pages each get their row; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import with_columns_from

# Fixed values of HTML: elements that break blocks, hold raw text, or have no end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
SKIPPED_TAGS = frozenset("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements and words of class, id and role attributes that name a zone.
ZONE_TAGS = {"head": "head", "nav": "menu", "menu": "menu", "footer": "footer", "header": "header", "aside": "side", "form": "form", "button": "form", "select": "form", "dialog": "notice", "fieldset": "form"}
ZONE_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip toolbar topbar",
    "footer": "footer foot",
    "legal": "copyright colophon legal",
    "header": "header masthead banner logo branding",
    "side": "sidebar aside side rail related recommended recommendations trending popular widget widgets complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adslot banner-ad",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast newsletter subscribe subscription paywall signup disclaimer",
    "form": "form search searchbox login signin contact-form",
    "comment": "comment comments commentlist respond reply replies disqus discussion",
    "share": "share sharing social follow byline-share print tags tagcloud",
}
_ZONE_OF = {w: zone for zone, words in ZONE_WORDS.items() for w in words.split()}
#: Words of a class or id that name content.
CONTENT_WORDS = frozenset("article content entry main page post story text".split())
#: These begin content, whatever menu, heading or form was left open before them.
CONTENT_TAGS = frozenset({"article", "main"})
LEFT_OPEN = frozenset({"", "menu", "header", "form", "weak menu", "weak header", "weak form"})
#: Zones whose words name them also as a part of a longer name.
SURE_ZONES = frozenset({"ad", "comment", "footer", "form", "notice", "side"})
#: Elements of other languages than HTML, in which a closing slash counts.
FOREIGN_TAGS = frozenset({"math", "svg"})

# A quote begins a value only behind an equals sign; elsewhere it is part of a name.
_TAG = re.compile(r"""<(?:!--(?:-?>)?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>?|[!?][^>]*>?|/[^>]*>?)""")
_COMMENT_END = re.compile("--!?>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_PART = re.compile(r"[a-z]+")


def _zone(name: str, attributes: str, words: bool = True) -> str | None:
    """The zone that an element opens, if any; without ``words``, by its words only where these are sure."""
    zone = ZONE_TAGS.get(name)
    if not attributes or not attributes.strip():
        return zone
    weak = None
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "hidden" or key.lower() == "aria-hidden" and value == "true":
            return "hidden"
        for word in _WORD.findall(value.replace("_", "-")):
            parts = _PART.findall(word)
            if parts[0] in ("has", "with", "no") or "with" in parts:
                continue  # says what stands beside it
            found = [z for p in parts if (z := _ZONE_OF.get(p))]
            whole = _ZONE_OF.get(word) or (found[0] if len(found) == len(parts) else None)
            if not whole and not found:
                continue
            first = whole or found[0]
            if first not in SURE_ZONES and (not words or not whole and CONTENT_WORDS.intersection(parts)):
                continue
            if whole or first in SURE_ZONES:
                return first
            weak = weak or f"weak {first}"
    return zone or weak


def tokens(page: str, words: bool = True):
    """(kind, features, text) in page order: kind 0 a tag (name, zone), 1 a text run (zone, block, linked); a tag that breaks blocks has text None, else ''."""
    open_: list[tuple[str, str]] = []  # elements that may hold a zone, with the zone inside them
    names: Counter = Counter()  # how many of each name are in it
    block, links, at, size = "body", 0, 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            text = page[at:begin]
            if not text.isspace():
                zone = open_[-1][1] if open_ else ""
                yield 1, (zone, block, links > 0), text
            elif at:
                yield 1, None, " "
        if not m:
            return
        at = m.end()
        closing, name, attributes = m.groups()
        if name is None:
            if m.group() == "<!--":
                end = _COMMENT_END.search(page, at)
                at = end.end() if end else size
            continue
        name = name.lower()
        breaks = name in BLOCK_TAGS
        yield 0, (name, open_[-1][1] if open_ else ""), None if breaks else " " if name in ("br", "td", "th", "img") else ""
        if closing:
            if name == "a":
                links = max(0, links - 1)
            while names[name]:
                last, _ = open_.pop()
                names[last] -= 1
                if last == name:
                    break
            if breaks:
                block = "body"
            continue
        if name in FOREIGN_TAGS and attributes.endswith("/"):
            continue
        if name in SKIPPED_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID_TAGS:
            continue
        if name == "a":
            links += 1
        if breaks:
            block = name
            links = 0 if name in CONTENT_TAGS else links
        if name in ("body", "main") or name in CONTENT_TAGS and (not open_ or open_[-1][1] in LEFT_OPEN):
            open_.clear()
            names.clear()
        zone = _zone(name, attributes, words) if name not in ("html", "body", "main") else None
        if name in CONTENT_TAGS and zone not in SURE_ZONES:
            zone = None
        inherited = open_[-1][1] if open_ else ""
        if zone == "header" and name == "header" and any(n in CONTENT_TAGS for n, _ in open_):
            zone = None  # the heading of an article is part of it
        if zone or breaks and name not in ("p", "li", "dt", "dd", "tr", "option"):
            open_.append((name, zone if zone and inherited.startswith("weak ") else inherited or zone or ""))
            names[name] += 1


def _features(zone: str, block: str, linked: bool) -> tuple[str, str]:
    link = " linked" if linked else ""
    return f"zone {zone}{link if zone.startswith('weak') else ''}", f"block {block}{link}"


_TALK = "the place of the first report was read by many and it was found that the work went on for years".split()


def labelled_pages():
    """Small pages, as (fragment, is content) lists, in the layouts that web pages use."""

    def say(n: int, k: int = 0) -> str:
        return " ".join(_TALK[(k + j) % len(_TALK)] for j in range(n))

    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/w">World</a></li></ul></nav>'
    plain_menu = '<ul><li><a href="/">Home page</a></li><li><a href="/n">All news</a></li></ul>'
    foot = "<footer><p>All rights reserved 2020</p><a href='/t'>Terms of use</a></footer>"
    side = f'<aside><h3>More</h3><ul><li><a href="/1">{say(6)}</a></li><li><a href="/2">{say(5, 3)}</a></li></ul></aside>'
    ad = f'<div class="ad">{say(9, 4)}</div>'
    notice = f'<div class="cookie-notice"><p>{say(14, 2)}</p><button>OK</button></div>'
    talk = f'<div id="comments"><h3>Comments</h3><div class="comment"><p>{say(16, 5)}</p></div><div class="comment"><p>{say(9, 1)}</p></div></div>'
    form = f"<form><label>{say(3)}</label><input name='q'><button>Send</button></form>"
    share = "<div class='share'><a href='#'>Post</a> <a href='#'>Mail</a></div>"
    related = f"<div class='related'><p><a href='/3'>{say(8, 6)}</a></p><p><a href='/4'>{say(7, 9)}</a></p></div>"
    hidden = f'<div hidden>{say(12)}</div>'
    head = "<header><a href='/'>Site name</a><p>A motto for the site</p></header>"
    prose = "".join(f"<p>{say(25 + 7 * k, k)}</p>" for k in range(6))
    rich = f"<h1>{say(7)}</h1><p>{say(30)} <a href='/x'>{say(3)}</a> {say(22)}</p><h2>{say(4)}</h2><p>{say(40)}</p><blockquote>{say(18)}</blockquote><ul><li>{say(9)}</li><li>{say(12, 3)}</li></ul><pre>{say(12)}</pre><table><tr><td>{say(3)}</td><td>{say(4)}</td></tr></table><p>{say(26)}</p>"
    loose = f"<h1>{say(6)}</h1><div>{say(40)}<br>{say(32, 3)}</div><div>{say(28)}</div><section><h3>{say(4)}</h3><dl><dt>{say(2)}</dt><dd>{say(14)}</dd></dl></section>"
    title = "<head><meta charset='utf-8'></head>"
    yield [(title + menu, False), (f"<article><h1>{say(8)}</h1>{prose}</article>", True), (foot, False)]
    yield [(title + head + menu + notice, False), (rich, True), (share + talk + related + foot, False)]
    yield [(title + menu + ad, False), (f"<main>{rich}</main>", True), (side + form + foot, False)]
    yield [(title + plain_menu, False), (loose, True), (ad + talk + form + foot, False)]
    yield [(title + head + side + hidden, False), (f"<div>{prose}</div>", True), (ad, False), (f"<div>{rich}</div>", True), (related + foot, False)]
    yield [(menu, False), (f"{say(60)}<br><br>{say(45, 4)}<h3>{say(3)}</h3>{say(50, 2)}", True), (foot, False)]
    yield [(notice + menu + form, False), (loose + prose, True), (share + side + talk + hidden + foot, False)]
    # Names that say menu or footer in part: links inside them are none of the content, plain blocks are.
    listed = f'<ul class="tags-explained"><li>{say(14)}</li><li>{say(11, 5)}</li></ul><div class="menu-of-day"><p>{say(22, 3)}</p><p>{say(17, 8)}</p></div><div class="logo-history"><p>{say(30, 2)}</p></div><div class="legal-matters"><p>{say(28, 7)}</p></div>'
    links = "".join(f"<li><a href='/{k}'>{say(2, k)}</a></li>" for k in range(6))
    parts = f'<div class="main-nav-list"><ul>{links}</ul></div><div class="top-menu-items"><ul>{links}</ul></div><div class="site-logo"><a href="/">{say(2)}</a></div>'
    bottom = f'<div class="site-footer-area"><p><a href="/a">{say(3)}</a> <a href="/b">{say(3, 2)}</a></p><p>{say(6)}</p></div><ul class="tags-list">{links}</ul><div class="share-links">{links}</div>'
    yield [(title + parts, False), (f"<div>{prose}{listed}{rich}</div>", True), (bottom, False)]
    yield [(parts + form, False), (f"<article>{rich}{listed}{prose}</article>", True), (bottom + foot, False)]


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Log-odds of each feature between content and the rest, on the labelled pages; tags are shifted below zero."""
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in labelled_pages():
        ends, whole = [], ""
        for fragment, content in page:
            whole += fragment
            ends.append((len(whole), content))
        at = 0
        for kind, features, text in tokens(whole):
            if kind == 1 and features is not None:
                at = whole.index(text, at)
                label = next(c for e, c in ends if at < e)
                at += len(text)
                for f in _features(*features):
                    seen[label][f] += len(text.split())
            elif kind == 0:
                at = max(at, whole.index("<", at))
                label = next(c for e, c in ends if at < e)
                seen[label][f"tag {features[0]}"] += 1
                at += 1
    out = {}
    for f in {*seen[True], *seen[False]}:
        kind = f.split(" ")[0]
        yes, no = (sum(v for k, v in seen[x].items() if k.startswith(kind + " ")) for x in (True, False))
        odds = log((seen[True][f] + 0.5) / (yes + 1)) - log((seen[False][f] + 0.5) / (no + 1))
        out[f] = min(-0.05, -0.6 + 0.2 * odds) if kind == "tag" else max(-4.0, min(2.0, odds))
    return out


#: Where the labelled pages say nothing: an unknown tag costs a little, an unknown block gives nothing.
#: What neighbouring zones cost together at most, so that an advert does not cut an article in two.
ZONE_FLOOR = -3.0
UNSEEN = {"tag": -0.6, "zone": -2.0, "block": 0.0}


def _score(features: tuple[str, str, bool], w: dict[str, float]) -> float:
    """Per word: prior for words in the open, less or more by zone and block."""
    zone, block = _features(*features)
    inside = w.get(zone, UNSEEN["zone"])
    return min(inside, 1.0) + 0.5 * w.get(block, UNSEEN["block"]) + (0.5 if not features[0] else 0.0 if features[0].startswith("weak") else -1.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous range with the largest sum, by one scan; empty if no sum is above zero."""
    best = total = 0.0
    first = last = start = 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, first, last = total, start, k + 1
    return first, last


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    return _extract(page, True) or _extract(page, False)


def _extract(page: str, words: bool) -> str:
    w = weights()
    parts, scores, raw, memo, spent = [], [], [], {}, 0.0
    for kind, features, text in tokens(page, words):
        if kind == 0:
            score = w.get(f"tag {features[0]}", UNSEEN["tag"])
        elif features is None:
            score = 0.0
        else:
            each = memo.get(features)
            if each is None:
                each = memo[features] = _score(features, w)
            score = each * len(text.split())
        raw.append(score if kind else 0.0)
        if features and features[1 - kind] and score < 0:  # inside a zone
            score = max(score, ZONE_FLOOR - spent)
            spent += score
        elif kind == 1 and features and not features[0]:
            spent = 0.0
        scores.append(score)
        parts.append((kind, text))
    first, last = best_region(scores)
    while last and last < len(parts) and parts[last][1] is not None:  # to the end of the block
        last += 1
    while first > 0 and parts[first - 1][1] is not None:
        first -= 1
    blocks, run, own = [], [], 0.0

    def close() -> None:
        if run and own >= 0 and (text := " ".join(unescape("".join(run)).split())):
            blocks.append(text)
        run.clear()

    for (kind, text), s in zip(parts[first:last], raw[first:last], strict=True):
        if text is None:
            close()
            own = 0.0
        elif kind == 0:
            run.append(text)
        else:
            run.append(text)
            own += s
    close()
    return "\n\n".join(blocks)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per page; one narrow pass."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def make():
        def work(texts):
            found = [extract(t) for t in texts.strings()]
            return [pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]

        return work

    return with_columns_from(base, "html", [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, keep_text=False)
