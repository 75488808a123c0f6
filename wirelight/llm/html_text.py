"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. The text lengths of lines
are summed over a sliding window; where the sums surge from nothing to much text
the main part starts, and where they last dive back to nothing it ends. Headers,
footers, sidebars, notices, adverts, forms and reader comments don't take part,
nor do lines outside of the page's article where it has one. Menus, which are
lines of short links, count as empty.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3
MENU = 25  # characters a link, on average, below which a line of links is a menu
SURGE = 80  # characters in a window, outside of a marked article

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# HTML's block elements, and names that mark what isn't the article.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be missing: those that a start tag closes, and where the search for them ends.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ENDS = {tag: frozenset(ends.split()) for tag, ends in ENDS.items()} | dict.fromkeys(("thead", "tbody", "tfoot"), frozenset("thead tbody tfoot tr td th".split()))
LISTS = frozenset("ul ol dl menu table article main section nav aside".split())
SCOPES = {tag: frozenset(["table"]) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else LISTS for tag in ENDS}
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
MARKS = (
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|dialog|disqus|footer|form|gdpr|header|masthead|menu|modal|nav|navbar"
    r"|navigation|newsletter|notices?|popup|promo|related|replies|responses|search|share|sharing|sidebar|social|sponsored|sponsor|subscribe|toolbar|widget"
)
# A whole name marks, also one made of such words and of words that only tell a place or a part.
PLACES = r"site|global|main|primary|secondary|top|bottom|list|items?|box|bar|area|block|slot|inner|links?|section|body|buttons?|thread|[0-9]+"
NAMED = re.compile(rf"(?<!\S)(?:(?:{PLACES})[_-]+)*(?:{MARKS})(?:[_-]+(?:{MARKS}|{PLACES}))*(?!\S)", re.I)
COMMENTS = re.compile(r"(?<!\S)(?:(?:post|entry|article|page|reader|user)[_-]+)?(?:comments?|disqus|replies|responses)(?:[_-]+(?:list|items?|box|area|block|inner|section|body|thread|form|[0-9]+))*(?!\S)", re.I)
SPACE = re.compile(r"\s+")


def lines(page: str) -> list[tuple[str, bool, int, bool]]:
    """Each block's text, whether it is part of the page's furniture, its article, and whether it looks like a menu.

    The article is 0 outside of any, 2 inside, and 1 inside of one that lies in furniture.
    """
    out: list[tuple[str, bool, int, bool]] = []
    # tag, furniture, furniture that an article in it can't undo, article
    stack: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    links, linked, anchors = 0, 0, 0

    def flush() -> None:
        nonlocal linked, anchors
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                dull, inside = (stack[-1][1], stack[-1][3]) if stack else (False, 0)
                out.append((text, dull, inside, linked > 0.5 * len(text) and linked < MENU * max(anchors, 1)))
            parts.clear()
        linked = anchors = 0

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += links and m.start() - at
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"] and m["raw"].lower() not in ("svg", "object"):
                flush()
            continue
        tag, end = tag.lower(), bool(m["end"])
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if end else 1
            anchors += links
        if tag in INLINE:
            continue
        flush()
        if tag in VOID or tag == "head":
            continue
        if end:
            scope = SCOPES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in scope:
                    break
            continue
        if stack and stack[-1][0] == "p":
            del stack[-1]
        if tag in ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SCOPES[tag]:
                    break
                if stack[i][0] in ENDS[tag]:
                    del stack[i:]
        dull, firm, inside = stack[-1][1:] if stack else (False, False, 0)
        names = " ".join(x for g in NAMES.findall(m["rest"]) for x in g if x) if m["rest"] else ""
        if tag in ("article", "main"):
            firm = firm or bool(names and COMMENTS.search(names))
            if not inside:
                inside = 1 if dull else 2
                dull = False
            dull = dull or firm
        elif tag not in ("html", "body"):
            firm = firm or tag in OUTSIDE or bool(names and COMMENTS.search(names))
            dull = dull or firm or (tag == "header" and not inside) or bool(names and NAMED.search(names))
        stack.append((tag, dull, firm, inside))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """Blocks from the first surge to the last dive of the line-block distribution, joined by line feeds; of a marked article all blocks.

    Furniture is no gap. A span counts if a window in it surges; between the first
    and the last such span only menus of `WINDOW` and more lines are left out.
    """
    found = [(text, inside, menu) for text, dull, inside, menu in lines(page or "") if not dull]
    article = max((inside for _, inside, _ in found), default=0)
    if article:
        return "\n".join(text for text, inside, _ in found if inside == article)
    sizes = [0 if menu else len(text) for text, _, menu in found]
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    spans, i = [], 0
    while i < len(sums):
        start = i
        while i < len(sums) and sums[i]:
            i += 1
        if i > start and max(sums[start:i]) >= SURGE:
            spans.append((start, i))
        i = max(i, start + 1)
    first, last = (spans[0][0], spans[-1][1]) if spans else (0, len(sizes))
    full = [i for i in range(first, last) if sizes[i]]
    kept = full[:1]
    for i in full[1:]:
        kept.extend(range(kept[-1] + 1, i) if i - kept[-1] <= WINDOW else ())
        kept.append(i)
    return "\n".join(found[i][0] for i in kept)


def extract(page: Column) -> Column:
    """The main text of a page's whole html; a NULL, empty or textless page gives the empty string."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return of(F.coalesce(page.cast("string"), F.lit("")))
