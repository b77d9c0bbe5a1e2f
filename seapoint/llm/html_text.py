"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block. A line carries its text length; a line of furniture (menu,
header, footer, sidebar, advert, form, notice, comments, and whatever stands outside the article
of a page that marks one) and linked text carry none, but a linked heading counts as text. On a page without marks, sums over sliding
windows of ``WINDOW`` lines rise steeply where the article begins (surge). It reaches back over text, furniture and short runs of links to a run of
``WINDOW`` linked lines (a menu), and on to the last line that carries text, whatever stands between: a dive in the middle ends nothing. Of this
range all but furniture is kept, short lines and linked ones too, and so are fewer than ``WINDOW`` linked lines right before or after it.

A page that marks its article (``article``, ``main``) is taken by the mark: all but furniture inside it. Where it has both, ``article``
counts if it holds at least half of the text that ``main`` and ``article`` hold, else both do.

What is furniture: elements for it, hidden ones, and those whose class, role or label has a word for it. Inside an article a class or
role counts only as a whole (``share``, ``comment-list``, ``ad-slot-2``, but not ``share-price``), an id only if it names reader
comments, as ids are slugs of headings elsewhere; outside an article an id counts only as a whole. A heading is never furniture by its names.

Defined cases: null or empty html gives an empty text; a tag that is never closed lasts to the end
of what holds it; a page without any line dense enough keeps the range of all its lines of text, and one of links alone
keeps them; a repeated row gives a row each time; other columns are not looked at.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60

# Elements of HTML by their role.
_DROP = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title datalist dialog".split())
_FURNITURE = frozenset("nav header footer aside form menu fieldset".split())
_ARTICLE = {"main": 1, "article": 2}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements of which an open one ends when another opens beside it.
_ENDED_BY = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
# Words in the class, id or role of furniture.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:nav(?:igation|bar)?|menu|breadcrumbs?|header|masthead|banner|footer|side-?bar|aside|complementary|ads?|advert(?:s|isement|ising)?|"
    r"sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|"
    r"related|recommend(?:ed|ations)?|comments?|respond|replies|reply|disqus|widget|pagination|pager|contentinfo|skip-?link|alert|legal|copyright|toolbar)(?=$|[\s_-])"
)
# Those that make even an article no part of the main one.
_FOREIGN = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|respond|ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|related|recommend(?:ed|ations)?)(?=$|[\s_-])")
# Those that count in an id, even inside an article.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments|respond|replies|disqus)(?=$|[\s_-])")
# Words of a layout that may stand beside those in a class, as in comment-list or ad-slot-2.
_LAYOUT = frozenset(
    "area articles bar block body box btn button buttons card cards container content cta feed form inline inner item items left link links list "
    "module outer panel posts right row section slot stories story thread top bottom unit widget wrap wrapper".split()
)
_HINT_ATTRIBUTES = re.compile(r"""(?i)(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=\s|/|$|=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_SPACE = re.compile(r"\s+")


def _is_whole_hint(name: str, hints: re.Pattern) -> bool:
    """Whether all parts of one class or id are hints or words of a layout, and one is a hint."""
    parts = [p for p in re.split(r"[_-]+", name) if p and not p.isdigit()]
    known = [bool(hints.search(p)) for p in parts]
    return bool(hints.fullmatch(name)) or any(known) and all(k or p in _LAYOUT for k, p in zip(known, parts, strict=True))


def _is_furniture(attributes: str, hints: re.Pattern, in_article: bool) -> bool:
    """Whether attributes say so. Ids are often made of a heading's own words, and so are classes inside an article: a
    word among others tells nothing there, only whole names do.
    """
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for attribute, a, b, c in _HINT_ATTRIBUTES.findall(attributes):
        name, value = attribute.lower(), (a or b or c).lower().strip()
        if name == "id" and in_article:
            found = _is_whole_hint(value, _COMMENTS)
        elif name == "id":
            found = _is_whole_hint(value, hints)
        elif in_article:
            found = any(_is_whole_hint(x, hints) for x in ([value] if name == "aria-label" else value.split()))
        else:
            found = bool(hints.search(value))
        if found:
            return True
    return False


def _lines(page: str) -> list[tuple[str, int, bool, int]]:
    """Blocks as (text, characters outside links, furniture, innermost article mark)."""
    lines: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, bool]] = []  # name, furniture, article, link
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_entities.unescape("".join(parts))).strip()
            if text:
                furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                lines.append((text, max(0, len(text) - linked), furniture, article))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                if any(x[0] in _BLOCK for x in stack[depth:]):
                    flush()
                del stack[depth:]
                return
            # The end of an inline element does not reach over a block.
            if name not in _BLOCK and stack[depth][0] in _BLOCK:
                return

    size = len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        end = token.start() if token else size
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if stack and stack[-1][3] and not any(x[0] in _HEADING for x in stack):
                linked += len(piece)
        if not token:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                parts.append(html_entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        if token[1]:
            if name == "br" or name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            else:
                close(name)
            continue
        if name in _DROP:
            if name in _BLOCK:
                flush()
            ending = _RAW_END.get(name)
            if ending is None:
                ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)
            if not (token[3] or "").endswith("/"):
                found = ending.search(page, at)
                if found:
                    at = found.end()
                elif name in _RAW_END:
                    break
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        for depth in range(len(stack) - 1, -1, -1):
            open_name = stack[depth][0]
            if name in _ENDED_BY.get(open_name, ()):
                del stack[depth:]
                break
            if open_name in _BLOCK:
                break
        furniture, article, link = stack[-1][1:] if stack else (False, 0, False)
        attributes = token[3] or ""
        inside = max(article, _ARTICLE.get(name, 0))
        is_header_of_article = name == "header" and article
        if name in _HEADING:
            # A heading says what its text is; its names are made of its words.
            hinted = bool(_HIDDEN.search(attributes))
        else:
            hinted = name not in ("html", "body") and _is_furniture(attributes, _FOREIGN if name in _ARTICLE else _HINT, article > 0)
        furniture = furniture or (name in _FURNITURE and not is_header_of_article) or hinted
        stack.append((name, furniture, inside, link or name == "a"))
    flush()
    return lines


def _mark(lines: list[tuple[str, int, bool, int]]) -> int:
    """The mark from which on lines are article: that of ``article`` if it holds most marked text, of ``main``, or none."""
    held = [sum(len(t) for t, _, furniture, inside in lines if not furniture and inside >= mark) for mark in (1, 2)]
    return 2 if held[1] and 2 * held[1] >= held[0] else 1 if held[0] else 0


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of one page, its blocks joined by a line feed."""
    if not page:
        return ""
    lines = _lines(page)
    marked = _mark(lines)
    # Furniture has no place among the lines; what is left is text or links.
    lines = [x for x in lines if not x[2] and x[3] >= marked]
    if marked:
        return "\n".join(t for t, *_ in lines)
    weights = [w for _, w, *_ in lines]
    carrying = [i for i, w in enumerate(weights) if w]
    if not carrying:
        return "\n".join(t for t, *_ in lines)
    sums = [sum(weights[i : i + window]) for i in range(len(lines))]
    first = next((i for i, x in enumerate(sums) if x >= surge), carrying[0])
    while not weights[first]:
        first += 1
    for i in reversed([x for x in carrying if x < first]):
        if first - i > window:
            break
        first = i
    last = carrying[-1]
    before = next((i for i in range(first - 1, -1, -1) if weights[i]), -1)
    if first - before - 1 < window:
        first = before + 1
    if len(lines) - last - 1 < window:
        last = len(lines) - 1
    return "\n".join(t for t, *_ in lines[first : last + 1])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # Numbers travel as text, so that a null page_id stays a null.
    text_of = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")]
    return (
        pages.select(*text_of)
        .mapInPandas(extract, "page_id string, url string, text string, n_chars long")
        .withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
    )
