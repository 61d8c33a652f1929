"""HTML main-text extraction by two-pass block rules.

A linear scanner cuts a page into text blocks and notes each block's words, stop words, link text, where it
stands and what its elements are called.  Elements that are page furniture by definition (nav, footer, form, a
role, a hidden state) or by an unmistakable class word leave nothing.  Pass one decides blocks by length,
stop-word density and link density, with lower thresholds in an article or main element, higher ones beside it
and under a class word that is only a hint; runs of short links are menus, short legal and cookie phrases are
notices.  Pass two gives the open ones the label of the nearest decided neighbours on the same side of the
article's border; a heading goes with what follows it, and a line without a sentence's end at the edge of the
content is none of it.  Without any decided block, the border decides.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table

# Element names and class words.
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button canvas audio video".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form dialog menu ul ol dl table figure fieldset details center".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr caption blockquote pre address hr figcaption summary legend thead tbody tfoot head".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr td th".split())
#: Class and id words of elements that are furniture whatever they hold.
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments comentarios consent cookie cookies disqus "
    "footer gdpr kommentare login menu nav navbar navigation newsletter notice pagination popup promoted replies respond sidebar signup "
    "sponsor sponsored subscribe".split()
)
#: Class and id words that only raise the thresholds.
WEAK_WORDS = frozenset("banner masthead modal promo recommended related share sharing social toolbar topbar widget".split())
#: Words that may stand beside those in a hyphenated class without changing what it means.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons container content form group icons inner item items left link links list main mobile outer "
    "page panel post posts reader right row section site slot thread top unit user wrap wrapper".split()
)
#: Beginnings of short notices.
NOTICES = (
    "©", "(c) ", "copyright ", "all rights reserved", "we use cookies", "this site uses cookies", "this website uses cookies",
    "we value your privacy", "accept cookies", "privacy policy", "terms of use", "terms of service", "advertisement", "sponsored",
    "subscribe", "sign up", "log in", "follow us", "share this", "skip to ", "read more", "alle rechte vorbehalten", "wir verwenden cookies",
    "anzeige", "tous droits réservés", "nous utilisons des cookies", "publicité", "todos los derechos reservados", "utilizamos cookies",
    "publicidad",
)
#: Headings of lists of sources, whose short links are content.
SOURCES = frozenset("references reference sources bibliography literature notes quellen literatur références sources bibliographie referencias fuentes".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to "
    "was were what when which who will with you aber als auch auf aus bei das dem den der des die durch ein eine einen einer es "
    "für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wenn wie wird zu zum zur au aux "
    "avec ce cette dans de du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont "
    "sur un une vous al con como del el ella esta está fue ha hay las lo los más muy no o para pero por se si sin su sus también y".split()
)
LONG_WORDS, SHORT_WORDS, MANY_STOPS, SOME_STOPS, MUCH_LINK = 40, 8, 0.25, 0.12, 0.5
#: A menu is a run of so many list items that are links of at most so many words; a notice has at most so many words.
MENU_RUN, MENU_WORDS, NOTICE_WORDS = 3, 4, 25

_tag = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""").match
_class = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_parts = re.compile(r"[-_]+").split
_ended = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""").search


@dataclass(slots=True)
class Block:
    text: str
    words: int
    stops: int
    link_chars: int
    in_article: bool
    heading: bool
    listed: bool
    weak: bool = False


def _named(word: str) -> int:
    """What a class or id word says: 2 furniture, 1 perhaps, 0 nothing.  All parts of a compound must agree."""
    if word in STRONG_WORDS:
        return 2
    if word in WEAK_WORDS:
        return 1
    parts = [x for x in _parts(word) if x and not x.isdigit()]
    told = [2 if x in STRONG_WORDS else 1 if x in WEAK_WORDS else 0 for x in parts]
    return max(told, default=0) if all(t or x in NEUTRAL_WORDS for t, x in zip(told, parts)) else 0


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element is page furniture (2), perhaps (1) or not (0), by its name, role, hidden state, class and id."""
    if name in FURNITURE or name == "header" and not in_article:
        return 2
    if not attrs or name in ("html", "body", "main"):
        return 0
    out = 0
    for key, value in _class.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if key == "role":
            if value in FURNITURE_ROLES and not (value == "banner" and in_article):
                return 2
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return 2
        elif key in ("class", "id"):
            for word in value.split():
                if not in_article and word in ("header", "site-header", "page-header", "top-header"):
                    return 2
                out = max(out, _named(word))
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks outside scripts, styles and page furniture, in page order; linear in the page's length."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, furniture, article: containers, and other elements that are furniture
    open_: dict[str, int] = {}  # elements on the stack by name
    chunks: list[str] = []
    off = art = weak = False
    link = heading = listed = 0
    link_chars = brs = 0
    at, n = 0, len(page)
    gone: set[str] = set()

    def flush() -> None:
        nonlocal link_chars, brs
        if chunks:
            words = "".join(chunks).split()
            if words:
                stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words)
                out.append(Block(" ".join(words), len(words), stops, link_chars, art, heading > 0, listed > 0, weak))
            chunks.clear()
        link_chars = brs = 0

    def drop(k: int) -> None:
        for x, _, _ in stack[k:]:
            open_[x] -= 1
        del stack[k:]

    def close(name: str) -> None:
        if open_.get(name):
            k = len(stack) - 1
            while stack[k][0] != name:
                k -= 1
            drop(k)

    def push(name: str, told: int, article: bool) -> None:
        _, up, up_art = stack[-1] if stack else ("", 0, False)
        stack.append((name, max(up, told), up_art or article))
        open_[name] = open_.get(name, 0) + 1

    while at < n:
        lt = page.find("<", at)
        end = n if lt < 0 else lt
        if end > at and not off:
            chunk = page[at:end]
            if "&" in chunk:
                chunk = _html.unescape(chunk)
            chunks.append(chunk)
            if link:
                link_chars += len(chunk.strip())
            if brs and not chunk.isspace():
                brs = 0
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in "!?" and nxt:
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = _tag(page, lt)
        if m is None:
            if nxt.isalpha() or nxt == "/":
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
            else:  # a bare "<" is text
                if not off:
                    chunks.append("<")
                at = lt + 1
            continue
        at = m.end()
        name, closing = m[1].lower(), nxt == "/"
        if name in RAW:
            if not closing and not m[2].rstrip().endswith("/") and name not in gone:
                stop = _ends[name].search(page, at)
                if stop is None:
                    if name in ("script", "style", "title", "textarea"):
                        at = n
                    else:
                        gone.add(name)
                else:
                    over = page.find(">", stop.end())
                    at = n if over < 0 else over + 1
            if not off:
                chunks.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        if name == "br":
            brs += 1
            if brs > 1:
                flush()
            elif not off:
                chunks.append(" ")
            continue
        if name in ("td", "th"):
            if not off:
                chunks.append(" ")
            continue
        if name not in BLOCKS:
            if closing:
                close(name)
            elif m[2] and name not in EMPTY and _furniture(name, m[2], art) > 1:
                push(name, 2, False)
            off = bool(stack) and stack[-1][1] > 1
            continue
        flush()
        if closing:
            close(name)
        else:
            while stack and stack[-1][0] not in CONTAINERS and (name != "p" or stack[-1][0][0] in "ph") and stack[-1][0] in BLOCKS:
                drop(len(stack) - 1)  # a paragraph, heading or item ends where the next block begins
            told = _furniture(name, m[2], art)
            if name in CONTAINERS or told and name not in EMPTY:
                push(name, told, name in ("article", "main"))
        _, told, art = stack[-1] if stack else ("", 0, False)
        off, weak = told > 1, told == 1
        if name in CONTAINERS:
            listed = any(x[0] in ("ul", "ol") for x in stack[-3:])
            link = 0
        elif name[0] == "h" and name[1:].isdigit():
            heading = 0 if closing else 1
    flush()
    return out


GOOD, BAD, OPEN = 1, 0, 2


def first_pass(found: list[Block]) -> list[tuple[int, str]]:
    """Label and rule of each block by its own figures; open where they do not tell."""
    has_article = any(b.in_article for b in found)
    out = []
    for b in found:
        density = b.link_chars / max(1, len(b.text))
        stops = b.stops / max(1, b.words)
        prose = b.words >= LONG_WORDS and stops >= MANY_STOPS and density < MUCH_LINK / 2
        if b.weak and not prose:
            out.append((BAD, "class hint"))
        elif b.in_article:  # a prior for content
            told = b.words >= SHORT_WORDS and stops >= SOME_STOPS / 2 and density <= 0.9
            out.append((GOOD, "article prose") if told else (OPEN, ""))
        elif density > MUCH_LINK:
            out.append((BAD, "link density"))
        elif b.words <= NOTICE_WORDS and b.text.lower().startswith(NOTICES):
            out.append((BAD, "notice"))
        elif has_article and b.words < LONG_WORDS:  # a prior against content
            out.append((OPEN, ""))
        elif b.words >= LONG_WORDS and stops >= SOME_STOPS:
            out.append((GOOD, "long prose"))
        elif b.words >= SHORT_WORDS and stops >= MANY_STOPS:
            out.append((GOOD, "prose"))
        else:
            out.append((OPEN, ""))
    run: list[int] = []
    for k, b in enumerate([*found, None]):  # menus inside articles; a list under a heading of sources is none
        if b is not None and b.in_article and b.listed and b.words <= MENU_WORDS and b.link_chars > 0.9 * len(b.text):
            run.append(k)
            continue
        if len(run) >= MENU_RUN:
            head = found[run[0] - 1].text.lower().strip(" :.") if run[0] else ""
            if head not in SOURCES:
                for j in run:
                    out[j] = (BAD, "menu")
        run = []
    return out


def classify(found: list[Block]) -> list[tuple[bool, str]]:
    """Whether each block is content, and the rule that told: pass one decides or leaves open, pass two lets open ones inherit."""
    marks = first_pass(found)
    has_article = any(b.in_article for b in found)
    sides = {b.in_article for b, (m, _) in zip(found, marks) if m == GOOD}  # sides of the border with content

    def nearest(order):
        """(label, distance) of the nearest decided block on this side, among blocks of the same membership."""
        out, last = [(None, len(found) + 1)] * len(found), {}
        for k in order:
            own = found[k].in_article
            if own in last:
                out[k] = (marks[last[own]][0], abs(k - last[own]))
            if marks[k][0] != OPEN and not (own and marks[k][0] == BAD):  # what an article holds besides prose tells of itself only
                last[own] = k
        return out

    before, after = nearest(range(len(found))), nearest(reversed(range(len(found))))
    out = []
    for b, (m, rule), (left, back), (right, on) in zip(found, marks, before, after):
        if m == OPEN:
            edge = b.in_article in sides and not b.in_article and b.words < SHORT_WORDS and not b.listed and not _ended(b.text)
            if left is None and right is None:
                m, rule = (GOOD if b.in_article or not has_article else BAD), "membership"
            elif b.heading and not b.in_article:  # a heading belongs to what follows
                m, rule = (right if right is not None else BAD), "heading"
            elif edge and (left, right) != (GOOD, GOOD):
                m, rule = BAD, "edge"
            elif left is None or right is None:
                m, rule = (left if right is None else right), "neighbour"
            elif b.heading:
                m, rule = right, "heading"
            else:  # the nearer one; text goes on from what is before
                m, rule = (left if back <= on else right), "neighbour"
        out.append((m == GOOD, rule))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: content blocks joined by newlines; empty for null or empty pages."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, (good, _) in zip(found, classify(found)) if good)


PAGE_TEXT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points for every page row.

    Null html gives an empty text, null page_id or url stay null, repeated rows stay, an empty table gives
    no rows, other columns are ignored.  Narrow: no shuffle, one page in memory at a time.
    """

    def make():
        def kernel(cols):
            out = []
            for i, url, page in zip(*cols):
                text = main_text(page)
                out.append((i, url, text, len(text)))
            return out

        return kernel

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), make, PAGE_TEXT, slice_rows=64)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
