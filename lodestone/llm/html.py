"""Main text of HTML pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures."""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no text, that stand inside a line, that are void, whose ends may be
# left out, that hold the main text or what goes around it; words in class and id names of the latter, and words that
# take this back in the name of a wrapper.
RAW = frozenset("script style noscript template svg math iframe object select textarea button title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 option tr td th thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li dt dd option".split())
AROUND = frozenset("nav aside footer menu dialog head".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion related recommended"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot header"
    " masthead topbar toolbar comment comments commentlist reply replies discussion disqus respond notice notices cookie"
    " cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup signin login share sharing"
    " social tags pagination pager skip toc copyright legal disclaimer".split()
)
#: Names that what a page consists of may bear as well: terms of use, or the dishes of an inn.
TOPICS = frozenset("legal disclaimer copyright menu notice notices alert promotion toc discussion side rail".split())
#: Words that make a name one of the page's layout, and words for a wrapper of what the name's other words say.
LAYOUT = frozenset("no not non has have with without hide by layout page".split())
WRAPPING = frozenset("main body content post entry article wrapper container text story".split())
_QUOTE_OR_END = re.compile(r"=\s*+[\"']|>")
_HREF = re.compile(r"\bhref\b", re.IGNORECASE)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    #: The innermost block-level element: 2 a heading, 1 a paragraph or other, 0 a list's entry.
    tag: int
    #: 2: inside an article, 1: inside a main element, else 0.
    level: int
    #: The innermost element around it that looks like what goes around a main text, -1 for none.
    mark: int


@dataclass(slots=True)
class Marks:
    """Elements that look like what goes around a main text, in page order: how surely each does (``_around``), the one
    that it stands in (-1: none), and whether it or one around it says so for sure."""

    hint: list[int]
    parent: list[int]
    sure: list[bool]

    def add(self, hint: int, parent: int) -> int:
        self.hint.append(hint)
        self.parent.append(parent)
        self.sure.append(hint > 1 or parent >= 0 and self.sure[parent])
        return len(self.hint) - 1


def _named(value: str) -> int:
    """How surely a class or id names what goes around a main text, by its surest token: 4 where all its words say so, 2 where
    they may be a text's topic too, 1 where one does beside a wrapper's; a token with a layout's words says nothing."""
    found = 0
    for token in value.split():
        parts = set(filter(None, re.split(r"[^a-z]+", token)))
        if LAYOUT & parts or not AROUND_NAMES & parts:
            continue
        found = max(found, 1 if parts - AROUND_NAMES else 4 if parts - TOPICS else 2)
    return found


def _around(name: str, attributes: str) -> int:
    """How surely an element goes around the main text: 3 by what it is, 4 or 2 by its name, 1 by a hint that a wrapper may
    give as well."""
    if name in AROUND:
        return 3
    found = 1 if name in ("form", "header") else 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return 3
            if key == "role" and value in AROUND_ROLES:
                found = max(found, 1 if value == "form" else 3)
            elif key in ("class", "id") and name not in ("body", "html"):
                found = max(found, _named(value))
    return found


def _tags(source: str):
    """(start, end, name, closing, attributes) of each piece of markup in order; comments and the like have no name, and
    elements of RAW are one piece. Every character is looked at a bounded number of times: a quote that never closes is
    searched for once."""
    at, size = 0, len(source)
    unclosed: set[str] = set()
    while (start := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), start):
            for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if source.startswith(opening, start):
                    end = source.find(ending, start + len(opening))
                    at = size if end < 0 else end + len(ending)
                    break
            yield start, at, "", False, ""
            continue
        m = _NAME.match(source, start + 1)
        if m is None:
            at = start + 1
            continue
        pos = m.end()
        while True:
            q = _QUOTE_OR_END.search(source, pos)
            if q is None:
                end = size
                break
            if q[0] == ">":
                end = q.end()
                break
            quote = q[0][-1]
            close = -1 if quote in unclosed else source.find(quote, q.end())
            if close < 0:
                unclosed.add(quote)
                pos = q.end()
            else:
                pos = close + 1
        name, closing = m[1].lower(), source[start + 1] == "/"
        attributes = source[m.end() : end - 1]
        at = end
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                over = _ENDS[name].search(source, end)
                over = source.find(">", over.end()) if over else -1
                at = size if over < 0 else over + 1
            name = ""
        yield start, at, name, closing, attributes


def blocks_of(source: str) -> tuple[list[Block], Marks]:
    """The page's text blocks in order, and the marks around them. A block is what stands between two block-level tags,
    references decoded, white space one space, with its words and those of them inside links. A link has an address, and ends
    with the element that it stands in. Each element is opened and closed once, so the time is linear."""
    blocks: list[Block] = []
    marks = Marks([], [], [])
    stack: list[tuple[str, int, int]] = [("", 0, -1)]
    open_: dict[str, list[int]] = {}
    parts: list[str] = []
    linked: list[str] = []
    link, tag = 0, 1  # how deep a link began; 0: outside of links

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                within = len(html.unescape(" ".join(linked)).split()) if linked else 0
                words = text.count(" ") + 1
                blocks.append(Block(text, words, min(within, words), tag, *stack[-1][1:]))
            parts.clear()
        linked.clear()

    def push(name: str, attributes: str) -> None:
        _, level, mark = stack[-1]
        main = 2 if name == "article" else 1 if name == "main" else 0
        if main:
            # An article starts anew, unless it stands in what surely goes around: a reader's comment may be one.
            level, mark = (level, mark) if mark >= 0 and marks.sure[mark] else (max(level, main), -1)
        elif hint := 0 if name == "header" and level else _around(name, attributes):
            mark = marks.add(hint, mark)
        open_.setdefault(name, []).append(len(stack))
        stack.append((name, level, mark))

    def pop(name: str) -> None:
        """Close the innermost open element of this name, and all inside it."""
        nonlocal link
        if not open_.get(name):
            return
        k = open_[name][-1]
        for inner, _, _ in reversed(stack[k:]):
            open_[inner].pop()
        del stack[k:]
        if link > k:
            link = 0

    at = 0
    for start, end, name, closing, attributes in _tags(source):
        if start > at:
            piece = source[at:start]
            parts.append(piece)
            if link:
                linked.append(piece)
        at = end
        if not name:
            continue
        if name == "a":
            if closing or _HREF.search(attributes):
                link = 0 if closing else len(stack)
            continue
        if name in INLINE:
            if closing:
                if stack[-1][0] == name:
                    close()
                    pop(name)
            elif attributes and not attributes.rstrip().endswith("/") and _around(name, attributes) > 1:
                close()
                push(name, attributes)
            continue
        close()
        if name in VOID:
            continue
        tag = 1 if closing else 2 if name in HEADINGS else 0 if name in LISTED else 1
        if name in PARAGRAPHS:
            # Ends of these are often left out, so they are no levels unless they say what they are.
            if closing:
                if stack[-1][0] == name:
                    pop(name)
            elif attributes and _around(name, attributes):
                push(name, attributes)
            continue
        if closing:
            pop(name)
        elif not attributes.rstrip().endswith("/"):
            push(name, attributes)
    parts.append(source[at:])
    if link:
        linked.append(source[at:])
    close()
    return blocks, marks


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "tag", "within", "around",
)


def features_of(blocks: list[Block], marks: Marks) -> np.ndarray:
    """A row for each block: its words and link density, the same of both neighbours, its tag, whether it stands within
    the page's main element, and how many elements around it say that they are not of the main text.

    within: 1 inside an article (or main element, where the page has no article), 0.5 inside main beside an article, 0
    on pages without such an element, -1 outside of it. around: a hint that a wrapper may give counts only where the
    element holds no more than half of the page's words, and a name of TOPICS only where other text is left: what a page
    consists of does not go around it."""
    words = np.array([0, *(b.words for b in blocks), 0], dtype=np.float64)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0])
    plain = np.array([b.words - b.linked for b in blocks], dtype=np.float64)
    level = np.array([b.level for b in blocks])
    whole, best = plain.sum(), 0
    for k in (2, 1):
        held = plain[level >= k].sum()
        if best == 0 and (level >= k).any() and (held >= LEAST_SHARE * whole or whole - held < LEAST_WHOLE):
            best = k
    within = np.where(level >= best, 1.0, np.where(level > 0, 0.5, -1.0)) if best else np.zeros(len(blocks))
    own = np.array([b.mark for b in blocks])
    held = np.zeros(len(marks.hint))
    np.add.at(held, own[own >= 0], plain[own >= 0])
    for k in range(len(held) - 1, -1, -1):  # an element comes after those around it
        if marks.parent[k] >= 0:
            held[marks.parent[k]] += held[k]

    def depth(counts: list[bool]) -> np.ndarray:
        path = np.zeros(len(counts) + 1)
        for k, (c, up) in enumerate(zip(counts, marks.parent, strict=True)):
            path[k] = path[up] + c  # path[-1] stays 0
        return np.minimum(path[own], 2)

    counts = [h > 1 or 2 * n <= whole for h, n in zip(marks.hint, held.tolist(), strict=True)]
    around = depth(counts)
    if plain[around == 0].sum() < ONLY:
        around = depth([c and h != 2 for c, h in zip(counts, marks.hint, strict=True)])
    tag = np.array([b.tag for b in blocks], dtype=np.float64)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], tag, within, around])


#: An article with less than this share of the words is a teaser, if there are this many words beside it.
LEAST_SHARE, LEAST_WHOLE = 0.1, 200
#: Words beside elements with telling names, fewer than which are no text.
ONLY = 5

# The small labelled table: layouts of pages, as elements with their blocks. A block is a label ("+": main text), its
# number of words, and "a" if it is a link, "h" a heading, "l" a list's entry; "al" is a link in a list.
_MENU = "-1al -1al -2al -1al"
_TEXT = "+4h +40 +25 +3 +60 +12 +35 +1 +28 +2 +2 +50"
_SHORT = "+2h +2"
LABELLED = (
    # an article element, with what stands around and inside it
    f"nav[{_MENU}] div[-14] article[{_TEXT}] footer[-9 -1a -1a]",
    f"nav[{_MENU}] div[-9] article[{_SHORT}] footer[-14]",
    "nav[-3al -2al -4al] div[-20] article[+1h +1] footer[-20]",
    "nav[-1al -1al] article[+9h +20 +1 +2 +30 +2 +1 +1 +14 +2 +45 +1] div[-11] footer[-12]",
    "nav[-1al -1al] article[+2h +30 +2]",
    "article[+2]",
    "main[+5h +20 +1]",
    "div[-8] article[+3h +24 +2 +3a +1 +4a +5 +2a +3]",
    "div.top[-1a] main[+2 +3a +30 +5 +4a +1]",
    "article[+2h +3h +40 +3a +1 +2l +1l +6l +2 +50 +2] div[-2 -16]",
    f"header[-2h -6] nav[{_MENU}] article[{_TEXT} aside[-8h -30 -12a] +20 +5a +18] section.comments[-2h -35 -60 -2 -1a]",
    f"article[header[+5h +8] {_TEXT} +3al +4al +5al form[-4 -6] div.share[-1a -1a]] div[-2h -30 -45 -3] footer[-12]",
    f"div.layout.has-sidebar[article[{_TEXT}]] div.sidebar[-20 -6a -7a]",
    f"form[header[-3] article[{_TEXT} ul[+8l +9l +4l]] div[-40]]",
    f"article[{_TEXT} section.comments[article[-40 -30] article[-12]]]",
    # a main element
    f"header[-3h -7 nav[{_MENU}]] main[+5h {_TEXT} +6a] aside[-15 -40 -60] footer[-30 -22]",
    f"main[+6h article[{_TEXT}] div[-25 -3] div[-14 -2] div.related[-5a -6a]] footer[-4]",
    f"main[div.side-by-side[{_TEXT} +30]] div[-18 -30]",
    "main[+2 +1 +12 +2a] div[-11 -2]",
    # neither, but names that tell
    f"div.header[-3 -8] div.menu[{_MENU}] div.content[{_TEXT} +4 +22] div.sidebar[-30 -12 -45] div.comments[-35 -8 -50] div.footer[-25 -1a]",
    f"div.cookie-notice[-45 -2a] div.entry[{_TEXT} +9 +3h +50] div.advert[-12] div.share-buttons[-1a -1a -1a] div.newsletter[-16 -3]",
    f"div.post.no-comments[div.entry[{_TEXT}]] div.copyright[-14 -9]",
    f"div.page-with-sidebar[div[{_TEXT} +15]] div.widget[-3h -8a -9a -20]",
    # nor names: words and links of a block and its neighbours
    f"div[{_MENU}] div[+5h +45 +30 +4 +50 +9 +38] div[-1a -1a -2a]",
    "div[-2a -2a -3a -1a] div[+60 +28 +14 +70] div[-2 -1a -1a] div[-3a -6a -8a -9a -10a -7a -8a]",
    "div[-5a -7a -8a -7a -9a -8a -10a] div[+7h +80 +33 +21 +64] div[-1a -3 -1a -2]",
    "div[-1a -1a -1a] div[+120 +45 +7 +90 +30] div[-2a -2a] div[-6a -5a -8a -11a -6a -9a]",
    "div[-3 -1a -2a] div[+4h +55 +6 +48 +17 +36] div[-1a -1a -4]",
    "div[-2 -1a -1a -1a] div[+3h +30 +44 +8h +26 +52] div[-12a -9a -14a -11a -13a]",
    "div[+6h +75 +40 +22]",
    "div[+30]",
    "div[+12]",
    "div[+3h +8]",
    "div.post.no-comments[div.entry[+11]]",
    "form[div[+13]]",
    "div[+4h +10 +12]",
    "div[+48 +5 +33]",
)


def _example(page: str) -> tuple[str, list[bool]]:
    """A labelled layout as a page, with its blocks' labels."""
    out, label, open_ = [], [], []
    for piece in re.findall(r"[a-z][a-z.-]*\[|\]|[+-][0-9]+[ahl]*", page):
        if piece == "]":
            out.append(f"</{open_.pop()}>")
        elif piece[-1] == "[":
            name, *classes = piece[:-1].split(".")
            open_.append(name)
            out.append(f'<{name} class="{" ".join(classes)}">')
        else:
            n, kinds = re.match(r".([0-9]+)([ahl]*)", piece).groups()
            tag = "h2" if "h" in kinds else "li" if "l" in kinds else "p"
            text = "word " * int(n)
            out.append(f"<{tag}><a href=x>{text}</a></{tag}>" if "a" in kinds else f"<{tag}>{text}</{tag}>")
            label.append(piece[0] == "+")
    return "".join(out), label


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the labelled blocks."""
    pages = [_example(page) for page in LABELLED]
    return np.concatenate([features_of(*blocks_of(page)) for page, _ in pages]), np.concatenate([label for _, label in pages])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A binary decision tree by Gini impurity: (feature, threshold, left, right), or a leaf's verdict."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= cut
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, cut, left)
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, k, cut, left = best
    return k, float(cut), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def verdicts(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    left = x[:, k] <= cut
    out = np.empty(len(x), dtype=bool)
    out[left], out[~left] = verdicts(low, x[left]), verdicts(high, x[~left])
    return out


@functools.cache
def trained():
    return grow(*labelled_table())


def main_text(source: str) -> str:
    blocks, marks = blocks_of(source)
    if not blocks:
        return ""
    keep = verdicts(trained(), features_of(blocks, marks))
    return " ".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(source) for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points, of every row of ``pages(page_id, url, html)``.

    A page is cut into flat blocks; a tree trained on LABELLED keeps those of the main text, judged by their words and
    link density, those of their neighbours, their tag and where they stand (``features_of``). Kept blocks are joined by
    one space in page order; none: an empty text. The time is linear in the page.

    Null and empty pages give an empty text; null ids and urls stay null; repeated rows each give a row; unclosed
    tags, comments and quotes end with the page. Further columns are ignored; an empty table gives no rows.
    """
    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")]
    source = F.coalesce(F.col("html"), F.lit("")).alias("html")
    return pages.select(*cols, source).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
