"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags and at marked elements. A block's features are the word counts and link
densities of itself and its neighbours, whether it lies in the page's article and whether the page has one, and how its
containers are marked (menu, header, footer, sidebar, notice, advert, form, comments). The labelled table is the blocks of
the small labelled pages below, with features computed as for any page; it trains the tree, at first use, by Gini impurity.
Marks are evidence and no more: a mark by name is lifted where an article or half of the page's words lie in it, and where
there are no marks the counts and densities decide.

Rows: null or empty html = empty text. Unclosed tags, comments and raw elements end with the page. Repeated rows each
give a row. Pages are read whole, however long. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

# Element names and furniture words.
RAW = "script|style|noscript|template|iframe|svg|math|select|textarea|button|title|object|canvas"
BREAKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header hgroup li main menu nav ol section table tbody td th tr ul head".split())
FURNITURE_TAGS = frozenset("aside dialog fieldset footer head menu nav".split())
FURNITURE = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|widget")
#: Before such a word, they say how a page is laid out.
LAYOUT = frozenset("no has with without hide show toggle".split())
#: Class or id names of lists of replies, teasers or boxes, whose articles aren't the page's own.
OTHERS = re.compile(r"(?:sidebar|widget|promo|(?:comments?|replies|related|respond)(?:[_-]\w+)*)")
WHOLE = frozenset("html body main article".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TOKEN = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>|<(?:/?[a-zA-Z]|[!?])[^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements before whose start an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())

FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "mark", "article", "page_has_article", "heading")
#: The labelled pages, one a line. {n} stands for n words, [n] for n linked words; a block's text opens with + (main text) or -.
LABELLED = """
<nav><li>-[1]</li><li>-[1]</li><li>-[2]</li></nav><div class=ad>-{9}</div><article><h1>+{8}</h1><p>+{60}</p><p>+{4}</p><p>+{110}</p><p>+{1}</p></article><footer>-{14}</footer>
<header>-{2}<ul><li>-[1]</li><li>-[3]</li></ul></header><main><h1>+{6}</h1><p>+{35}</p><h2>+{2}</h2><p>+{3} [4] {50}</p><ul><li>+{12}</li><li>+{7}</li></ul><p>+{2}</p></main><div>-{30}</div><div>-{5}</div>
<div>-[1]</div><div>-[1]</div><div>-[1]</div><div>-[2]</div><h1>+{7}</h1><p>+{55}</p><p>+{80}</p><p>+{28}</p><p>+{41} [2]</p><div>-[2]</div><div>-[3]</div><div>-{6}</div>
<div>-{3}</div><div>-[2]</div><div>-[1]</div><div>-{2}</div><p>+{120}</p><p>+{16}</p><p>+{90}</p><h2>+{4}</h2><p>+{70}</p><div>-{4}</div><div>-[1]</div><div>-[1]</div><div>-{3}</div>
<div class=menu>-[1]<p>-[2]</p></div><h1>+{5}</h1><p>+{40}</p><p>+{44}</p><div class=comments><p>-{30}</p><p>-{75}</p><p>-{5}</p></div><div class=footer>-{11}</div>
<div class=cookie-notice>-{25}</div><div id=content><h1>+{9}</h1><p>+{33}</p><div class=advert>-{12}</div><p>+{61}</p><p>+{22}</p></div><div class=sidebar><p>-{20}</p><p>-[4]</p></div>
<div>-[1]</div><article><h1>+{4}</h1><p>+{25}</p><ul><li>-[2]</li><li>-[3]</li><li>-[2]</li><li>-[3]</li></ul><p>+{30} [9]</p><blockquote>+{18}</blockquote><p class=ad>-{20}</p><p>+{90}</p></article><div>-{70}</div><div>-[2]</div>
<article><p>+{15}</p></article>
<article><h1>+{2}</h1><p>+{3}</p><p>+{1}</p><p>+{5}</p><p>+{2}</p><p>+{200}</p><p>+{6}</p><p>+{400}</p><p>+{3}</p><p>+{1}</p></article><div>-{3}</div>
<div>-[1]</div><div>-{12}</div><article><h1>+{10}</h1><p>+{13}</p><p>+{2}</p><p>+{4}</p><p>+{7}</p></article><div>-{16}</div><div>-{130}</div>
<div>-{200}</div><article><h1>+{4}</h1><p>+{1}</p><p>+{2}</p><p>+{140}</p><p>+{1}</p><p>+{5}</p><p>+{6}</p></article><div>-{25}</div><div>-{1}</div>
<article><p>+{2}</p></article><div>-{150}</div>
<article><h1>+{1}</h1><p>+{1}</p></article><p>-{50}</p><p>-{40}</p>
<nav>-[1]</nav><article><h1>+{5}</h1></article><footer>-{9}</footer>
<article><h1>+{3}</h1></article><aside>-{40}</aside>
<p>+{45}</p>
<h1>+{2}</h1><p>+{60}</p><p>+{60}</p>
<h1>+{8}</h1><p>+{130}</p><p>+{25}</p><p>+{20}</p><p>+{180}</p>
<div>-[2]</div><div>-[1]</div><h1>+{1}</h1><p>+{38}</p><p>+{52}</p>
<div>-[2]</div><div>-[4]</div><p>+{65}</p><p>+{29}</p><p>+{150}</p><p>+{42}</p><div>-[2]</div><div>-[2]</div><div>-[1]</div>
<div>-{4}</div><div>-{1}</div><h1>+{10}</h1><p>+{85}</p><p>+{23}</p><p>+{115}</p><div>-{5}</div><div>-{2}</div><div>-[3]</div>
<div>-[3]</div><div>-{5}</div><div>-{3}</div><h1>+{4}</h1><p>+{21}</p><p>+{160}</p><p>+{75}</p><div>-[1]</div><div>-[4]</div>
<div>-[1]</div><div>-{1}</div><h1>+{2}</h1><p>+{50}</p><h2>+{1}</h2><p>+{70}</p><h3>+{3}</h3><p>+{30}</p><div>-{2}</div>
<h2>+{2}</h2><p>+{40}</p><h2>+{3}</h2><p>+{24}</p><div>-{3}</div><div>-[2]</div>
<h1>+{6}</h1><p>+{30}</p>
<div>-[1]</div><div>-[1]</div><div>-{3}</div>
<div>-[3]</div><div>-{2}</div><div>-[5]</div><div>-{4}</div><div>-[2]</div>
<main><h1>+{2}</h1><p>+{8}</p><div class=share>-{2}[3]</div><p>+{12}</p><form>-{4}</form><p>+{6}</p><section class=related-posts><p>-{14}</p><p>-[6]</p></section></main>
<table><td>-[1]</td><td>-[1]</td><td>+{66}<br>+{48}<br>+{31}</td><td>-[2]</td></table><div>-{8}</div>
<div class=social>-[1]</div><article><h1>+{7}</h1><div class=widget>-{19}</div><p>+{3} [1] {2}</p><p>+[2] {9}</p><p>+{14}</p></article><section>-{9}</section>
"""


@lru_cache(1)
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for main text) of the blocks of the labelled pages."""
    x, y = [], []
    for page in LABELLED.split("\n"):
        page = re.sub(r"\{(\d+)\}", lambda m: " word" * int(m[1]), page)
        found = blocks(re.sub(r"\[(\d+)\]", lambda m: " <a href=x>" + " link" * int(m[1]) + "</a>", page))
        if found:
            y += [b[0][0] == "+" for b in found]
            x.append(features([(b[0], b[1] - 1, *b[2:]) for b in found]))  # without the sign
    return np.concatenate(x), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A tree by Gini impurity, of leaves of `least` rows or more: a leaf is 0 or 1, a node (feature, threshold, at most, above)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, f] <= t
            if not least <= low.sum() <= len(x) - least:
                continue
            impurity = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(1)
def tree():
    return grow(*labelled())


def decide(node, x: np.ndarray) -> np.ndarray:
    """The tree's label of each row."""
    if isinstance(node, int):
        return np.full(len(x), node == 1)
    f, t, low, high = node
    return np.where(x[:, f] <= t, decide(low, x), decide(high, x))


def names_furniture(names: str) -> bool:
    """Does a class name or an id say so, in one of the words that `-` and `_` join?"""
    for name in names.lower().split():
        parts = re.split("[-_]+", name)
        if any(FURNITURE.fullmatch(w) and not (k and parts[k - 1] in LAYOUT) for k, w in enumerate(parts)):
            return True
    return False


def marked(tag: str, attrs: str, inside: bool, nested: bool) -> int:
    """How firmly is the element marked as furniture: 0 not, 1 by a class or id, or as a form, which an article in it
    clears, 2 by one that only main clears, 3 for good. Classes and ids of a page's whole text don't count, but those of
    an article in another one (a reader's comment) do.
    """
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return 3
    level = int(tag == "form")
    if attrs and not attrs.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "role" and value.lower() in FURNITURE_ROLES and tag != "form" or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 3
            if name in ("class", "id") and (tag not in WHOLE or nested) and names_furniture(value):
                level = max(level, 2 if any(OTHERS.fullmatch(x) for x in value.lower().split()) else 1)
    return level


class Mark:
    """A marked element and the words in it."""

    def __init__(self, level: int):
        self.level, self.words = level, 0


def blocks(html: str) -> list[tuple[str, int, int, int, bool, bool]]:
    """(text, words, words in links, mark, in an article, a heading) of each block that has text."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, tuple, bool]] = []  # open elements that matter: tag, marks, article (own or inherited)
    marks: tuple = ()
    article = link = heading = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                for m in marks:
                    m.words += n
                out.append((text, n, linked, marks, article, heading))
        parts, linked = [], 0

    def close(k: int):
        nonlocal marks, article, link
        del stack[k:]
        link = False
        _, marks, article = stack[-1] if stack else ("", (), False)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            data = html[at : m.start()]
            parts.append(data)
            if link:
                linked += len(data.split())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and parts:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["end"]
        breaks = tag in BREAKS
        if breaks:
            flush()
            heading = tag in HEADINGS and not m["end"]
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                flush()
                close(k)
            continue
        if stack and stack[-1][0] == "p" and tag in ENDS_P:
            close(len(stack) - 1)
        if tag in VOID:
            continue
        nested = tag == "article" and any(t == tag for t, _, _ in stack)
        level = marked(tag, m["attrs"], article, nested)
        if level or tag in CONTAINERS or (not breaks and any(t == tag for t, _, _ in stack)):
            if level:
                flush()
            least = 1 if tag == "article" and not nested else 2 if tag == "main" else 0
            marks = tuple(x for x in marks if x.level > least) + ((Mark(level),) if level else ())
            article = article or tag in ("article", "main")
            stack.append((tag, marks, article))
    if at < len(html):
        parts.append(html[at:])
    flush()
    half = sum(b[1] for b in out) / 2
    return [(*b[:3], max((m.level for m in b[3] if m.level > 1 or m.words <= half), default=0), *b[4:]) for b in out]


def features(found: list[tuple]) -> np.ndarray:
    words = np.array([b[1] for b in found], float)
    links = np.minimum(np.array([b[2] for b in found], float) / words, 1)
    before = lambda v: np.concatenate([[0], v[:-1]])
    after = lambda v: np.append(v[1:], 0)
    article = np.array([b[4] for b in found], float)
    mark = np.array([b[3] for b in found], float)
    has = np.full(len(found), float((article * (mark == 0)).any()))
    return np.stack([before(words), words, after(words), before(links), links, after(links), mark, article, has, np.array([b[5] for b in found], float)], 1)


def main_text(html: str | None) -> str:
    """The main text's blocks, joined by a space."""
    found = blocks(html or "")
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, decide(tree(), features(found))) if keep)


def extract(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """pages' columns `keep` with text and n_chars."""
    common.small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, f"{fields}, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), "html", ["page_id", "url"])
