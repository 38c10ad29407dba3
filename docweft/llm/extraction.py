"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

Markup is cut into flat blocks, the text between two block-level tags. Each block has its own and its neighbours' word
count and link density, and flags for where it stands. A decision tree (pyspark.ml), trained on the small labelled table
below and on pages of labelled layouts, tells content from the rest. The tree has a few dozen nodes at most, whatever the pages, and goes to the tasks
inside the function, so that pages are read once and nothing is shuffled.
"""

from __future__ import annotations

import html
import itertools
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from docweft.llm.common import table

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "main", "chrome", "heading", "item"]

#: Blocks of five pages of the given `pages` (sf0.01, page_id 1, 3, 4, 5 and 6, the last one's first blocks), labelled by hand, as in LABELLED.
REAL = [
    [*[(1, 1, "oci", 0)] * 6, (8, 0, "oc", 0), (7, 0, "mh", 1), *[(n, 0, "m", 1) for n in (7, 22, 33, 30, 45, 5, 31, 1, 94, 11, 56, 76, 46)], (8, 0, "oc", 0)],
    [*[(1, 1, "oci", 0)] * 5, (8, 0, "oc", 0), (14, 0, "mh", 1), *[(n, 0, "m", 1) for n in (35, 17, 49, 143)], (11, 0, "oc", 0)],
    [*[(1, 1, "oci", 0)] * 6, (8, 0, "oc", 0), (11, 0, "mh", 1), *[(n, 0, "m", 1) for n in (41, 17, 18, 70, 83, 17)], (14, 0, "oc", 0)],
    [*[(1, 1, "oci", 0)] * 6, (11, 0, "oc", 0), (2, 0, "mh", 1), *[(n, 0, "m", 1) for n in (2, 32, 17, 12, 6, 26, 102, 83, 11, 74, 5, 4)], (12, 0, "oc", 0)],
    [*[(1, 1, "oci", 0)] * 6, (9, 0, "oc", 0), (10, 0, "mh", 1), *[(n, 0, "m", 1) for n in (32, 21, 54, 53, 12, 1, 161, 45, 7, 25)]],
]
#: The labelled table: pages of blocks in page order. A block: words, of these inside links, where it stands, content (1) or not (0).
#: Where: m inside article/main, o outside of it on a page that has one, "-" on a page without; c inside a menu, header,
#: footer, sidebar, notice, advert, form or comment by its tags, class, id or role; h heading; i list item.
LABELLED = [
    [(1, 1, "oci", 0), (1, 1, "oci", 0), (2, 2, "oci", 0), (9, 0, "oc", 0), (8, 0, "mh", 1), (60, 0, "m", 1), (3, 0, "m", 1), (120, 2, "m", 1), (1, 0, "m", 1), (14, 1, "oc", 0)],
    [(2, 2, "oci", 0), (3, 3, "oci", 0), (4, 0, "mh", 1), (30, 0, "m", 1), (7, 0, "mh", 1), (12, 12, "mi", 1), (9, 3, "mi", 1), (25, 0, "mc", 0), (6, 4, "mc", 0), (44, 0, "m", 1), (20, 0, "oc", 0)],
    [(1, 1, "-ci", 0), (2, 2, "-ci", 0), (6, 0, "-h", 1), (80, 1, "-", 1), (40, 0, "-", 1), (3, 0, "-", 1), (55, 4, "-", 1), (12, 2, "-c", 0), (30, 0, "-c", 0)],
    [(3, 3, "-i", 0), (2, 2, "-i", 0), (2, 2, "-i", 0), (5, 0, "-h", 1), (45, 0, "-", 1), (17, 0, "-", 1), (4, 4, "-", 0), (5, 5, "-i", 0), (4, 4, "-i", 0), (3, 1, "-", 0)],
    [(4, 0, "o", 0), (22, 0, "o", 0), (2, 0, "mh", 1), (1, 0, "m", 1), (2, 0, "m", 1), (35, 0, "m", 1), (40, 0, "mc", 0), (3, 0, "mci", 0), (2, 0, "mch", 0), (15, 5, "o", 0)],
    [(40, 0, "oc", 0), (70, 3, "oc", 0), (8, 0, "och", 0), (10, 0, "mh", 1), (200, 0, "m", 1), (90, 9, "m", 1), (5, 5, "m", 1), (60, 0, "oc", 0), (33, 0, "oc", 0), (50, 2, "o", 0), (5, 0, "oh", 0)],
    [(7, 0, "-h", 1), (28, 0, "-", 1), (9, 0, "-", 1), (31, 2, "-", 1), (2, 0, "-h", 1), (11, 0, "-i", 1), (8, 1, "-i", 1), (24, 0, "-", 1), (6, 6, "-", 0), (1, 1, "-", 0), (3, 3, "-", 0)],
    [(1, 0, "-", 0), (2, 1, "-", 0), (1, 1, "-", 0), (2, 2, "-", 0), (5, 5, "-", 0), (150, 0, "-", 1), (8, 0, "-", 1), (75, 5, "-", 1), (2, 2, "-", 0), (2, 2, "-", 0)],
    [(1, 1, "oi", 0), (1, 1, "oi", 0), (12, 0, "oh", 0), (3, 0, "m", 1), (2, 2, "m", 1), (14, 0, "m", 1), (6, 0, "mi", 1), (5, 0, "mi", 1), (4, 0, "mi", 1), (18, 0, "mc", 0), (9, 9, "oi", 0)],
    *REAL,
    [(1, 0, "mh", 1), (2, 0, "m", 1), (5, 0, "mc", 0), (2, 0, "m", 1)],
    [(1, 0, "mh", 1), (6, 0, "m", 1)],
    [(1, 1, "oci", 0), (1, 0, "mh", 1), (3, 0, "m", 1), (3, 0, "mch", 0)],
    [(1, 0, "m", 1), (10, 0, "-", 1), (120, 0, "-c", 0), (1, 0, "mh", 1), (4, 4, "mci", 0), (1, 0, "mc", 0), (300, 0, "m", 1)],
]

#: Kinds of blocks on further labelled pages: where, words from and to, share of them inside links from and to, content or not.
KINDS = {
    "menu": ("oci", 1, 3, 1.0, 1.0, 0), "banner": ("oc", 1, 30, 0.0, 1.0, 0), "title": ("mh", 1, 14, 0.0, 0.2, 1), "title link": ("mh", 2, 12, 1.0, 1.0, 1), "byline": ("m", 2, 14, 0.1, 0.9, 1), "lead": ("m", 8, 80, 0.0, 0.1, 1),
    "text": ("m", 1, 220, 0.0, 0.3, 1), "short": ("m", 1, 6, 0.0, 0.0, 1), "links": ("m", 2, 40, 0.2, 1.0, 1), "source": ("mi", 1, 14, 0.0, 1.0, 1), "subhead": ("mh", 1, 9, 0.0, 0.0, 1),
    "advert": ("mc", 1, 200, 0.0, 1.0, 0), "advert head": ("mch", 1, 6, 0.0, 1.0, 0), "comment": ("mci", 1, 90, 0.0, 0.5, 0), "foot": ("oc", 1, 60, 0.0, 1.0, 0), "teaser": ("o", 1, 120, 0.0, 1.0, 0), "teaser head": ("oh", 1, 9, 0.0, 1.0, 0),
    "bare menu": ("-i", 1, 3, 1.0, 1.0, 0), "plain menu": ("-", 1, 2, 0.0, 0.0, 0), "bare title": ("-h", 1, 14, 0.0, 0.0, 1), "bare text": ("-", 10, 220, 0.0, 0.2, 1), "bare links": ("-", 6, 30, 0.2, 0.4, 1),
    "bare short": ("-", 2, 8, 0.0, 0.0, 1), "bare item": ("-i", 3, 30, 0.0, 0.2, 1), "bare advert": ("-c", 1, 200, 0.0, 1.0, 0), "link list": ("-i", 1, 6, 0.9, 1.0, 0), "bare foot": ("-", 3, 9, 0.0, 0.3, 0),
}
#: Layouts: kinds in page order, each with how often it comes at least and at most; of kinds joined by | each time one is taken.
LAYOUTS = (
    "menu 0 7, banner 0 2, title 1 1, byline|lead|text 1 2, text|short|links|subhead|source|advert 1 12, comment|advert|advert head 0 3, foot|teaser|teaser head 0 4",
    "title 1 1, byline 1 1, lead 0 1, text|short|links 0 8, foot 0 2",
    "lead|text 1 1, links|byline 1 2, text|short 0 6, source 0 6, advert head|comment 0 4, teaser 0 2",
    "menu 0 4, title link|title 1 1, links|source 1 9, text 0 3, foot 0 2",
    "text|lead 1 1, source 2 9, foot|teaser head|teaser 0 3",
    "bare menu 2 8, bare title 1 1, bare text 1 2, bare text|bare short|bare links|bare item 0 8, bare text 1 1, link list 0 5, bare advert 0 2, bare foot 0 2",
    "plain menu 3 7, bare title 0 1, bare text 1 3, bare links|bare short 0 2, bare text 1 2, bare foot 1 2",
    "bare title 1 1, bare text 1 1, bare short|bare item|bare links|bare title 0 5, bare text 1 2, bare advert 0 3, link list 2 6",
    "bare title 1 1, bare text 2 6",
)


def labelled_pages(n: int, seed: int = 1) -> list:
    """n labelled pages, in turn of each layout, with word counts drawn (by a fixed seed) from their kinds."""
    rng = random.Random(seed)
    pages = []
    for i in range(n):
        page = []
        for part in LAYOUTS[i % len(LAYOUTS)].split(", "):
            kinds, least, most = part.rsplit(" ", 2)
            for _ in range(rng.randint(int(least), int(most))):
                where, low, high, few, many, content = KINDS[rng.choice(kinds.split("|"))]
                words = min(rng.randint(low, high), rng.randint(low, high))  # short blocks are the more frequent ones
                page.append((words, round(words * rng.uniform(few, many)), where, content))
        pages.append(page)
    return pages


#: HTML's block-level elements, elements whose inside is no text, and elements that hold a page's surroundings.
BLOCKS = set("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = "script|style|noscript|template|title|textarea|iframe|svg|object|canvas|audio|video|noframes"
CHROME = set("nav header footer aside form menu dialog button select fieldset search head".split())
CONTAINERS = BLOCKS | {"button", "span", "a"}
VOID_P = {"p", "li", "dt", "dd", "option", "tr", "td", "th", "hr"}
#: Words of a class or id, and values of role, that mark a page's surroundings.
MARKS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget aside header masthead topbar footer bottombar notice notices cookie cookies consent gdpr popup modal overlay alert toast newsletter subscribe signup login share sharing social related recommended recommendations comment comments reply replies respond disqus pagination pager skip copyright legal complementary contentinfo search dialog feedback".split())
#: Words that can stand beside a mark in one class or id (`site-header`, `comment-list`); beside others a mark tells nothing (`side-effects`, `menu-history`).
BESIDE = set("site page main top bottom left right center outer inner upper lower global primary secondary fixed sticky floating mobile desktop box bar list item items links link wrapper wrap container section block area content panel row column col group button buttons form text image slot unit zone inline nav post posts article articles reader readers user block body title heading head more js is has id the content thread".split())
PAGE = {"html", "body", "main"}  # a mark on these tells nothing of a part of the page

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <(?P<raw>{RAW})\b[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)> | <(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X | re.I,
)
MARKED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
FORM_END = re.compile(r"</form\b", re.I)
WRITTEN = re.compile(r"<(?:article|main|h1|h2|p)\b", re.I)
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def is_mark(name: str, strict: bool) -> bool:
    """Whether a class, id or role as a whole names a part of a page's surroundings; strict: with nothing else beside the mark."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1]
    return any(w in MARKS for w in words) and all(w in MARKS or (w in BESIDE and not strict) for w in words)


def is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME and not (tag == "header" and in_main):
        return True
    if tag in PAGE or not attrs:
        return False
    if HIDDEN.search(attrs):
        return True
    return any(is_mark(x, tag == "article") for m in MARKED.finditer(attrs) for x in (m[2] or m[3] or m[4] or "").split())


def wraps_text(page: str, at: int) -> bool:
    """Whether the form whose tag ends at this place holds the page's text (three headings, paragraphs or articles, or more), not fields only."""
    end = FORM_END.search(page, at)
    inside = WRITTEN.finditer(page, at, end.start() if end else len(page))
    return next(itertools.islice(inside, 2, None), None) is not None


def blocks(page: str) -> list[tuple[str, int, int, str]]:
    """(text, words, words inside links, where) of each block of a page in page order; blocks without text are left out."""
    out: list[list] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, inside chrome, inside main
    text: list[str] = []
    linked = links = 0
    has_main = False
    inner = ""  # the heading or item that the block stands in

    def close() -> None:
        nonlocal linked
        plain = " ".join("".join(text).split())
        if plain:
            chrome, main = stack[-1][1:] if stack else (False, False)
            n = plain.count(" ") + 1
            out.append([plain, n, min(linked, n), ("m" if main else "-") + "c" * chrome + inner])
        text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            text.append(piece)
            if links:
                linked += len(piece.split())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, attrs = m["end"] or m["end2"] or "", m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        if tag in BLOCKS:
            close()
            if re.fullmatch(r"h[1-6]", tag):
                inner = "" if end else "h"
            elif tag == "li":
                inner = "" if end else "i"
            elif inner == "h" and tag != "hgroup":
                inner = ""
            links = 0 if tag not in ("li", "p", "h1", "h2", "h3", "h4", "h5", "h6", "div") else links
        if tag in CONTAINERS and tag != "a":
            if end:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if k is not None:
                    if stack[-1][1] != stack[k][1] or stack[k][1]:
                        close()
                    del stack[k:]
            elif not attrs.rstrip().endswith("/") and tag != "hr":
                if tag in VOID_P and stack and stack[-1][0] == tag:
                    stack.pop()
                above = stack[-1] if stack else ("", False, False)
                main = above[2] or tag in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main\b""", attrs, re.I))
                has_main |= main
                chrome = above[1] or (is_chrome(tag, attrs, above[2]) and not (tag == "form" and wraps_text(page, at)))
                if chrome != above[1]:
                    close()
                stack.append((tag, chrome, main))
    if at < len(page):
        text.append(html.unescape(page[at:]))
    close()
    if has_main:
        for b in out:
            b[3] = b[3].replace("-", "o")
    return [tuple(b) for b in out]


def features(page: list[tuple[int, int, str]]) -> list[list[float]]:
    """FEATURES of each block (words, words inside links, where) of a page."""
    own = [(float(w), k / w if w else 0.0) for w, k, _ in page]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    main = {"m": 1.0, "-": 0.0, "o": -1.0}
    return [[*own[i], *around[i], *around[i + 2], main[at[0]], float("c" in at), float("h" in at), float("i" in at)] for i, (_, _, at) in enumerate(page)]


#: Labelled pages by layouts that the tree is trained on beside LABELLED, whose pages count so many times.
PAGES, TIMES = 400, 5


def train(spark: SparkSession, labelled: list | None = None, depth: int = 12) -> list[tuple]:
    """The decision tree as a list of nodes: (feature, threshold, left, right), or (label,) for a leaf."""
    labelled = LABELLED * TIMES + labelled_pages(PAGES) if labelled is None else labelled
    rows = [[*f, float(block[3])] for page in labelled for f, block in zip(features([b[:3] for b in page]), page)]
    data = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*FEATURES, "label"])).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data))
    nodes: list[tuple] = []

    def walk(node) -> int:
        k = len(nodes)
        nodes.append((int(node.prediction()),))
        if node.subtreeDepth():
            split = node.split()
            nodes[k] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))
        return k

    walk(model._call_java("rootNode"))
    return nodes


def predict(nodes: list[tuple], x: list[float]) -> int:
    node = nodes[0]
    while len(node) > 1:
        node = nodes[node[2] if x[node[0]] <= node[1] else node[3]]
    return node[0]


def main_text(page: str | None, nodes: list[tuple]) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, x in zip(found, features([b[1:] for b in found])) if predict(nodes, x))


def extract(pages: DataFrame, labelled: list | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. pages: page_id, url, html; other columns are not looked at.

    Null or empty html, and pages without content: empty text, 0. Markup that breaks off, isn't closed or is wrongly
    nested is read as far as it goes. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    nodes = train(pages.sparkSession, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(p.as_py(), nodes) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
