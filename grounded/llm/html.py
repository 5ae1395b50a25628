"""Operator 5: main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at every tag that is not inline.  A block is
described by its words and link density, those of the block before and the one
after, and by what it stands in: a boilerplate element (navigation, footer,
aside, form, or one whose class, id or role says so), an article, a heading.  Inside an article only wrappers whose
class says nothing else (``share-buttons``, but not ``side-effects``), and paragraphs and items of one plain word
(``advert``), are boilerplate; ids, headings and tables there say nothing.  A
decision tree, trained on the small labelled table below, keeps or drops it.

Results for odd rows: null or empty html, or a page without any main block,
gives an empty text; markup that is not closed lasts to the end of what holds
it, a head to the first thing that cannot stand in one, other silent elements at
most to the next block element; only scripts, styles, titles and text areas run
on to their own end tag; repeated rows give repeated results; pages are read whole, and the regular
expressions that cut them run in linear time; columns of other names are not
read; an empty table gives an empty table."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grounded.llm.common import as_text, map_batches

# Elements that stay inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements of which nothing is text of the page.
SILENT = frozenset("noscript template svg math iframe object canvas audio video select".split())
# Those whose content is no markup: only their own end tag ends them.
RAW = ("script", "style", "textarea", "title")
# What can stand in a head.
HEAD = frozenset(("base", "link", "meta", "noscript", "template", *RAW))
# Elements that end a silent element without an end tag.
BREAKS = frozenset("body article main section header footer nav aside div p table ul ol dl form blockquote pre figure center "
                   "h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset label dir address".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that mark boilerplate or content.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner bottombar breadcrumb breadcrumbs byline-links "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus "
    "disclaimer foot footer form gdpr login masthead menu menubar message modal nav navbar navigation newsletter notice "
    "notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended "
    "related replies reply responses search share sharing shoutbox side sidebar signup skip social sponsor sponsored "
    "subscribe subscription taboola tags toc toolbar topbar tracking warning widget widgets".split())
# Words that say no more beside one of those, as in comment-list or ad-slot.
NEUTRAL_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container content footer group head header holder icon "
    "icons inline inner item items left line link links list media outer panel post posts right row section slot small title top "
    "unit wrap wrapper".split())
# Elements of an article that hold its text, and the class words that make one of them boilerplate all the same.
TEXTUAL = frozenset("p li dl dt dd blockquote figure figcaption pre h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th address".split())
NEVER = frozenset("h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th address".split())
PLAIN_WORDS = frozenset("ad ads advert advertisement advertising adverts comment comments cookie cookies newsletter promo promotion "
                        "share sharing sponsored subscribe".split())
CONTENT_WORDS = frozenset("article articlebody body-text content entry maincontent main post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(?s:.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^<>]*>"                       # quotes that do not pair
    r"|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z]+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "boilerplate", "content", "heading", "page_has_content")


def _only_boilerplate(token: str) -> bool:
    """Whether a class is made of boilerplate words, or of these and words that say no more."""
    parts = {p for p in _PART.split(token) if p}
    return bool(parts & BOILERPLATE_WORDS) and parts <= BOILERPLATE_WORDS | NEUTRAL_WORDS


def _in_article(name: str, found: dict[str, str]) -> bool:
    """Whether an element inside an article is boilerplate by its tag, class or role; of a div the id counts too."""
    classes = found.get("class", "").lower().split() + found.get("role", "").lower().split()
    if name in TEXTUAL:
        return name not in NEVER and any(c in PLAIN_WORDS for c in classes)
    if name in BOILERPLATE:
        return True
    return any(map(_only_boilerplate, classes + (found.get("id", "").lower().split() if name == "div" else [])))


@lru_cache(4096)
def _hints(name: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """Whether an element's own tag and attributes speak of boilerplate, and of content; ``inside``: in an article."""
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    words = set()
    for k in ("class", "id", "role"):
        value = found.get(k, "").lower()
        words.update(_PART.split(value))
        words.update(value.split())
    boiler = _in_article(name, found) if inside else name in BOILERPLATE
    if name not in ("html", "body"):
        hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
                  or re.search(r"display\s*:\s*none", found.get("style", "").lower()))
        boiler = boiler or bool(words & BOILERPLATE_WORDS and not inside) or bool(hidden)
    return boiler, name in CONTENT or (name not in ("html", "body") and bool(words & CONTENT_WORDS))


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """For each start tag of a silent element the place of its end tag, if it has one."""
    opened: dict[str, list[int]] = {name: [] for name in SILENT}
    ends = {}
    for k, m in enumerate(tokens):
        name = (m["name"] or m["name2"] or "").lower()
        if name in SILENT:
            if not (m["close"] or m["close2"]):
                if not (m["attributes"] or "").endswith("/"):
                    opened[name].append(k)
            elif opened[name]:
                ends[opened[name].pop()] = k
    return ends


def blocks(html: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """Flat blocks of a page: text, words, link density, boilerplate, content, heading."""
    out, parts = [], []
    nothing = ("", False, False, False, False)
    stack: list[tuple[str, bool, bool, bool, bool]] = []      # name, boilerplate, content, heading, silent
    links = 0
    state = nothing

    def flush():
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            words = len(text.split())
            linked = sum(len(p.split()) for p, link in parts if link)
            out.append((text, words, min(1.0, linked / words), *state[1:4]))
        parts.clear()

    tokens = list(_TOKEN.finditer(html))
    ends, after = _ends(tokens), 0
    for k, m in enumerate(tokens):
        if k < after:
            continue
        text = m["text"]
        if text is not None:
            if stack and stack[-1][0] == "head" and text.strip():
                stack.pop()
                state = stack[-1] if stack else nothing
            if not state[4]:
                parts.append((entities.unescape(text), links > 0))
            continue
        name, closes, attributes = (m["name"] or m["name2"] or "").lower(), m["close"] or m["close2"], m["attributes"] or ""
        if not name:
            if m["raw"]:
                flush()
            continue
        if k in ends:
            flush()
            after = ends[k] + 1
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append((" ", False))
        if name == "a":
            links = 0 if closes else 1
        if closes:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if state[4] and (name in BREAKS or (stack[-1][0] == "head" and name not in HEAD)):
                while stack and stack[-1][4]:
                    stack.pop()
            if name in ("p", "li", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                stack.pop()
            _, boiler, content, heading, silent = stack[-1] if stack else nothing
            own, inside = _hints(name, attributes, content and not boiler)
            if name == "header" and not content:
                own = True
            if inside and not own and name not in INLINE:
                boiler, content = False, True             # an article inside a marked wrapper is an article
            stack.append((name, boiler or own, content, heading or name in HEADINGS,
                          silent or name in SILENT or name == "head"))
        state = stack[-1] if stack else nothing
    flush()
    return out


def features(found: list[tuple]) -> list[tuple[float, ...]]:
    """One row of FEATURES per block; a page ends in blocks without words."""
    has_content = float(any(b[4] and not b[3] for b in found))
    edge = (0, 0.0)
    rows = []
    for i, (words, density, boiler, content, heading) in enumerate(b[1:] for b in found):
        before = found[i - 1][1:3] if i else edge
        after = found[i + 1][1:3] if i + 1 < len(found) else edge
        rows.append((float(words), density, float(before[0]), before[1], float(after[0]), after[1],
                     float(boiler), float(content), float(heading), has_content))
    return rows


# The labelled table: pages of blocks, each (words, link density, boilerplate, content, heading, main text).
LABELLED = [
    # an article element between navigation, advert and footer
    [(1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (12, 0.0, 1, 0, 0, 0), (9, 0.0, 0, 1, 1, 1), (60, 0.02, 0, 1, 0, 1),
     (1, 0.0, 0, 1, 0, 1), (140, 0.0, 0, 1, 0, 1), (2, 0.0, 0, 1, 0, 1), (30, 0.1, 1, 1, 0, 0), (14, 0.1, 1, 0, 0, 0)],
    # an article with a linked paragraph, an advert inside, long reader comments after it
    [(5, 1.0, 1, 0, 0, 0), (7, 0.0, 0, 1, 1, 1), (8, 1.0, 0, 1, 0, 1), (45, 0.5, 0, 1, 0, 1), (40, 0.0, 1, 1, 0, 0),
     (3, 0.0, 0, 1, 0, 1), (90, 0.0, 0, 1, 0, 1), (2, 0.0, 1, 0, 1, 0), (70, 0.0, 1, 0, 0, 0), (120, 0.0, 1, 0, 0, 0)],
    # one short paragraph alone in its article
    [(3, 1.0, 1, 0, 0, 0), (1, 0.0, 0, 1, 0, 1), (15, 0.3, 1, 0, 0, 0)],
    [(1, 1.0, 0, 0, 0, 0), (4, 0.0, 0, 1, 1, 1), (2, 1.0, 0, 1, 0, 1), (3, 0.0, 0, 0, 0, 0)],
    # articles of short lines, with links in them, and of one word each
    [(1, 1.0, 1, 0, 0, 0), (1, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 1, 0, 1), (1, 0.0, 0, 1, 0, 1), (3, 0.3, 0, 1, 0, 1),
     (1, 1.0, 0, 1, 0, 1), (2, 0.5, 0, 1, 0, 1), (6, 0.2, 0, 1, 0, 1), (1, 0.0, 0, 1, 0, 1)],
    [(6, 0.0, 0, 1, 1, 1), (5, 0.8, 0, 1, 0, 1), (4, 0.25, 0, 1, 0, 1), (200, 0.1, 0, 1, 0, 1), (3, 0.0, 0, 1, 0, 1),
     (12, 0.0, 1, 0, 0, 0)],
    [(12, 0.0, 1, 0, 0, 0), (4, 0.0, 0, 1, 1, 1), (9, 0.0, 0, 1, 0, 1), (2, 0.0, 0, 1, 0, 1), (20, 0.0, 1, 0, 0, 0)],
    [(9, 0.0, 1, 0, 0, 0), (30, 0.15, 0, 1, 0, 1), (1, 0.0, 0, 1, 0, 1), (10, 0.1, 1, 0, 0, 0)],
    # long boilerplate without links: notices, sidebars, forms, comments
    [(18, 0.0, 1, 0, 0, 0), (30, 0.05, 1, 0, 0, 0), (25, 0.0, 1, 0, 0, 0), (5, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 1, 0, 1),
     (44, 0.0, 1, 0, 0, 0), (7, 0.0, 1, 0, 1, 0), (80, 0.0, 1, 0, 0, 0), (22, 0.0, 1, 0, 0, 0), (1, 0.0, 1, 0, 0, 0)],
    [(12, 0.0, 0, 1, 1, 1), (33, 0.0, 0, 1, 0, 1), (55, 0.0, 1, 0, 0, 0), (80, 0.0, 1, 0, 0, 0), (41, 0.0, 1, 0, 0, 0),
     (9, 0.0, 1, 0, 0, 0), (100, 0.0, 1, 1, 0, 0), (6, 0.0, 0, 1, 0, 1), (130, 0.0, 1, 0, 0, 0), (3, 0.0, 1, 0, 0, 0)],
    [(20, 0.0, 1, 0, 0, 0), (6, 0.0, 1, 0, 1, 0), (3, 0.0, 1, 0, 0, 0), (60, 0.0, 1, 0, 0, 0), (35, 0.0, 1, 0, 0, 0)],
    # unmarked blocks beside an article
    [(4, 0.0, 0, 0, 0, 0), (30, 0.0, 0, 0, 0, 0), (8, 0.0, 0, 1, 1, 1), (80, 0.0, 0, 1, 0, 1), (20, 0.0, 0, 1, 0, 1),
     (25, 0.2, 0, 0, 0, 0), (60, 0.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 0, 0)],
    # plain divisions without any mark: running text, its heading and short lines between long neighbours
    [(1, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (8, 0.0, 0, 0, 1, 1), (70, 0.0, 0, 0, 0, 1),
     (110, 0.03, 0, 0, 0, 1), (4, 0.0, 0, 0, 0, 1), (55, 0.0, 0, 0, 0, 1), (3, 1.0, 0, 0, 0, 0), (4, 1.0, 0, 0, 0, 0),
     (5, 0.0, 0, 0, 0, 0)],
    [(3, 0.7, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 1, 1), (35, 0.0, 0, 0, 0, 1), (28, 0.05, 0, 0, 0, 1),
     (18, 0.0, 0, 0, 0, 1), (44, 0.0, 0, 0, 0, 1), (6, 0.5, 0, 0, 0, 0), (5, 0.2, 0, 0, 0, 0)],
    [(2, 1.0, 0, 0, 0, 0), (40, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0, 0, 1), (33, 0.0, 0, 0, 0, 1), (25, 0.9, 0, 0, 0, 0),
     (30, 0.8, 0, 0, 0, 0)],
    [(12, 0.0, 0, 0, 0, 1), (10, 0.0, 0, 0, 0, 1), (14, 0.0, 0, 0, 0, 1), (20, 0.0, 0, 0, 0, 1)],
    # plain text with marked boilerplate around it
    [(3, 1.0, 1, 0, 0, 0), (25, 0.0, 1, 0, 0, 0), (7, 0.0, 0, 0, 1, 1), (66, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 1),
     (80, 0.0, 0, 0, 0, 1), (50, 0.0, 1, 0, 0, 0), (16, 0.1, 1, 0, 0, 0)],
    # a page of links and labels only
    [(2, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0), (4, 1.0, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0),
     (2, 0.5, 0, 0, 0, 0)],
    [(5, 1.0, 1, 0, 0, 0), (6, 0.0, 1, 0, 0, 0), (20, 0.0, 1, 0, 0, 0), (3, 0.0, 0, 0, 0, 0)],
]

Tree = tuple  # (feature, threshold, at most, above) or a leaf (keep,)


def train(spark: SparkSession, labelled: list[list[tuple]] | None = None, depth: int = 6) -> Tree:
    """The decision tree of the labelled table, as nested tuples."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    rows = []
    for page in LABELLED if labelled is None else labelled:
        found = [("", w, d, b, c, h) for w, d, b, c, h, _ in page]
        rows += [(Vectors.dense(f), float(row[-1])) for f, row in zip(features(found), page)]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table)
    return parse_tree(model.toDebugString)


def parse_tree(text: str) -> Tree:
    """Nested tuples from the printed form of a tree model."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    at = 0

    def node() -> Tree:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return (float(line.split(":")[1]) > 0.5,)
        feature, threshold = re.search(r"feature (\d+) <= ([-\d.eE]+)", line).groups()
        low = node()
        at += 1                                               # the matching Else
        return int(feature), float(threshold), low, node()

    return node()


def keeps(tree: Tree, row: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(html: str, tree: Tree) -> str:
    found = blocks(html)
    return "\n\n".join(b[0] for b, row in zip(found, features(found)) if keeps(tree, row))


def extract(pages: DataFrame, tree: Tree, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars``."""
    def start():
        def fn(batch):
            return [batch.column(0), batch.column(1), [main_text(as_text(h), tree) for h in batch.column(2).to_pylist()]]
        return fn

    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    found = map_batches(rows, start, "page_id long, url string, text string", 64)
    return found.withColumn("n_chars", F.length("text").cast("long"))
