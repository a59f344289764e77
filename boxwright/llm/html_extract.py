"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of DOM nodes.  Each node has a hidden state (boilerplate
or content), a unary potential from its own features (tag, class and id words,
text length, link share, marks) and a potential with its parent's state.  The
sum-product algorithm, once upward and once downward, gives exact marginals;
text of nodes with a content marginal above 1/2 is kept.

Weights come from labelled pages: a bounded sample of pages that mark their
article themselves.  Its text is content, all other text isn't, and an element
is content if most of its text is.  Where no page of the corpus has an article
or main element, the innermost container that holds most of a page's plain text
is taken for it.  Each labelled page is learned from three times: as it is, with
lists of links added to its article, and with the article an unnamed division.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.sampling import least_hashed, one_row_each

# fixed values: elements of the HTML standard by how they are read
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements whose content isn't shown as text; they are parsed, so that one without an end tag ends with its parent.
HIDDEN = frozenset(("select", "template"))
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br body html head td th tr tbody thead tfoot dd dt li legend optgroup option summary figcaption".split())
#: Blocks that a list of choices holds; any other block ends an open one, and an open drawing or formula too.
CHOICES = frozenset("hr legend optgroup option".split())
FOREIGN_TEXT = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext".split())
#: An element that ends an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"optgroup", "option"}}
# fixed values: words that elements use for what isn't the article, and for what is
AWAY = frozenset(
    "nav navbar navigation menu menubar footer header masthead sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo "
    "cookie cookies consent notice popup modal newsletter subscribe subscription signup login share sharing social related recommended breadcrumb "
    "breadcrumbs comment comments reply replies disqus widget toolbar pagination pager copyright legal form search tags button dialog".split()
)
#: Elements that mark a page's article, and those that hold other blocks and no text of their own, mostly.
MARKS = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section center table tbody tr td form".split()) | MARKS
HOME = frozenset("article main content entry post story body text paragraph".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    # a quote opens a value only after "="; elsewhere it is a character like any other
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: An unquoted value at a tag's end, whose last "/" belongs to it.
_BARE_END = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def parse(page: str) -> tuple[list[str], list[int], list[str], list[tuple[int, str, bool]]]:
    """Tags, parents and attribute words of the elements, and the texts in order.

    Node 0 is the page.  A text is (element, characters, first of its block).
    Content of RAW and HIDDEN elements, comments and declarations is dropped; a
    construct that the page's end cuts off is dropped too.  A RAW element without
    an end tag reaches to the page's end, as in the HTML standard.
    """
    tags, parents, words = [""], [-1], [""]
    texts: list[tuple[int, str, bool]] = []
    # names and nodes of the open elements; HIDDEN ones and what they hold are no nodes (-1)
    open_tags, open_nodes, fresh, at, n = [""], [0], True, 0, len(page)

    def close(k: int) -> None:
        del open_tags[k:], open_nodes[k:]

    def write(text: str) -> None:
        nonlocal fresh
        if open_nodes[-1] >= 0:
            texts.append((open_nodes[-1], text, fresh))
            fresh = False

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            write(page[at:lt])
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if m is None:  # a bare "<"
            write("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            name = m[1].lower()
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_tags[k] == name:
                    close(k)
                    break
            fresh = fresh or name in BLOCKS
        elif m[2]:
            name = m[2].lower()
            fresh = fresh or name in BLOCKS
            if name in BLOCKS and name not in CHOICES:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if open_tags[k] in ("select", "svg", "math"):
                        close(k)
                        break
                    if open_tags[k] in FOREIGN_TEXT:
                        break
            if name in CLOSES_P:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if open_tags[k] == "p":
                        close(k)
                        break
                    if open_tags[k] in ("button", "td", "th", "div", "section", "article"):
                        break
            elif name in SIBLINGS:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if open_tags[k] in ("ul", "ol", "dl", "table", "menu", "select", "datalist"):
                        break
                    if open_tags[k] in SIBLINGS[name]:
                        close(k)
                        break
            if name in VOID:
                continue
            closed = m[3].endswith("/") and not _BARE_END.search(m[3])
            if name in RAW:
                if not closed:
                    end = _RAW_END[name].search(page, at)
                    at = end.end() if end else n
                continue
            shown = open_nodes[-1] >= 0 and name not in HIDDEN
            if shown:
                tags.append(name)
                parents.append(open_nodes[-1])
                words.append(" ".join(a or b or c for a, b, c in _ATTR.findall(m[3])) if m[3] else "")
            if not closed:
                open_tags.append(name)
                open_nodes.append(len(tags) - 1 if shown else -1)
    return tags, parents, words, texts


TAG_GROUPS = (
    ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "center"), ("span", "b", "i", "em", "strong", "u", "small", "code", "sub", "sup"),
    ("a",), ("ul", "ol", "li", "dl", "dt", "dd", "menu"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th"), ("nav", "footer", "header", "aside", "form", "dialog", "button", "label", "fieldset"),
    ("article", "main"), ("body", "html", "head", ""), ("figure", "figcaption", "details", "summary"),
)
_TAG_NUMBER = {t: k for k, group in enumerate(TAG_GROUPS) for t in group}
#: Elements inside a line of text, formulas among them; they are read as the block that they stand in.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var "
    "annotation math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
N_FEATURES = len(TAG_GROUPS) + 11


def features(tags: list[str], parents: list[int], words: list[str], texts: list[tuple[int, str, bool]]) -> np.ndarray:
    """One row for each element."""
    n = len(tags)
    x = np.zeros((n, N_FEATURES))
    own, linked, total, marks, inner_links = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    base = len(TAG_GROUPS)
    for k, tag in enumerate(tags):
        if (g := _TAG_NUMBER.get(tag)) is not None:
            x[k, g] = 1
        if words[k]:
            found = set(_WORD.findall(words[k].lower()))
            x[k, base] = bool(found & AWAY)
            x[k, base + 1] = bool(found & HOME)
        if tag in AWAY:
            x[k, base] = 1
        if tag == "a":
            inner_links[k] += 1
    for node, text, _ in texts:
        size = len(text.strip())
        own[node] += size
        marks[node] += text.count(".") + text.count(",")
        if tags[node] == "a":
            linked[node] += size
    total += own
    for k in range(n - 1, 0, -1):
        total[parents[k]] += total[k]
        linked[parents[k]] += linked[k]
        inner_links[parents[k]] += inner_links[k]
    away, home = x[:, base].copy(), np.zeros(n)
    for k in range(1, n):
        home[k] = (home[parents[k]] or tags[k] in MARKS) and not away[k]
        away[k] = max(away[k], away[parents[k]])
    x[:, base + 2] = away
    x[:, base + 3] = np.log1p(own) / 5
    x[:, base + 4] = np.log1p(total) / 5
    x[:, base + 5] = linked / np.maximum(total, 1)
    x[:, base + 6] = np.log1p(marks)
    x[:, base + 7] = np.log1p(inner_links)
    x[:, base + 8] = total == 0
    x[:, base + 9] = 1
    x[:, base + 10] = home
    for k in range(1, n):
        if tags[k] in INLINE:
            x[k, : base] = x[parents[k], : base]
            x[k, base + 3 :] = x[parents[k], base + 3 :]
    return x


def marginals(parents: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(content) of every node by sum-product; parents stand before their children.

    ``unary``: log potential of content against boilerplate; ``pair[s, t]``: log
    potential of parent state s with child state t.
    """
    n = len(unary)
    local = [(0.0, float(u)) for u in unary]
    up = [[0.0, 0.0] for _ in range(n)]  # sums of the children's messages
    sent = [(0.0, 0.0)] * n
    p = pair.tolist()

    def total(a: float, b: float) -> float:
        hi, lo = (a, b) if a > b else (b, a)
        return hi + math.log1p(math.exp(lo - hi)) if hi - lo < 40 else hi

    order = parents.tolist()
    for k in range(n - 1, 0, -1):
        b0, b1 = local[k][0] + up[k][0], local[k][1] + up[k][1]
        m0, m1 = total(p[0][0] + b0, p[0][1] + b1), total(p[1][0] + b0, p[1][1] + b1)
        sent[k] = (m0, m1)
        mine = up[order[k]]
        mine[0] += m0
        mine[1] += m1
    belief = [(0.0, 0.0)] * n
    for k in range(n):
        b0, b1 = local[k][0] + up[k][0], local[k][1] + up[k][1]
        if k:
            f0, f1 = belief[order[k]][0] - sent[k][0], belief[order[k]][1] - sent[k][1]
            b0, b1 = b0 + total(f0 + p[0][0], f1 + p[1][0]), b1 + total(f0 + p[0][1], f1 + p[1][1])
        belief[k] = (b0, b1)
    b = np.array(belief)
    return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -60, 60)))


@dataclass
class TreeModel:
    weights: np.ndarray
    pair: np.ndarray

    def extract(self, page: str | None) -> str:
        """The page's main text, "" if there is none."""
        if not page:
            return ""
        tags, parents, words, texts = parse(page)
        if not texts:
            return ""
        keep = marginals(np.array(parents), features(tags, parents, words, texts) @ self.weights, self.pair) > 0.5
        out: list[str] = []
        block: list[str] = []
        for node, text, first in texts:
            if first and block:
                out.append("".join(block))
                block = []
            if keep[node]:
                block.append(text)
        out.append("".join(block))
        return " ".join(x for x in (" ".join(_html.unescape(b).split()) for b in out) if x)


def _is_away(tag: str, words: str) -> bool:
    return tag in AWAY or bool(words and set(_WORD.findall(words.lower())) & AWAY)


def _container(tags: list[str], parents: list[int], words: list[str], texts: list[tuple[int, str, bool]]) -> int:
    """The innermost container with most of the text that is no link and isn't within menus, footers and the like."""
    n = len(tags)
    away = np.zeros(n, dtype=bool)
    for k in range(1, n):
        away[k] = away[parents[k]] or tags[k] == "a" or _is_away(tags[k], words[k])
    plain = np.zeros(n)
    for node, text, _ in texts:
        if not away[node]:
            plain[node] += len(text.strip())
    for k in range(n - 1, 0, -1):
        plain[parents[k]] += plain[k]
    chosen = 0
    for k in range(1, n):  # parents stand before their children
        if parents[k] == chosen and tags[k] in CONTAINERS and plain[k] > 0.6 * plain[0]:
            chosen = k
    return chosen


def label(tags: list[str], parents: list[int], words: list[str], texts: list[tuple[int, str, bool]], guess: bool = False) -> np.ndarray | None:
    """States of the elements of a page that marks its article, None for other pages; ``guess``: of any page, by its main container."""
    n = len(tags)
    root = _container(tags, parents, words, texts) if guess and not MARKS & set(tags) else -1
    inside = np.zeros(n, dtype=bool)
    inside[0] = root == 0
    for k in range(1, n):
        inside[k] = (inside[parents[k]] or tags[k] in MARKS or k == root) and not _is_away(tags[k], words[k])
    if not inside.any():
        return None
    good, total = np.zeros(n), np.zeros(n)
    for node, text, _ in texts:
        size = len(text.strip())
        total[node] += size
        good[node] += size * inside[node]
    for k in range(n - 1, 0, -1):
        total[parents[k]] += total[k]
        good[parents[k]] += good[k]
    return np.where(total > 0, 2 * good > total, inside)


Tree = tuple[list[str], list[int], list[str], list[tuple[int, str, bool]]]


def _with_links(tree: Tree, states: np.ndarray, root: int, turn: int) -> tuple[Tree, np.ndarray]:
    """The page with a list of links and a linked paragraph in its article, which are content."""
    tags, parents, words, texts = (list(x) for x in tree)

    def add(tag: str, parent: int, text: str = "") -> int:
        tags.append(tag)
        parents.append(parent)
        words.append("")
        if text:
            texts.append((len(tags) - 1, text, False))
        return len(tags) - 1

    items = add(("ul", "ol")[turn % 2], root)
    for k in range(2 + turn % 5):
        add("a", add("li", items), "x" * (6 + (7 * k + turn) % 40))
    add("a", add("p", root), "x" * (20 + turn % 60))
    return (tags, parents, words, texts), np.concatenate([states, np.ones(len(tags) - len(states), dtype=bool)])


def _lessons(page: str, turn: int, guess: bool) -> Iterator[tuple[Tree, np.ndarray]]:
    """A labelled page as it is, with links in its article, and with an unnamed article."""
    tree = parse(page)
    states = label(*tree, guess)
    if states is None:
        return
    yield tree, states
    marked = [k for k, t in enumerate(tree[0]) if t in MARKS and states[k]]
    if marked:
        yield _with_links(tree, states, marked[0], turn)
        tags, parents, words, texts = tree
        yield (["div" if t in MARKS else t for t in tags], parents, ["" if t in MARKS else w for t, w in zip(tags, words, strict=True)], texts), states


def fit(pages: list[str], l2: float = 1e-3, steps: int = 300) -> TreeModel:
    """Unary weights of greatest penalised likelihood; parent-child potentials from counts of state pairs, against independence.

    Pages that mark no article are learned from only if none does; no page with
    text at all gives a model that keeps every text.
    """
    xs, ys = [], []
    pairs = np.ones((2, 2))
    for guess in (False, True):
        for turn, page in enumerate(pages):
            for tree, states in _lessons(page, turn, guess):
                xs.append(features(*tree))
                ys.append(states)
                child = np.arange(1, len(states))
                np.add.at(pairs, (states[np.array(tree[1])[child]].astype(int), states[child].astype(int)), 1)
        if xs:
            break
    weights = np.zeros(N_FEATURES)
    if not xs:
        weights[len(TAG_GROUPS) + 9] = 1
        return TreeModel(weights, np.zeros((2, 2)))
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ weights, -40, 40))) - y) / len(y) + l2 * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    p = pairs / pairs.sum()
    return TreeModel(weights, np.log(p) - np.log(p.sum(axis=1, keepdims=True)) - np.log(p.sum(axis=0, keepdims=True)))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 400, most_chars: int = 50_000) -> TreeModel:
    """Fit on the ``sample_pages`` pages of least hashed id among those with an article or main element and at most ``most_chars`` characters.

    If no page has such an element, among all of that length.  Null ids take no
    part; of rows that share an id the least page counts.
    """
    short = pages.filter((F.length(html_col) <= most_chars) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(html_col).alias("html"))
    sample: list = []
    for pairs in (short.filter(F.col("html").rlike("(?i)<(article|main)[ >]")), short):
        if not sample:
            sample = one_row_each(pairs, least_hashed(pairs, "_id", sample_pages), "_id").collect()  # sample_pages pages at most
    return fit([r.html for r in sorted(sample, key=lambda r: r["_id"])])


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Blocks of kept text stand in page order, joined by one space, with character
    references decoded and white space inside a block made one space.  A null or
    empty page, or one without kept text, has the text "".  Pages may be cut off
    or have any length.  Null ids and urls stay null; repeated rows are treated
    alike; an empty table gives no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [model.extract(page.as_py()) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
