"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of elements and pieces of text.  Every node has a hidden
label: main text, other text, or a container of both.  Potentials join a node to what is seen of it (tag, words in its
class, id and role, length of the text, whether it is a link) and a child to its parent.
Sum-product messages go up from the leaves and then down from the root, which gives each
node's exact marginal.  Pieces of text with a marginal of at least one half are kept.  The
potentials are counted from labelled pages (``html_pages``, or pages of the caller with the
same marks), with counts of one half added.

Pages are independent of each other, so this is one pass in Python tasks without a shuffle.

Defined results: null and empty html give an empty text; pages without an end, with
unclosed or stray tags are read as far as they go; character references are decoded, those
that name nothing stay; scripts, styles, comments and other markup never count as text;
white space, ``<br>`` too, becomes one space; repeated rows give repeated results; null ids
stay; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes
from partlog.llm.html_pages import labelled_pages

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript noembed noframes xmp template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre search section summary table tbody td tfoot th"
    " thead tr ul caption".split()
)
# Elements whose start ends an open one of the same family, up to the given container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_ENDS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option"}

# Kinds of words in class, id and role, first match counts.
HINTS = (
    ("comment", r"comment|repl(?:y|ies)|disqus|discussion|respond"),
    ("advert", r"(?:^|[^a-z])ad(?:s|vert\w*|-?\w*banner)?(?:$|[^a-z])|sponsor|promo|banner-ad"),
    ("notice", r"cookie|consent|notice|alert|newsletter|subscri|popup|modal|gdpr|overlay|paywall"),
    ("share", r"share|social|follow"),
    ("aside", r"sidebar|side-bar|aside|widget|related|recommend|popular|teaser|trending|complementary"),
    ("menu", r"nav|menu|breadcrumb|pagination|pager|toc(?:$|[^a-z])|tabs"),
    ("header", r"header|masthead|banner|logo|topbar"),
    ("footer", r"footer|copyright|contentinfo|colophon"),
    ("form", r"form|login|search|signup"),
    ("main", r"article|content|post|entry|story|main|body|text"),
)
_HINT = re.compile("|".join(f"(?P<{name}>{rule})" for name, rule in HINTS))
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+\"[^\"]*+\""
    r"|=\s*+'[^']*+'|=)*+)>",
    re.DOTALL,
)
_NAME = re.compile(r"</?[a-zA-Z]")
# Searched in the page itself: lower case may have another length.
_RAW_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

LENGTHS = (12, 30, 80)
#: Marks the end of a block in a page's sequence of pieces.
BREAK = -1


class Tree:
    """Nodes in page order; a parent comes before its children."""

    __slots__ = ("parent", "tag", "hint", "text", "pieces")

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []  # '' for text
        self.hint: list[str] = []
        self.text: list[str] = []
        self.pieces: list[int] = []  # text nodes and BREAKs in page order

    def add(self, parent: int, tag: str, hint: str = "", text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.text.append(text)
        return len(self.tag) - 1


def _hint(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    found = _HINT.search(words) if words else None
    return found.lastgroup if found else ""


def parse(page: str) -> Tree:
    """The tree of a page, as lenient as browsers in what matters for text."""
    tree = Tree()
    stack = [tree.add(-1, "html")]
    pieces, tags, at, size = tree.pieces, tree.tag, 0, len(page)
    # Depths at which each name is open, and those of blocks, of all and of all but <p>.
    opened: dict[str, list[int]] = {}
    blocks, walls = [0], [0]

    def put(raw: str) -> None:
        if "&" in raw:
            raw = _html.unescape(raw)
        pieces.append(tree.add(stack[-1], "", "", raw))

    def push(node: int) -> None:
        tag, depth = tags[node], len(stack)
        opened.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            blocks.append(depth)
            if tag != "p":
                walls.append(depth)
        stack.append(node)

    def pop_to(depth: int) -> None:
        if blocks[-1] >= depth:
            pieces.append(BREAK)
        for node in stack[depth:]:
            opened[tags[node]].pop()
        for found in (blocks, walls):
            while found[-1] >= depth:
                found.pop()
        del stack[depth:]

    def deepest(names: Iterable[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def open_depth(names: set[str], wall: int) -> int:
        """Depth of the last open one of ``names`` that is not above the wall."""
        depth = deepest(names)
        return depth if depth >= wall else 0

    start = 0  # where to look for the next sign
    while at < size:
        sign = page.find("<", start)
        found = _MARKUP.match(page, sign) if sign >= 0 else None
        if found is None:
            if sign >= 0 and not _NAME.match(page, sign):
                start = sign + 1  # a sign in the text
                continue
            put(page[at:])  # no sign, or a tag that never ends
            break
        if sign > at:
            put(page[at:sign])
        at = start = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            depth = open_depth({name}, 0 if name in BLOCK else blocks[-1])
            if depth:
                pop_to(depth)
            elif name in ("p", "br"):
                pieces.append(BREAK if name == "p" else tree.add(stack[-1], "", "", " "))
            continue
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = start = close + 1 if close >= 0 else size
            continue
        if name in ("html", "body"):
            continue
        if name in P_ENDS:
            depth = open_depth({"p"}, walls[-1])
            if depth:
                pop_to(depth)
        if name in CLOSES:
            ended, until = CLOSES[name]
            depth = open_depth(ended, deepest(until - ended))
            if depth:
                pop_to(depth)
        if name == "br":
            pieces.append(tree.add(stack[-1], "", "", " "))
            continue
        if name in BLOCK:
            pieces.append(BREAK)
        if name in VOID:
            continue
        node = tree.add(stack[-1], name, _hint(found[3]))
        if not found[3].endswith("/") or name in BLOCK:
            push(node)
    return tree


def _length(text: str) -> int:
    size = len(text)
    return sum(size >= bound for bound in LENGTHS)


MAIN, OTHER, MIXED = range(3)


class Model:
    """What is seen of a node given its label, and a child's label given its parent's.

    Labels: main text, other text, and a container of both; text is never a container.
    """

    def __init__(self):
        self.seen: dict[str, dict[object, tuple[float, ...]]] = {}
        self.unseen: dict[str, tuple[float, ...]] = {}
        self.edge: dict[str, list[tuple[float, ...]]] = {}  # by the kind of the child
        self._told: dict[tuple, tuple[tuple[float, ...], tuple[float, ...]]] = {}

    def fit(self, trees: Iterable[tuple[Tree, list[int]]]) -> Model:
        counts: dict[str, dict] = {"tag": {}, "hint": {}, "text": {}}
        pairs = {kind: [[0.5] * 3 for _ in range(3)] for kind in ("block", "inline", "text")}
        for tree, labels in trees:
            links = _links(tree)
            for n, label in enumerate(labels):
                if tree.tag[n]:
                    seen = (("tag", tree.tag[n]), ("hint", tree.hint[n]))
                else:
                    seen = (("text", (_length(tree.text[n]), links[n])),)
                for kind, value in seen:
                    counts[kind].setdefault(value, [0.5] * 3)[label] += 1
                if n:
                    pairs[_kind(tree.tag[n])][labels[tree.parent[n]]][label] += 1
        for kind, values in counts.items():
            rest = [0.5] * 3  # one more value, for those never seen
            sums = [sum(v[k] for v in values.values()) + rest[k] for k in range(3)]
            self.seen[kind] = {
                value: tuple(x / y for x, y in zip(v, sums)) for value, v in values.items()
            }
            self.unseen[kind] = tuple(x / y for x, y in zip(rest, sums))
        for kind, rows in pairs.items():
            for row in rows:
                if kind == "text":
                    row[MIXED] = 0.0
            self.edge[kind] = [tuple(x / sum(row) for x in row) for row in rows]
        return self

    def _element(self, tag: str, hint: str) -> tuple[float, ...]:
        a = self.seen["tag"].get(tag, self.unseen["tag"])
        b = self.seen["hint"].get(hint, self.unseen["hint"])
        return (a[0] * b[0], a[1] * b[1], a[2] * b[2])

    def _text(self, length: int, link: bool) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """A piece's own factor and its message to the parent, which few kinds share."""
        if (length, link) not in self._told:
            own = self.seen["text"].get((length, link), self.unseen["text"])
            told = tuple(row[0] * own[0] + row[1] * own[1] for row in self.edge["text"])
            self._told[length, link] = (own, tuple(x / max(told) for x in told))
        return self._told[length, link]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability that a piece of text is main text, for each node that is text."""
        tags, hints, parents, size = tree.tag, tree.hint, tree.parent, len(tree.tag)
        edges = {tag: self.edge[_kind(tag)] for tag in set(tags)}
        links = _links(tree)
        known: dict[tuple[str, str], tuple[float, ...]] = {}
        up: list = [None] * size
        for n in range(size):
            if tags[n]:
                key = (tags[n], hints[n])
                if key not in known:
                    known[key] = self._element(*key)
                up[n] = known[key]
        sent: list = [None] * size
        own: list = [None] * size
        for n in range(size - 1, 0, -1):  # upward: children come after their parent
            if tags[n]:
                (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = edges[tags[n]]
                x, y, z = up[n]
                p, q, r = aa * x + ab * y + ac * z, ba * x + bb * y + bc * z, ca * x + cb * y + cc * z
                most = max(p, q, r)
                told = (p / most, q / most, r / most)
            else:
                own[n], told = self._text(_length(tree.text[n]), links[n])
            sent[n] = told
            x, y, z = up[parents[n]]
            x, y, z = x * told[0], y * told[1], z * told[2]
            most = max(x, y, z)
            up[parents[n]] = (x / most, y / most, z / most)
        out = [0.0] * size
        both: list = [None] * size
        both[0] = up[0]
        for n in range(1, size):  # downward
            x, y, z = both[parents[n]]
            told = sent[n]
            x, y, z = x / told[0], y / told[1], z / told[2]
            if tags[n]:
                (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = edges[tags[n]]
                u, v, w = up[n]
                p = u * (aa * x + ba * y + ca * z)
                q = v * (ab * x + bb * y + cb * z)
                r = w * (ac * x + bc * y + cc * z)
                most = max(p, q, r)
                both[n] = (p / most, q / most, r / most)
            else:
                rows = self.edge["text"]
                p = own[n][0] * (rows[0][0] * x + rows[1][0] * y + rows[2][0] * z)
                q = own[n][1] * (rows[0][1] * x + rows[1][1] * y + rows[2][1] * z)
                out[n] = p / (p + q)
        return out


def _kind(tag: str) -> str:
    return "text" if not tag else "block" if tag in BLOCK else "inline"


def _links(tree: Tree) -> list[bool]:
    """Whether a node is part of a link."""
    links = [False] * len(tree.tag)
    for n, parent in enumerate(tree.parent):
        links[n] = tree.tag[n] == "a" or (parent >= 0 and links[parent])
    return links


def _marked(page: str) -> tuple[Tree, list[int]]:
    """Tree and labels of a labelled page; the marks are taken out of its texts."""
    tree = parse(page)
    size = len(tree.tag)
    own: list[bool | None] = [None] * size
    pending: dict[int, bool] = {}
    for n in range(1, size):
        parent, mark = tree.parent[n], None
        if own[parent] is not None and parent:
            own[n] = own[parent]
            continue
        if tree.tag[n]:
            own[n] = pending.pop(parent, None)
            continue
        text = tree.text[n]
        if text[:1] in ("+", "-"):
            mark, text = text[0] == "+", text[1:]
        if text[-1:] in ("+", "-"):
            pending[parent], text = text[-1] == "+", text[:-1]
        elif not text and mark is not None:
            pending[parent] = mark
        own[n], tree.text[n] = mark, text
    good, bad = [0] * size, [0] * size
    for n in range(size - 1, -1, -1):
        if not tree.tag[n] and tree.text[n].strip():
            good[n], bad[n] = (1, 0) if own[n] else (0, 1)
        if tree.parent[n] >= 0:
            good[tree.parent[n]] += good[n]
            bad[tree.parent[n]] += bad[n]
    labels = []
    for n in range(size):
        main = own[n] if own[n] is not None else good[n] > 0 == bad[n]
        other = own[n] is False or (own[n] is None and not good[n])
        labels.append(MAIN if main else OTHER if other else MIXED)
    # Pieces that held only a mark are no text.
    keep = [n for n in range(size) if tree.tag[n] or tree.text[n].strip()]
    at = {n: k for k, n in enumerate(keep)}
    out = Tree()
    for n in keep:
        out.add(at.get(tree.parent[n], -1), tree.tag[n], tree.hint[n], tree.text[n])
    return out, [labels[n] for n in keep]


def train(pages: Iterable[str] | None = None) -> Model:
    return Model().fit(map(_marked, labelled_pages() if pages is None else pages))


def main_text(page: str | None, model: Model) -> str:
    """The blocks of main text, joined by empty lines."""
    if not page:
        return ""
    tree = parse(page)
    likely = model.marginals(tree)
    blocks, block = [], []
    for n in [*tree.pieces, BREAK]:
        if n == BREAK:
            if block:
                words = " ".join("".join(block).split())
                if words:
                    blocks.append(words)
                block = []
        elif likely[n] >= 0.5 or tree.text[n].isspace():
            block.append(tree.text[n])
        else:
            block.append(" ")
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    batch_bytes(pages.sparkSession)
    model = model or train()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(h, model) for h in batch["html"]]
            out["n_chars"] = [len(t) for t in out["text"]]
            yield out

    given = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    found = given.mapInPandas(rows, "page_id string, url string, text string, n_chars bigint")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
