"""Main text of web pages by minimum-cut labelling.

A page is read into *blocks*: the text between block-level tags, with the open
elements around it.  A logistic classifier, trained on pages whose semantic
elements tell content from boilerplate, gives each block a cost for either
label from how it is written and where it stands; what the elements around it say (an
article, a menu, a class named "sidebar") is added to the costs.  The costs are
the terminal capacities of a graph, and blocks that follow each other or share
a parent are joined by smoothness edges, the stronger the closer they are in
the DOM.  The minimum cut, found by maximum flow, separates content from
boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pages the classifier is fitted on, in the order of a hash of page_id, and their length
SAMPLE_PAGES, SAMPLE_CHARS = 1500, 100_000

#: prior mean and precision of the classifier's weights: intercept, words, links, word length, sentence
#: end, punctuation, list, symbols, place, words before, words behind, links around
EXPECTED = np.array([-0.6, 0.6, -5.0, 0.0, 1.0, 0.5, -0.5, -1.0, 0.0, 0.1, 0.1, -1.0])
PRIOR = 20.0

# ---- fixed values of HTML --------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
SKIPPED = frozenset("head script style noscript template svg canvas object iframe select button textarea "
                    "audio video map math noembed noframes datalist dialog".split())
#: elements that hold raw characters up to their end tag
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                  "ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag ends these open elements, up to the barrier
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "body": ({"head"}, set())}

# ---- what elements and their names say -------------------------------------
MENU_TAGS = frozenset("nav aside footer".split())
#: what follows these in a name is what the page is about or lacks, not what the element is
ABOUT = frozenset("has with without no tag category".split())
#: names of parts that never hold an article's own text, not even in an <article>
NEVER = frozenset("comment comments disqus reply replies respond hidden".split())
AWAY = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads "
                 "advert adverts advertisement advertising banner promo promotion sponsor sponsored popup modal overlay "
                 "cookie cookies consent gdpr notice notification newsletter subscribe subscription signup login "
                 "share sharing social related recommended recommendations teaser pagination pager toolbar copyright "
                 "disclaimer search skip".split())
CONTENT = frozenset("article content post entry story main".split())
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Element(NamedTuple):
    tag: str
    number: int      # in order of the page
    says: str        # 'never', 'away', 'article', 'open', 'content', 'header' or ''; with '?' until the page is read
    parent: int


class Block(NamedTuple):
    text: str
    path: tuple      # of Element, outermost first
    link_chars: int


def _says(tag: str, attributes: str) -> str:
    names: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for name in value.split():
                for x in _NAME.findall(name):
                    if x.lower() in ABOUT:
                        break
                    names.add(x.lower())
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    if tag in ("html", "body"):
        return ""
    if hidden:
        return "never"
    if names & NEVER:
        return "never?"
    if tag in MENU_TAGS:
        return "away"
    if tag == "form" or names & AWAY:
        return "away?"
    if tag in ("article", "main") or "main" in names:
        return "article"
    if tag == "header" or "header" in names:
        return "header"
    return "content" if names & CONTENT else ""


def _settle(blocks: list[Block]) -> list[Block]:
    """Blocks where names of elements and forms say only what they can.  One that
    holds most of the page's text says nothing, unless content stands outside of
    it; other names leave an article open, but for a comment in an article."""
    held: dict[int, int] = {}       # characters of each element
    within: dict[int, int] = {}     # those that an article or content holds
    total = content = 0
    for b in blocks:
        size = len(b.text)
        last = next((e.says for e in reversed(b.path) if e.says not in ("", "header")), "")
        good = size if (last in ("article", "content") and 2 * b.link_chars < size
                        and not any(e.tag in HEADINGS or e.says == "header" for e in b.path)) else 0
        total, content = total + size, content + good
        for e in b.path:
            if e.says.endswith("?"):
                held[e.number] = held.get(e.number, 0) + size
                within[e.number] = within.get(e.number, 0) + good
    if not held:
        return blocks
    said: dict[int, str] = {}

    def settle(e: Element, inside: bool) -> str:
        article = e.tag in ("article", "main")
        if 2 * held[e.number] > total and content == within[e.number]:
            return "article" if article else ""
        return "open" if article and not (inside and e.says == "never?") else e.says[:-1]
    out = []
    for b in blocks:
        path, inside = [], False
        for e in b.path:
            if e.says.endswith("?"):
                if e.number not in said:
                    said[e.number] = settle(e, inside)
                e = e._replace(says=said[e.number])
            inside = inside or e.tag in ("article", "main")
            path.append(e)
        out.append(b._replace(path=tuple(path)))
    return out


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in order.  White space is one blank."""
    out: list[Block] = []
    stack: list[Element] = []
    skipped = 0     # open elements that hide their content
    links = 0
    count = 0
    parts: list[str] = []
    link_chars = 0
    path: tuple = ()

    def flush() -> None:
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, path, link_chars))
        parts, link_chars = [], 0

    def pop(to: int) -> None:
        nonlocal skipped, links, path
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        while len(stack) > to:
            tag = stack.pop().tag
            skipped -= tag in SKIPPED
            links -= tag == "a"

    def say(text: str) -> None:
        nonlocal link_chars, path
        if skipped or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if not parts or not path:
            path = tuple(stack)
        if links:
            link_chars += len(text.strip())
        parts.append(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block starts
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, barrier = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in ends:
                    pop(i)
                    break
        if tag in VOID:
            continue
        count += 1
        if not (m[3].endswith("/") and tag not in BLOCK):
            stack.append(Element(tag, count, _says(tag, m[3]), stack[-1].number if stack else 0))
            skipped += tag in SKIPPED
            links += tag == "a"
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            if end is None and tag not in ("title",):
                at = len(page)
            elif end is not None:
                at = end.start()
    flush()
    return _settle(out)


# ---- costs -----------------------------------------------------------------

def semantic(block: Block) -> tuple[float, str]:
    """(cost difference in favour of content, the label the elements alone give
    or '').  The innermost element that says something decides, but what stands
    in a comment section stays there, and a header in an article counts only
    against what is no heading.  An open element leaves its blocks to the
    learned costs and the cut."""
    inside, value, label = False, 0.0, ""
    for e in block.path:
        if e.says == "never":
            return -20.0, "boilerplate"
        if e.says == "article":
            inside, value, label = True, 8.0, "content"
        elif e.says == "away":
            inside, value, label = False, -12.0, "boilerplate"
        elif e.says == "open":
            if value > 0:
                inside, value, label = False, 0.0, ""
        elif e.says == "content" and not inside and value >= 0:
            value = 4.0
        elif e.says == "header":
            heading = any(x.tag in HEADINGS for x in block.path)
            if inside or value > 0:
                value, label = (value, label) if heading else (-4.0, "")
            elif not heading or value < 0:
                value, label = -8.0, "boilerplate"
    return value, label


def features(blocks: list[Block]) -> np.ndarray:
    """How blocks are written and where they stand; nothing that ``semantic`` uses."""
    n = len(blocks)
    out = np.zeros((n, len(EXPECTED)))
    lengths = np.array([len(b.text) for b in blocks], float)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    density = np.array([min(1.0, b.link_chars / len(b.text)) for b in blocks])
    for i, b in enumerate(blocks):
        t, tags = b.text, [e.tag for e in b.path]
        out[i, :8] = (1, np.log1p(words[i]), density[i], lengths[i] / words[i] / 10,
                      t[-1] in ".!?…\"”", sum(map(t.count, ".!?,;")) / words[i],
                      "li" in tags, bool(re.search("[©·|»]", t)))
    out[:, 8] = np.arange(n) / max(1, n - 1)
    out[1:, 9], out[:-1, 10] = np.log1p(words[:-1]), np.log1p(words[1:])
    out[:, 11] = (np.concatenate(([0], density[:-1])) + np.concatenate((density[1:], [0]))) / 2 if n else 0
    return out


def fit(pages: list[str]) -> np.ndarray:
    """Weights of a logistic classifier of blocks.  The labels are those that the
    semantic elements give, the prior mean of the weights is ``EXPECTED``; without
    blocks of both labels they stay there."""
    xs, ys = [np.zeros((0, len(EXPECTED)))], [np.zeros(0)]
    for page in pages:
        blocks = read_blocks(page)
        labels = [semantic(b)[1] for b in blocks]
        known = [i for i, x in enumerate(labels) if x]
        xs.append(features(blocks)[known])
        ys.append(np.array([labels[i] == "content" for i in known], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = EXPECTED.copy()
    if not 0 < y.sum() < len(y):
        return w
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -20, 20)))
        s = p * (1 - p) + 1e-6
        w = w + np.linalg.solve((x * s[:, None]).T @ x + PRIOR * np.eye(len(w)),
                                x.T @ (y - p) - PRIOR * (w - EXPECTED))
    return w


# ---- minimum cut -----------------------------------------------------------

def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight): blocks that follow each other, by how much of their
    paths they share, and the next block under the same parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        holders = [e.number for e in b.path if e.tag in BLOCK]
        if i:
            before = [e.number for e in blocks[i - 1].path if e.tag in BLOCK]
            same = sum(1 for x, y in zip(holders, before, strict=False) if x == y)
            edges.append((i - 1, i, 1.5 * same / max(len(holders), len(before), 1)))
        parent = holders[-2] if len(holders) > 1 else 0
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 1.0))
        last[parent] = i
    return edges


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of the costs against the sign of ``unary``
    and of the weights of edges between different labels.  A node whose own
    cost outweighs all its edges has its label in a minimum cut; such nodes are
    taken out first, and the flow runs through what remains."""
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
        cap[source], cap[sink] = {}, {}
        for i in left:
            cap[source][i], cap[i][source] = max(u[i], 0.0), 0.0
            cap[i][sink], cap[sink][i] = max(-u[i], 0.0), 0.0
        reached = _max_flow(cap, source, sink)
        for i in left:
            label[i] = i in reached
    return [bool(x) for x in label]


def _max_flow(cap: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Level graphs and blocking flows until the sink is out of reach; the
    nodes that the source still reaches."""
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        untried = {i: list(cap[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(cap[a][b] for a, b in steps)
                for a, b in steps:
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(steps) if cap[a][b] <= 1e-12)
                del path[full + 1:]
                continue
            while untried[i]:
                j = untried[i][-1]
                if cap[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                untried[i].pop()
            else:
                path.pop()
                if path:
                    untried[path[-1]].pop()


def extract_text(page: str, weights: np.ndarray) -> str:
    """Main text of a page: its content blocks, joined by an empty line."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    learned = np.clip(features(blocks) @ weights, -4, 4)
    unary = [float(x) + semantic(b)[0] for x, b in zip(learned, blocks, strict=True)]
    keep = min_cut(unary, smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


# ---- on tables -------------------------------------------------------------

def train(pages: DataFrame) -> np.ndarray:
    """Weights from a bounded sample of pages."""
    some = pages.where(F.char_length("html") <= SAMPLE_CHARS).select("page_id", "html")
    ids = some.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    rows = some.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).orderBy("page_id").collect()
    return fit([r["html"] for r in rows])


def extract(pages: DataFrame, weights: np.ndarray | None = None, html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (its code points).

    A null page is empty; an empty one, or one of boilerplate alone, has an
    empty text.  Repeated rows and null ids are extracted like others, other
    columns are ignored; an empty table gives an empty result."""
    weights = train(pages) if weights is None else weights
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 256):  # a few pages at a time in memory
                texts += [extract_text(x or "", weights) for x in batch.column("html").slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(html_column).alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
