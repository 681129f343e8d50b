"""Main text of web pages: boosted trees over page nodes, decoded along the tree."""

from __future__ import annotations

import html
import math
import random
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import per_text

#: Pages that the trees are fitted on, longer ones left out; trees, their depth and rate.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 100_000
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32
#: Log-odds that it costs to drop a node whose parent stays.
SWITCH = 2.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button center dd details dialog dir div dl"
    " dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend"
    " li main menu nav ol option p pre search section select summary svg table tbody td template"
    " tfoot th thead tr ul caption".split()
)
#: Elements that an opening tag closes, as browsers do, and those beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
KEEPS_P = frozenset("button table td th caption html body".split())
# What elements and words of attributes say about their content.
OUTSIDE = frozenset(
    "nav footer aside form button select option dialog menu template svg fieldset head search".split()
)
INSIDE = frozenset("article main".split())
BAD_WORDS = (
    "ad ads advert advertisement advertising sponsor sponsored promo promoted promotion banner"
    " nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside"
    " widget related recommended share sharing social comment comments discussion reply replies"
    " respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter"
    " subscribe subscription signup login search form toolbar pagination pager tags copyright"
    " complementary contentinfo dialog hidden offscreen skip rail teaser outbrain taboola"
).split()
GOOD_WORDS = "article content post entry main story text body prose page".split()

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NOTED = ("class", "id", "role", "hidden", "aria", "style", "itemprop")
BAD, GOOD = frozenset(BAD_WORDS), frozenset(GOOD_WORDS)


class Page(NamedTuple):
    """Nodes in page order (element, parent, words of attributes, depth) and blocks of text
    (node, text, characters within links)."""

    tags: list[str]
    parents: list[int]
    words: list[frozenset]
    depths: list[int]
    blocks: list[tuple[int, str, int]]


def attribute_words(text: str) -> frozenset:
    if not any(n in text for n in NOTED):
        return frozenset()
    out = set()
    for name, value in ATTRIBUTE.findall(text):
        name = name.lower()
        value = html.unescape(value.strip("\"'"))
        if name in ("class", "id", "role", "itemprop"):
            out.update(w.lower() for w in WORDS.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            out.add("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add("hidden")
    return frozenset(out)


def parse(source: str) -> Page:
    """The page as block elements and blocks of text, as forgiving as a browser."""
    page = Page(["html"], [-1], [frozenset()], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their nearest node
    pieces: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    # Places of the open elements by name, and of those that are blocks: no search of the stack.
    places: dict[str, list[int]] = {}
    block_places = [0]

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            block_places.append(len(stack))
        stack.append((name, node))

    def last(names: frozenset | set | tuple) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(at: int) -> None:
        nonlocal links
        if block_places[-1] >= at:
            flush()
        while len(stack) > max(at, 1):
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                block_places.pop()
            links -= name == "a"

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    def close_p() -> None:
        at = last(("p",))
        if at > last(KEEPS_P):
            close(at)

    position = 0
    while True:
        found = TAG.search(source, position)
        if not found:
            if position < len(source):
                add(source[position:])
            break
        if found.start() > position:
            add(source[position : found.start()])
        position = found.end()
        ending, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if ending:
            at = last((name,))
            if at and (name in BLOCKS or block_places[-1] < at):
                close(at)
            continue
        if name == "html":
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(source, position)
            position = end.end() if end else len(source)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "wbr", "input"):
                add("" if name == "wbr" else " ")
            continue
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            while (at := last(closed)) > last(bounds):
                close(at)
                if name != "tr":
                    break
        if name in BLOCKS:
            flush()
            close_p()
            words = attribute_words(rest) if rest else frozenset()
            page.tags.append(name)
            page.parents.append(stack[-1][1])
            page.words.append(words)
            page.depths.append(page.depths[stack[-1][1]] + 1)
            if not rest.endswith("/") or name != "svg":
                push(name, len(page.tags) - 1)
        else:
            if name == "a":
                links += 1
            push(name, stack[-1][1])
    close(0)
    flush_rest = pieces and " ".join(html.unescape("".join(pieces)).split())
    if flush_rest:
        page.blocks.append((0, flush_rest, 0))
    return page


GROUPS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"div"},
    {"section"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"header"}, {"nav"},
    {"footer"}, {"aside"}, {"form", "fieldset", "search"}, {"article", "main"},
    {"blockquote", "pre", "figure", "figcaption"}, {"html", "body"}, OUTSIDE,
]
N_FEATURES = len(GROUPS) + 20


def node_features(page: Page) -> np.ndarray:
    """One row per node: element, words of attributes of it and what it lies in, density of
    text, links and elements in its subtree, depth, place, and what its siblings hold."""
    n = len(page.tags)
    chars, linked, marks, nodes, texts = ([0] * n for _ in range(5))
    direct, shortest = [0] * n, [0] * n
    for node, text, link in page.blocks:
        direct[node] += len(text)
        linked[node] += link
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        texts[node] += 1
    chars[:] = direct
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        nodes[p] += nodes[i] + 1
        for values in (chars, linked, marks, texts):
            values[p] += values[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parents[i]].append(i)
    total = max(1, chars[0])
    before, seen = [0] * n, 0
    at = 0
    for i in range(n):
        while at < len(page.blocks) and page.blocks[at][0] < i:
            seen += len(page.blocks[at][1])
            at += 1
        before[i] = seen
    out = np.zeros((n, N_FEATURES))
    bad_above, good_above, out_above, in_above = ([0] * n for _ in range(4))
    for i in range(n):
        p = page.parents[i]
        if p >= 0:
            bad_above[i] = bad_above[p] + len(page.words[p] & BAD)
            good_above[i] = good_above[p] + len(page.words[p] & GOOD)
            out_above[i] = out_above[p] + (page.tags[p] in OUTSIDE)
            in_above[i] = in_above[p] + (page.tags[p] in INSIDE)
        row = out[i]
        for k, group in enumerate(GROUPS):
            row[k] = page.tags[i] in group
        siblings = children[p] if p >= 0 else [i]
        place = siblings.index(i) if len(siblings) < 50 else min(50, i - siblings[0])
        around = chars[p] - chars[i] if p >= 0 else 0
        row[len(GROUPS) :] = (
            len(page.words[i] & BAD),
            len(page.words[i] & GOOD),
            min(3, bad_above[i]),
            min(3, good_above[i]),
            min(3, out_above[i]),
            min(3, in_above[i]),
            math.log1p(chars[i]),
            math.log1p(direct[i]),
            linked[i] / max(1, chars[i]),
            marks[i] / max(1, chars[i]),
            nodes[i] / max(1, chars[i]),
            math.log1p(nodes[i]),
            math.log1p(chars[i] / max(1, texts[i])),
            page.depths[i],
            place,
            min(50, len(siblings)),
            math.log1p(around),
            chars[i] / total,
            before[i] / total,
            len(page.words[i]),
        )
    return out


def rule_labels(page: Page) -> list[int]:
    """What the names of elements and attributes say: 1 for the main text and what holds it."""
    n = len(page.tags)
    outside, inside = [False] * n, [False] * n
    for i in range(n):
        p = page.parents[i]
        bad = page.tags[i] in OUTSIDE or bool(page.words[i] & BAD and not page.tags[i] in INSIDE)
        head = page.tags[i] == "header" and not (p >= 0 and inside[p])
        outside[i] = (p >= 0 and outside[p]) or bad or head
        inside[i] = (p >= 0 and inside[p]) or page.tags[i] in INSIDE
    some = any(inside[i] and not outside[i] for i in range(n))
    return [int(not outside[i] and (inside[i] or not some or page.tags[i] in ("html", "body", "div", "section"))) for i in range(n)]


def training_pages(pages: list[str], seed: int) -> list[tuple[Page, list[int]]]:
    """Sampled pages with labels by rule, as they are and changed: parts that pages commonly
    have are added from the texts at hand, under many names, and names are taken away, so that
    the trees also learn what text and links look like."""
    rng = random.Random(seed)
    known = [(p, rule_labels(p)) for p in map(parse, pages)]
    prose = [text for p, _ in known for _, text, _ in p.blocks][:5000]
    prose = prose or ["A few words of text, and some more.", "Another line. It ends here."]
    out = list(known)
    for page, labels in known:
        for _ in range(2):
            tags, parents, words, depths = (list(x) for x in (page.tags, page.parents, page.words, page.depths))
            blocks, own = list(page.blocks), list(labels)
            body = tags.index("body") if "body" in tags else 0
            main = next((i for i, t in enumerate(tags) if t in INSIDE), body)
            for _ in range(rng.randint(1, 5)):
                holder = rng.choice((body, body, main))
                tag = rng.choice(("div", "div", "section", "aside", "form", "header", "ul", "footer"))
                named = rng.random() < 0.85 or holder == main or tag in ("div", "section", "ul")
                if tag == "header" and holder == main:
                    tag = "div"
                tags.append(tag)
                parents.append(holder)
                words.append(frozenset([rng.choice(BAD_WORDS)] if named else []))
                depths.append(depths[holder] + 1)
                own.append(0)
                top = len(tags) - 1
                for _ in range(rng.randint(1, 6)):
                    inner = rng.choice(("p", "li", "div", "p"))
                    tags.append(inner)
                    parents.append(top)
                    words.append(frozenset())
                    depths.append(depths[top] + 1)
                    own.append(0)
                    text = rng.choice(prose)
                    link = rng.random() < 0.4
                    text = text[: rng.randint(5, 40)] if link else text
                    blocks.append((len(tags) - 1, text, len(text) if link else 0))
            if rng.random() < 0.5:
                tags = ["div" if t in INSIDE or t in OUTSIDE and rng.random() < 0.5 else t for t in tags]
                if rng.random() < 0.5:
                    words[main] = frozenset([rng.choice(GOOD_WORDS)])
            out.append((in_page_order(Page(tags, parents, words, depths, blocks), own, rng)))
    return out


def in_page_order(page: Page, labels: list[int], rng: random.Random) -> tuple[Page, list[int]]:
    """Nodes renumbered in page order; added nodes come at a random place among siblings."""
    children: list[list[int]] = [[] for _ in page.tags]
    for i in range(1, len(page.tags)):
        own = children[page.parents[i]]
        own.insert(rng.randint(0, len(own)) if labels[i] == 0 else len(own), i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += reversed(children[i])
    new = {old: k for k, old in enumerate(order)}
    blocks = sorted(((new[i], t, n) for i, t, n in page.blocks), key=lambda b: b[0])
    ordered = Page(
        [page.tags[i] for i in order],
        [new.get(page.parents[i], -1) for i in order],
        [page.words[i] for i in order],
        [page.depths[i] for i in order],
        blocks,
    )
    return ordered, [labels[i] for i in order]


class Trees(NamedTuple):
    """Boosted trees of one depth: split features, limits and leaf values."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with binned features and Newton leaves."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    inner = 2**DEPTH - 1
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    score = np.full(len(y), base)
    features, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-9)
            pick = np.zeros(width, np.int64)
            where = np.full(width, np.inf)
            for f in range(x.shape[1]):
                key = (at - first) * (BINS + 1) + binned[:, f]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    b = gain.argmax(1)
                    top = gain[np.arange(width), b]
                    better = top > best
                    best, pick = np.where(better, top, best), np.where(better, f, pick)
                    where = np.where(better, cuts[f][b], where)
            feature[first : first + width], limit[first : first + width] = pick, where
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - inner
        values = -np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1) * RATE
        score += values[leaf]
        features.append(feature)
        limits.append(limit)
        leaves.append(values)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest choice in which nothing stays below a node that goes; each node that goes
    from one that stays costs ``SWITCH``."""
    n = len(page.tags)
    odds = np.clip(odds, -8, 8)
    stay, go = odds.tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):
        stay[page.parents[i]] += max(stay[i], go[i] - SWITCH)
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and stay[i] > -SWITCH
    return kept


def fit(pages: list[str], seed: int = 7) -> Trees:
    rows, labels = [], []
    for page, own in training_pages(pages, seed):
        rows.append(node_features(page))
        labels += own
    if not rows:
        return fit(["<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><p>Some text here.</article></body>"], seed)
    return boost(np.concatenate(rows), np.array(labels, float))


def extract(
    df: DataFrame,
    text: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    sample_pages: int = SAMPLE_PAGES,
    seed: int = 7,
) -> DataFrame:
    """``keep`` with the main text of every page, and its length in code points.

    Trees are fitted on a bounded sample of pages with labels by rule, then applied to all nodes
    of every whole page. A choice is decoded along the tree; blocks of the nodes that stay are
    joined by empty lines, character references decoded and white space made one space. Null and
    empty pages, and pages without main text, give an empty text. Repeated rows stay; an empty
    table gives an empty result; columns other than ``keep`` are not read, and one of those that
    is called ``text`` or ``n_chars`` gives way to the result. Elements may nest to any depth: a
    page takes time by its length alone."""
    short = df.select(F.col(f"`{text}`").alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    short = short.withColumn("roll", F.xxhash64(F.lit(seed), "html"))
    # The smallest hashes are found without the pages, which then come by themselves.
    rolls = short.select("roll").distinct().orderBy("roll").limit(sample_pages)
    sample = short.join(F.broadcast(rolls), "roll").dropDuplicates(["roll"]).orderBy("roll")
    # A plain tuple, as workers may not have this module.
    model = df.sparkSession.sparkContext.broadcast(tuple(fit([r["html"] for r in sample.collect()], seed)))
    fields = T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def start():
        trees = Trees(*model.value)

        def work(sources: list) -> dict:
            pages = [parse(s or "") for s in sources]
            rows = [node_features(p) for p in pages]
            odds = trees.log_odds(np.concatenate(rows))
            texts, at = [], 0
            for page, own in zip(pages, rows):
                kept = decode(page, odds[at : at + len(own)])
                at += len(own)
                texts.append("\n\n".join(t for node, t, _ in page.blocks if kept[node]))
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return per_text(df, text, [c for c in keep if c not in fields.names], fields, start)
