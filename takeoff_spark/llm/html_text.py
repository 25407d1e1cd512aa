"""HTML extraction: a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks; each block's vector holds its hashed tag path (tags and
class words of its ancestors), hashed words and a few shape figures. A bidirectional LSTM in numpy
reads the whole sequence and labels every block as text or not, so a decision sees the whole page.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise

# Element names of HTML by their role.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end doesn't reach beyond.
FENCES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ENDS_P = BLOCK - {"body", "html", "head", "label", "button", "option", "optgroup", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "textarea", "select", "title"}

RAW, RCDATA = ("script", "style", "noscript", "iframe"), ("title", "textarea")
FOREIGN = ("svg", "math")

# The tokenizer's states as patterns; each takes what it matches once, so a page costs time in proportion to its length.
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^\s>\"'][^\s>]*+)?+))?+)")
COMMENT = re.compile(r"!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
OTHER = re.compile(r"[!?/][^>]*+(?:>|\Z)")
WORDS = re.compile(r"[a-z]+")

PATH, BAG, SHAPE = 128, 16, 10
SIZE = PATH + BAG + SHAPE
#: Element names that mark text or its surroundings in pages used for training.
MARKS = frozenset("article main nav header footer aside form".split())


def bit(token: str) -> int:
    return 1 << zlib.crc32(token.encode()) % PATH


class Node:
    """An open element: its parent, its own tokens (name, class words), and what is known of the whole path to it."""

    __slots__ = ("parent", "tokens", "bits", "names")

    def __init__(self, parent: Node | None, tokens: list[str]):
        self.parent, self.tokens = parent, tokens
        self.bits, self.names = (parent.bits, parent.names) if parent else (0, frozenset())
        for t in tokens:
            self.bits |= bit(t)
        if tokens[0] in MARKS and tokens[0] not in self.names:
            self.names |= {tokens[0]}


def path(*tokens: list[str]) -> Node | None:
    node = None
    for t in tokens:
        node = Node(node, t)
    return node


@dataclass
class Block:
    node: Node | None
    text: str
    links: float  # share of characters inside links


class Tags:
    """Reads a page's tags one after the other: text before it, name (with a slash for an end), attributes' class words."""

    def __init__(self, page: str):
        self.page, self.at, self.missing = page, 0, set()

    def skip_to_end(self, name: str) -> str | None:
        """What stands before the end tag of ``name``, beyond which reading goes on; None if there is none."""
        if name in self.missing:
            return None
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?+", re.I).search(self.page, self.at)
        if not m:
            self.missing.add(name)
            return None
        text, self.at = self.page[self.at : m.start()], m.end()
        return text

    def next(self) -> tuple[str, str | None, list[str], bool]:
        """(text, name or None at the page's end or for a comment, class words, whether the tag closes itself)."""
        page, start = self.page, self.at
        i = page.find("<", start)
        while i >= 0 and not (page[i + 1 : i + 2] in ("!", "?", "/") and page[i + 1 : i + 2] or NAME.match(page, i + 1)):
            i = page.find("<", i + 1)  # a sign, not a tag
        if i < 0:
            self.at = len(page)
            return page[start:], None, [], False
        text = page[start:i]
        if page.startswith("!--", i + 1):
            self.at = COMMENT.match(page, i + 1).end()
            return text, None, [], False
        m = NAME.match(page, i + 1)
        if not m:
            if page.startswith("/", i + 1) and i + 2 >= len(page):
                self.at = len(page)
                return page[start:], None, [], False
            self.at = OTHER.match(page, i + 1).end()
            return text, None, [], False
        at, words = m.end(), []
        while True:
            a = ATTRIBUTE.match(page, at)
            if not a:  # the page ends inside the tag, which is none then
                self.at = len(page)
                return text, None, [], False
            at = a.end()
            if a[1]:
                break
            if a[4] == "" or a[6] == "":
                self.at = len(page)
                return text, None, [], False
            if a[2].lower() in ("class", "id", "role"):
                words += WORDS.findall((a[3] or a[5] or a[7] or "").lower())
        self.at = at
        return text, m[0].lower(), words, page[at - 2] == "/"


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: text between block elements, inline elements joined, references decoded.

    Tags are read as the HTML standard's tokenizer does (attribute states, comments, raw text). A page that ends
    inside a tag loses that tag, as in a browser; an svg, object, canvas, math or template that isn't closed doesn't
    hide what follows. Time grows in proportion to the page, whatever its depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []  # open block elements and links
    places: dict[str, list[int]] = {}  # where each name stands in the stack
    parts: list[str] = []
    linked = total = 0

    def top() -> Node | None:
        for name, node in reversed(stack[-2:]):
            if name != "a":
                return node
        return None

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(top(), text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    def pop_to(i: int) -> None:
        while len(stack) > i:
            places[stack.pop()[0]].pop()

    def push(name: str, node: Node) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def text_of(chunk: str) -> None:
        nonlocal linked, total
        if chunk:
            parts.append(chunk)
            total += len(chunk)
            linked += len(chunk) * bool(places.get("a"))

    tags = Tags(page)
    while tags.at < len(page):
        chunk, name, words, closed = tags.next()
        text_of(chunk)
        if name is None:
            continue
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                flush()
                if places.get(name):
                    pop_to(places[name][-1])
            elif name == "a" and stack and stack[-1][0] == "a":
                pop_to(len(stack) - 1)
            continue
        if name in SKIPPED:
            if name in FOREIGN and closed:
                continue
            found = tags.skip_to_end(name)
            if found is None and name in RAW:
                tags.at = len(page)
            if name in ("svg", "object", "iframe"):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK and name != "a":
            continue
        if name == "a":
            if stack and stack[-1][0] == "a":
                pop_to(len(stack) - 1)
            push(name, stack[-1][1] if stack else Node(None, ["a"]))
            continue
        flush()
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if name in FENCES:
            i = last(ends)
            if i > last(FENCES[name]):
                pop_to(i)
        else:
            i = len(stack) - 1 - (bool(stack) and stack[-1][0] == "a")
            if i >= 0 and stack[i][0] in ends:
                pop_to(i)
        if name in VOID:
            continue
        node = Node(top(), [name, *("." + w for w in words)])
        if name in RCDATA:
            text = tags.skip_to_end(name)
            if text is not None:
                push(name, node)
                text_of(text)
                flush()
                pop_to(len(stack) - 1)
                continue
        push(name, node)
    flush()
    return out


def vector(b: Block, place: float) -> np.ndarray:
    v = np.zeros(SIZE, np.float32)
    if b.node:
        bits = b.node.bits | bit("leaf" + b.node.tokens[-1])
        v[:PATH] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
    words = b.text.lower().split()
    v[PATH : PATH + BAG] = np.bincount([zlib.crc32(w.encode()) % BAG for w in words], minlength=BAG) / len(words)
    n = len(b.text)
    v[PATH + BAG :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, b.links, b.text[-1] in ".!?…", b.text.count(",") / (len(words) + 1), len(words) < 4, n > 200, place, b.links > 0.5, 1)
    return v


def matrix(page: list[Block]) -> np.ndarray:
    return np.array([vector(b, i / len(page)) for i, b in enumerate(page)], np.float32).reshape(-1, SIZE)


class Lstm:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.15, (SIZE, 4 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["v"], self.p["o"] = rng.normal(0, 0.15, 2 * hidden).astype(np.float32), np.zeros(1, np.float32)

    def one_way(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps, _ = x.shape
        k = self.hidden
        zx = x @ self.p["w" + d] + self.p["c" + d]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.zeros((n, steps, k), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = zx[:, t] + h @ self.p["u" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * k]))
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            c2 = m * (f * c + i * g)
            th = np.tanh(c2)
            h2 = m * o * th
            if keep:
                tape.append((t, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self.one_way("f", x, mask, keep)
        b, tb = self.one_way("b", x, mask, keep)
        h = np.concatenate([f, b], axis=2)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["o"], -30, 30))), h, (tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, tapes = self.run(x, mask, True)
        k = self.hidden
        err = ((p - y) * mask / max(1.0, mask.sum())).astype(np.float32)
        g = {"v": np.einsum("nt,nth->h", err, h), "o": np.array([err.sum()], np.float32)}
        dh_all = err[:, :, None] * self.p["v"]
        for d, tape, part in (("f", tapes[0], dh_all[:, :, :k]), ("b", tapes[1], dh_all[:, :, k:])):
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            g["u" + d] = np.zeros_like(self.p["u" + d])
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for t, h0, c0, i, f, o, gg, th, m in reversed(tape):
                dh = (dh + part[:, t]) * m
                dc = (dc + dh * o * (1 - th**2)) * m
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                dz_all[:, t] = dz
                g["u" + d] += h0.T @ dz
                dh, dc = dz @ self.p["u" + d].T, dc * f
            g["w" + d] = np.einsum("nts,ntz->sz", x, dz_all, optimize=True)
            g["c" + d] = dz_all.sum(axis=(0, 1))
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, SIZE), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# Training pages: sampled pages, labelled by their own semantic elements, with rearranged markup.

#: Class words that sites use for each kind of block (our choice of examples for training).
ROLES = {
    "nav": "menu navbar navigation breadcrumb breadcrumbs links tabs", "header": "header masthead topbar banner branding", "footer": "footer bottom copyright legal colophon",
    "aside": "sidebar related widget recommended trending rail promo teaser", "notice": "notice cookie consent alert banner popup modal newsletter warning", "ad": "ad ads advert advertisement sponsored sponsor promo",
    "form": "form search login signup subscribe contact", "comments": "comments comment discussion replies reply responses disqus feedback",
}
CONTENT = "article content post entry story main body text page".split()
TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "aside", "p"), "ad": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol", "aside")}


SURROUNDINGS = frozenset("nav header footer aside form".split())


def weak_labels(page: list[Block]) -> list[int] | None:
    """1 for blocks inside the page's article (else main) element, 0 for others; None if it has neither or both kinds don't occur."""
    for tag in ("article", "main"):
        marks = [int(b.node is not None and tag in b.node.names and not SURROUNDINGS & b.node.names) for b in page]
        if 0 < sum(marks) < len(marks):
            return marks
    return None


def rough_labels(page: list[Block]) -> list[int]:
    """Where no sampled page has such elements: 1 for blocks of ten words and more, few of them linked, outside the surroundings."""
    return [int(b.links < 0.5 and len(b.text.split()) >= 10 and not (b.node and SURROUNDINGS & b.node.names)) for b in page]


def extra(rng: random.Random, role: str, texts: list[str], inside: Node) -> list[Block]:
    """A few boilerplate blocks of a role with words taken from the sample."""
    tag = rng.choice(TAGS[role])
    own = Node(inside, [tag] + (["." + rng.choice(ROLES[role].split())] if tag in ("div", "section", "p", "ul", "ol") or rng.random() < 0.5 else []))
    out = []
    for _ in range(rng.randrange(1, 8 if role in ("nav", "comments", "aside") else 4)):
        words = rng.choice(texts).split()
        n = rng.randrange(1, 5) if role in ("nav", "form") else rng.randrange(2, 40)
        s = rng.randrange(max(1, len(words) - n))
        leaf = {"nav": [["li"], ["ul", "li"], []], "form": [["label"], ["button"], ["p"], ["option"], []], "comments": [["p"], ["div", ".comment", "p"], ["li"], ["article", ".comment", "p"], ["h3"]], "aside": [["p"], ["li"], ["h3"], ["div"], ["ul", "li"]]}.get(role, [["p"], [], ["div"], ["span"]])
        tokens = rng.choice(leaf)
        out.append(Block(Node(own, tokens) if tokens else own, " ".join(words[s : s + n]), 1.0 if role == "nav" or (role in ("aside", "footer") and rng.random() < 0.4) else 0.0))
    return out


def rearranged(page: list[Block], marks: list[int], rng: random.Random, texts: list[str]) -> tuple[list[Block], list[int]]:
    """The same page with another container around its text and further boilerplate before, in and after it."""
    tag = "article" if any(b.node and "article" in b.node.names for b in page) else "main"
    to = rng.choice([[tag]] * 4 + [["main"], ["article"], ["main", "article"], ["div", "." + rng.choice(CONTENT)], ["section", "." + rng.choice(CONTENT)], ["div", "." + rng.choice(CONTENT), "div"]])
    top = Node(None, rng.choice([["html", "body"], ["html", "body"], ["html", "body", "div"], ["html", "body", "div", ".wrapper"]]))
    inside, moved = Node(top, to), {}

    def below(node: Node) -> Node:
        """The node with ``inside`` in place of its path down to the outermost ``tag``."""
        chain = []
        while node and tag in node.names and node not in moved:
            chain.append(node)
            node = node.parent
        new = moved.get(node, inside)
        for x in reversed(chain):
            moved[x] = new = inside if tag not in (x.parent.names if x.parent else ()) else Node(new, x.tokens)
        return new

    before, text, after, seen = [], [], [], False
    for b, m in zip(page, marks, strict=True):
        if m:
            seen = True
            text.append((Block(below(b.node), b.text, b.links), 1))
        else:
            (after if seen else before).append((b, 0))
    for role in TAGS:
        if rng.random() < 0.35:
            got = [(b, 0) for b in extra(rng, role, texts, top)]
            where = after if role in ("footer", "comments") or (role in ("aside", "notice", "ad", "form") and rng.random() < 0.5) else before
            where[len(where) if rng.random() < 0.7 else 0 : 0] = got
        if role in ("ad", "notice", "aside", "form", "comments") and rng.random() < 0.2 and text:
            i = len(text) if role == "comments" else rng.randrange(1, len(text) + 1)
            text[i:i] = [(b, 0) for b in extra(rng, role, texts, inside)]
    both = before + text + after
    return [b for b, _ in both], [m for _, m in both]


def train(pages: list[str], variants: int = 4, epochs: int = 8, seed: int = 5) -> Lstm:
    rng = random.Random(seed)
    found = [b for b in map(blocks, pages) if b]
    parsed = [(b, m) for b in found if (m := weak_labels(b))]
    marked = bool(parsed)
    parsed = parsed or [(b, rough_labels(b)) for b in found]
    texts = [b.text for p, _ in parsed for b in p] or ["text"]
    data = []
    for p, m in parsed:
        data.append((matrix(p), m))
        for _ in range(variants if marked else 0):
            q, n = rearranged(p, m, rng, texts)
            data.append((matrix(q), n))
    net = Lstm()
    first, second = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        rng.shuffle(data)
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        rng.shuffle(batches)
        for some in batches:
            x, mask = padded([data[i][0] for i in some])
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(some):
                y[r, : len(data[i][1])] = data[i][1]
            t += 1
            for k, g in net.gradients(x, mask, y).items():
                g = g * min(1.0, 1.0 / (np.linalg.norm(g) + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                net.p[k] -= (0.01 if epoch < epochs - 2 else 0.002) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)
    return net


def fit(pages: DataFrame, sample: int = 240, most_chars: int = 20_000_000) -> Lstm:
    """Train on whole pages, at most ``sample`` of them and ``most_chars`` characters together, those of the smallest id hash first.

    A page that doesn't fit into what is left of ``most_chars`` is passed over. Pages with an article or main element
    label their blocks; if no sampled page has one, ``rough_labels`` do. Without any pages the network stays untrained.
    """
    rows = pages.select(F.col("page_id").alias("i"), F.col("html").cast("string").alias("h")).where("h is not null")
    ids = rows.select(F.col("i").alias("picked")).orderBy(F.xxhash64("picked"), "picked").limit(sample).distinct()  # at most ``sample`` ids, sorted without their pages
    some = rows.join(F.broadcast(ids), F.col("i").eqNullSafe(F.col("picked")), "left_semi").groupBy("i").agg(F.min("h").alias("h"))  # of rows that repeat an id the smallest
    some = materialise(some, "sample")
    left, chosen = most_chars, []
    for i, n in some.select("i", F.length("h")).orderBy(F.xxhash64("i"), "i").collect():
        if n <= left:
            left -= n
            chosen.append((i,))
    few = pages.sparkSession.createDataFrame(chosen, some.select(F.col("i").alias("k")).schema)
    return train([r.h for r in some.join(F.broadcast(few), F.col("i").eqNullSafe(F.col("k")), "left_semi").orderBy(F.xxhash64("i"), "i").collect()])


def label(net: Lstm, pages: list[list[Block]], most: int = 20_000) -> list[np.ndarray]:
    """Probability of text for each block of each page; pages of like length run together, ``most`` steps at a time."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= most:
            end += 1
        x, mask = padded([matrix(pages[i]) for i in order[at:end]])
        p, _, _ = net.run(x, mask)
        for r, i in enumerate(order[at:end]):
            out[i] = p[r, : len(pages[i])]
        at = end
    return out


def main_text(pages: DataFrame, net: Lstm) -> DataFrame:
    """page_id, url, text (blocks labelled as text, in page order, joined by an empty line) and n_chars.

    A null or empty html gives the empty text; repeated rows give repeated rows; nothing is cut off.
    No shuffle: the network (some 100 kB) goes to every task.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(net)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            parsed = [blocks(h) for h in b.column(2).to_pylist()]
            texts = ["\n\n".join(x.text for x, q in zip(page, p, strict=True) if q >= 0.5) for page, p in zip(parsed, label(shipped.value, parsed), strict=True)]
            return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return batch

    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
