"""HTML extraction by a recurrent block labeller.

A page is read into its leaf blocks: the text between block-level tags, with the path of open elements above it. Each
block gets a vector: the sum of embeddings of its path's tags and of their class, id and role words, the mean of
embeddings of its words (both by hash), and its length and link share. A bidirectional LSTM (numpy) reads the blocks of a page
in order and labels every block as main text or not with the whole page in view; the main blocks are joined by line
ends. The weights are trained by ``html_training`` on pages that it makes up, and are kept in ``block_labeller.npz``.

Defined cases: a null or empty page, and one without a main block, gives an empty text; character references are decoded
once; white space in a block becomes one space, and line breaks count as white space; unclosed and stray tags are
tolerated, also a left-out </head> and an svg that never ends; contents of scripts, styles, titles and the like are never
blocks, formulas and what stands in for an object are text; reading takes time in proportion to the page's length; repeated rows each get their row.
Other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 2048, 2048, 24, 8, 16
EXTRA = 3  # log of characters, share of characters in links, constant
BATCH_BLOCKS = 6_000
STRIDE = 2_048  # blocks whose gates are held at a time

MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics"
INLINE = frozenset(
    f"a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr {MATH}".split()
)
SPACE = frozenset(["br"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text. RAW ones hold no tags; the others may be nested.
RAW = frozenset("script style textarea title iframe noscript".split())
UNREAD = frozenset("template svg select annotation annotation-xml".split())
HEAD = frozenset("head base link meta template".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Comments and the like, or the start of a tag with its name; every match ends where the search goes on.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag whose quotes hold no angle brackets: it reads no further than the next one.
PLAIN = re.compile(r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+>")
MARKS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def path_words(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    out = [tag]
    for name, *values in ATTRIBUTE.findall(attributes):
        out += [f".{w}" for w in WORD.findall("".join(values).lower())]
    return tuple(out)


class Node:
    """An open block-level element; blocks below it share it, so that a page's paths take no more room than its tags."""

    __slots__ = ("above", "words", "vector")

    def __init__(self, above: Node | None, words: tuple[str, ...]):
        self.above, self.words, self.vector = above, words, None

    def path(self) -> list[tuple[str, ...]]:
        """The words of all elements from the top down."""
        out, node = [], self
        while node is not None:
            out.append(node.words)
            node = node.above
        return out[::-1]


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


class Open:
    """The open elements. Where an element of a name stands is known by name, so that no end tag walks over the others."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[Node | None] = []  # of an inline element the node of what it stands in
        self.at: dict[str, list[int]] = {}  # places of each name
        self.block_at: list[int] = []  # places of block-level elements

    def push(self, name: str, words: tuple[str, ...]) -> None:
        above = self.nodes[-1] if self.nodes else None
        self.at.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.block_at.append(len(self.names))
            above = Node(above, words)
        self.names.append(name)
        self.nodes.append(above)

    def cut(self, place: int) -> None:
        """Close all from this place on."""
        while len(self.names) > place:
            name = self.names.pop()
            self.nodes.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.block_at.pop()

    def last(self, *names: str) -> int:
        """The last place of any of these names, -1 if none is open."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def last_block(self) -> int:
        return self.block_at[-1] if self.block_at else -1

    def node(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None


class TagEnds:
    """The end of a tag that is open at a given place, found for all places of a page in one backward pass.

    A quote that is never closed, or whose closing leaves the tag without an end, is read as a plain character."""

    def __init__(self, page: str):
        self.places = [m.start() for m in MARKS.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        closing: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            mark = page[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k] + 1
                continue
            quoted = self.ends[closing[mark] + 1] if mark in closing else -1
            self.ends[k] = quoted if quoted >= 0 else self.ends[k + 1]
            closing[mark] = k

    def of(self, place: int) -> int:
        """The place after the tag's end, -1 if it has none."""
        return self.ends[bisect_left(self.places, place)]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked = 0
    in_link = 0
    pos = at = 0  # what is read so far, and where the next token is looked for
    unread, depth = "", 0
    ends: TagEnds | None = None
    last_close: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.node(), text, min(linked, len(text))))
            parts, linked = [], 0

    def closed_after(tag: str, place: int) -> bool:
        if tag not in last_close:
            last_close[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_close[tag] >= place

    while m := TOKEN.search(page, at):
        tag, begin, end, rest = m[2], m.start(), m.end(), ""
        if tag:
            if plain := PLAIN.match(page, end):
                after = plain.end()
            else:
                ends = ends or TagEnds(page)
                after = ends.of(end)
            if after < 0:  # no tag: its text is read with what follows
                at = end
                continue
            rest, end, tag = page[end : after - 1], after, tag.lower()
        if not unread and begin > pos:
            parts.append(page[pos:begin])
            linked += (begin - pos) * bool(in_link)
        pos = at = end
        if not tag:
            continue
        empty = rest.rstrip().endswith("/")
        if unread:
            if tag == unread:
                depth += -1 if m[1] else not empty
            elif not m[1] and tag in CLOSES_P and not closed_after(unread, pos):
                depth = 0  # it is never closed
            if depth:
                continue
            unread = ""
            if m[1]:
                continue
        if m[1]:  # an end tag
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag not in INLINE:
                flush()
            k = stack.last(tag)
            if k > (stack.last_block() if tag in INLINE else -1):
                stack.cut(k)
            continue
        if stack.names and stack.names[-1] == "head" and tag not in HEAD:
            stack.cut(len(stack.names) - 1)  # its end tag may be left out
        if tag in RAW or tag in UNREAD:
            if tag in RAW and not empty:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = at = close.end() if close else len(page)
            elif not empty:
                unread, depth = tag, 1
            continue
        if tag in SPACE:
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and 0 <= stack.last("p") == stack.last_block():
                stack.cut(stack.last("p"))
            if tag in SAME and (k := stack.last(tag)) > stack.last(*SAME[tag]):
                stack.cut(k)
        if tag == "a":
            in_link = 1
        if tag not in VOID and not empty:
            stack.push(tag, path_words(tag, rest) if rest else (tag,))
    if not unread and pos < len(page):
        parts.append(page[pos:])
    flush()
    return out


class Hashed(dict):
    """Buckets of words, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        k = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        if len(self) < 100_000:
            self[word] = k
        return k


def bag(embedding: np.ndarray, numbers: list[np.ndarray], mean: bool) -> np.ndarray:
    """Sums or means of the embeddings of each list of numbers."""
    lengths = np.array([len(x) for x in numbers])
    out = np.zeros((len(numbers), embedding.shape[1]), np.float32)
    if lengths.sum():
        some = np.flatnonzero(lengths)
        flat = np.concatenate([numbers[i] for i in some])
        out[some] = np.add.reduceat(embedding[flat], np.append(0, lengths[some].cumsum()[:-1]), axis=0)
    return out / np.maximum(lengths, 1)[:, None].astype(np.float32) if mean else out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights: path and word embeddings, two LSTMs, an output layer."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.paths, self.words = Hashed(PATH_BUCKETS), Hashed(WORD_BUCKETS)

    @classmethod
    def load(cls, path: str | Path | None = None) -> Labeller:
        with np.load(path or Path(__file__).with_name("block_labeller.npz")) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def numbers(self, page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of each block the buckets of its path's and its text's words, and the extra inputs; for training."""
        path = [np.array([self.paths[w] for x in (b.node.path() if b.node else []) for w in x], np.int64) for b in page]
        return path, *self.own_numbers(page)

    def own_numbers(self, page: list[Block]) -> tuple[list[np.ndarray], np.ndarray]:
        word = []
        for b in page:
            words = b.text.lower().split()
            word.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        extra = np.array([[np.log1p(len(b.text)) / 8, b.linked / len(b.text), 1.0] for b in page], np.float32).reshape(len(page), EXTRA)
        return word, extra

    def path_vectors(self, page: list[Block]) -> np.ndarray:
        """The sum of the embeddings along each block's path; an element adds to the sum of what it stands in."""
        out = np.zeros((len(page), PATH_DIM), np.float32)
        embedding, paths = self.w["path"], self.paths
        for i, b in enumerate(page):
            node, todo = b.node, []
            while node is not None and node.vector is None:
                todo.append(node)
                node = node.above
            vector = out[i] if node is None else node.vector
            for x in reversed(todo):
                for w in x.words:
                    vector = vector + embedding[paths[w]]
                x.vector = vector
            out[i] = vector
        return out

    def inputs(self, path: list[np.ndarray], word: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        return np.concatenate([bag(self.w["path"], path, False), bag(self.w["word"], word, True), extra], 1)

    def hidden(self, ahead: np.ndarray, back: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """States (page, block, units of both directions) of both LSTMs over padded sequences (page, block, input).

        The two run in one loop: each gate has the units of one direction beside those of the other."""
        n, steps, _ = ahead.shape
        both = 2 * HIDDEN

        def beside(f: np.ndarray, b: np.ndarray) -> np.ndarray:
            parts = np.stack([f.reshape(*f.shape[:-1], 4, HIDDEN), b.reshape(*b.shape[:-1], 4, HIDDEN)], -2)
            parts[..., :3, :, :] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
            return parts.reshape(*f.shape[:-1], 4 * both)

        zero = np.zeros_like(self.w["h_f"])
        inner = np.concatenate([beside(self.w["h_f"], zero), beside(zero, self.w["h_b"])])
        h = np.zeros((n, both), np.float32)
        c = np.zeros((n, both), np.float32)
        out = np.zeros((n, steps, both), np.float32)
        padded = not mask.all()
        for start in range(0, steps, STRIDE):
            part = slice(start, start + STRIDE)
            gates = beside(ahead[:, part] @ self.w["x_f"] + self.w["b_f"], back[:, part] @ self.w["x_b"] + self.w["b_b"]).swapaxes(0, 1)
            for t, z in enumerate(np.ascontiguousarray(gates), start):
                z += h @ inner
                np.tanh(z, out=z)
                s = z[:, : 3 * both]
                s *= 0.5
                s += 0.5
                c *= z[:, :both]
                c += z[:, both : 2 * both] * z[:, 3 * both :]
                h = np.tanh(c)
                h *= z[:, 2 * both : 3 * both]
                if padded:
                    h *= mask[:, t, None]
                    c *= mask[:, t, None]
                out[:, t] = h
        return out

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probabilities of its blocks to be main text."""
        lengths = np.array([len(p) for p in pages])
        read = [b for p in pages for b in p]
        word, extra = self.own_numbers(read)
        x = np.concatenate([self.path_vectors(read), bag(self.w["word"], word, True), extra], 1)
        steps = int(lengths.max(initial=0))
        mask = np.arange(steps) < lengths[:, None]
        rows, cols = np.nonzero(mask)
        ahead = np.zeros((len(pages), steps, x.shape[1]), np.float32)
        ahead[rows, cols] = x
        back = np.zeros_like(ahead)
        turned = lengths[rows] - 1 - cols
        back[rows, turned] = x
        mask = mask.astype(np.float32)
        states = self.hidden(ahead, back, mask)
        both = np.concatenate([states[rows, cols, :HIDDEN], states[rows, turned, HIDDEN:]], 1)
        p = sigmoid(both @ self.w["out"] + x @ self.w["skip"] + self.w["bias"])
        return np.split(p, lengths.cumsum()[:-1])


def main_text(pages: list[str], labeller: Labeller) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    read = [blocks(p) if p else [] for p in pages]
    order = sorted((i for i in range(len(pages)) if read[i]), key=lambda i: len(read[i]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * len(read[order[end]]) <= BATCH_BLOCKS:
            end += 1
        some = order[start:end]
        for i, p in zip(some, labeller.scores([read[i] for i in some]), strict=True):
            out[i] = "\n".join(b.text for b, v in zip(read[i], p, strict=True) if v >= 0.5)
        start = end
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    weights = pages.sparkSession.sparkContext.broadcast(Labeller.load().w)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(weights.value)
        for batch in batches:
            pages, out = list(batch), []
            for at in range(0, len(pages), 250):
                out += main_text(pages[at : at + 250], labeller)
            yield pd.Series(out, dtype=object)

    return pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
