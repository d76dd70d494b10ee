"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in order: texts between the boundaries of block elements,
with the path of tags above them. Each leaf becomes a vector of its tag path, the class and id
words on it, hashed words of its text, and a few measures; a bidirectional LSTM in numpy reads
the vectors of the whole page both ways and labels every leaf as main text or not. The weights
come from ``htmltrain``, which makes and labels its own pages.

What no browser shows, and the choices and values of forms, is not read (``SILENT``); all else is
left to the labeller, whose training pages have paragraphs in ``noscript`` and ``object``, formulas
in sentences, and headers in articles as well as those of sites. ``noscript``, ``object`` and
``button`` are part of the sentence in a paragraph or heading, and blocks elsewhere.

Defined results: null html counts as empty and gives an empty text, as does a page without main
text; character references are decoded, white space in a block becomes one space, blocks are
trimmed and joined by a line feed, empty ones go; line-break elements are white space;
unclosed tags, comments and scripts run to where a browser would end them or to the end; a block
with a score of 0.5 is main text; very long pages are read and labelled whole, in time linear in
their length; rows that repeat are read each; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Elements whose text no browser shows, and the choices and values of forms.
SILENT = frozenset("script style template title iframe textarea select datalist".split())
#: Elements inside a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q ruby rt rp s samp small span strike strong sub sup svg time tt u var wbr".split())
#: Elements that are part of the sentence in one of ``SENTENCES``, and blocks elsewhere.
SOFT, SENTENCES = frozenset("noscript object button".split()), frozenset("p h1 h2 h3 h4 h5 h6".split())
#: All that is inside one of these is inline.
FOREIGN = frozenset(("math", "svg"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold the search for one to end.
HOLDS = frozenset("table ul ol dl div article section main body aside nav footer header blockquote".split())
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*>?)|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Tags with a place of their own in the path vector.
TAGS = tuple("html body article main section div p h1 h2 h3 h4 ul ol li dl dt dd nav aside header footer form fieldset table tr td th blockquote pre figure figcaption address menu details center hr noscript object button video".split())
PATH, NAMES, WORDS = len(TAGS) + 8, 96, 32
MEASURES = 10
SIZE = 2 * PATH + NAMES + WORDS + MEASURES
HIDDEN = 24
_TAG = {t: i for i, t in enumerate(TAGS)}


def _tag_place(tag: str) -> int:
    return _TAG.get(tag, len(TAGS) + zlib.crc32(tag.encode("utf-8", "replace")) % 8)


class Leaf:
    """A block of text: raw text, tags above it (outermost first), class words, linked characters."""

    __slots__ = ("linked", "names", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], names: tuple[str, ...], linked: int) -> None:
        self.text, self.path, self.names, self.linked = text, path, names, linked


def leaves(html: str | None) -> list[Leaf]:
    """The leaf blocks of a page that have text."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            block = [(t, n) for t, n in stack if t not in INLINE]
            out.append(Leaf(text, tuple(t for t, _ in block), tuple(w for _, n in block for w in n), linked))
        parts.clear()
        linked = 0

    foreign = sentences = 0  # how many of these are open

    def close(at: int) -> None:
        nonlocal links, foreign, sentences
        for t, _ in stack[at:]:
            links -= t == "a"
            foreign -= t in FOREIGN
            sentences -= t in SENTENCES
        del stack[at:]

    data, at = html or "", 0
    for m in iter(lambda: _TOKEN.match(data, at), None):
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":  # no comment or declaration
                parts.append(m[0])
                if links:
                    linked += len(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            sentence = tag in SOFT and sentences and place is not None and any(t in SENTENCES for t, _ in stack[:place])
            if not (tag in INLINE or sentence or foreign):
                flush()
            # an inline element does not end over a block that was opened in it
            if place is not None and (tag not in INLINE or tag in FOREIGN or all(t in INLINE for t, _ in stack[place:])):
                close(place)
            continue
        if tag in SILENT:
            # all to the end tag is not text; without one, to the end of the page
            if tag in ("script", "style", "title", "textarea", "iframe", "template"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(data, at)
                at = end.end() if end else len(data)
            elif not m[3].rstrip(">").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(data, at)
                at = end.end() if end else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if not (tag in INLINE or foreign or (tag in SOFT and sentences)):
            flush()
            group = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in group:
                    close(i)
                    break
                if stack[i][0] in HOLDS:
                    break
        if tag not in VOID:
            names = tuple(w for x in _NAMES.findall(m[3]) for w in _WORDS.findall(x.lower())) if m[3] != ">" else ()
            if not (foreign and m[3].endswith("/>")):  # there an element can end itself
                stack.append((tag, names))
                links += tag == "a"
                foreign += tag in FOREIGN
                sentences += tag in SENTENCES
    flush()
    return out


@lru_cache(maxsize=100_000)
def _word_place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORDS


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...], names: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(2 * PATH + NAMES, np.float32)
    for tag in path:
        out[_tag_place(tag)] = 1
    if path:
        out[PATH + _tag_place(path[-1])] = 1
    for name in names:
        out[2 * PATH + zlib.crc32(name.encode()) % NAMES] = 1
    return out


def vectors(page: list[Leaf]) -> np.ndarray:
    """A row per leaf."""
    out = np.zeros((len(page), SIZE), np.float32)
    first = 2 * PATH + NAMES
    for i, leaf in enumerate(page):
        out[i, :first] = _path_vector(leaf.path, leaf.names)
        words = leaf.text.lower().split()
        n = len(words)
        out[i, first : first + WORDS] = np.bincount([_word_place(w) for w in words], minlength=WORDS) / n
        text = leaf.text
        out[i, first + WORDS :] = (
            min(len(text), 2000) ** 0.5 / 20, np.log1p(n) / 5, min(1.0, leaf.linked / len(text)), text[-1] in ".!?:;\"'»”", sum(map(text.count, ".,")) / n,
            "©" in text or "copyright" in words, "|" in text, len(leaf.path) / 10, i / len(page), len(page) / (len(page) + 20),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """A bidirectional LSTM with one output per step.

    ``w[d]`` (SIZE + HIDDEN + 1, 4 HIDDEN) of direction d holds input, recurrent and bias rows for
    the input, forget and output gates and the candidate; ``v`` (2 HIDDEN + 1) is the output.
    """

    def __init__(self, w: np.ndarray, v: np.ndarray) -> None:
        self.w, self.v = w.astype(np.float32), v.astype(np.float32)

    @classmethod
    def trained(cls) -> Labeller:
        with np.load(str(files(__package__) / "html_lstm.npz")) as f:
            return cls(f["w"], f["v"])

    def states(self, x: np.ndarray, d: int) -> np.ndarray:
        """Hidden states of direction d over x (steps, pages, SIZE), steps already in its order."""
        w, n = self.w[d], x.shape[2]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        drive = x @ w[:n] + w[-1]
        for t in range(len(x)):
            a = drive[t] + h @ w[n:-1]
            gate = _sigmoid(a[:, : 3 * HIDDEN])
            c = gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * np.tanh(a[:, 3 * HIDDEN :])
            h = gate[:, 2 * HIDDEN :] * np.tanh(c)
            out[t] = h
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each leaf of each page; pages are not empty."""
        sizes = np.array([len(p) for p in pages])
        x = np.zeros((sizes.max(), len(pages), SIZE), np.float32)
        back = np.zeros_like(x)
        for k, p in enumerate(pages):
            x[: len(p), k], back[: len(p), k] = p, p[::-1]
        one, two = self.states(x, 0), self.states(back, 1)
        out = []
        for k, n in enumerate(sizes):
            both = np.concatenate([one[:n, k], two[:n, k][::-1]], axis=1)
            out.append(_sigmoid(both @ self.v[:-1] + self.v[-1]))
        return out


@lru_cache(maxsize=1)
def _labeller() -> Labeller:
    return Labeller.trained()


#: Leaves that are labelled at once, pages padded to the longest.
STEPS = 20_000


def main_texts(pages: list[str | None], model: Labeller | None = None) -> list[str]:
    """The main text of each page."""
    model = model or _labeller()
    read = [leaves(p) for p in pages]
    out = [""] * len(pages)
    todo = sorted((i for i, x in enumerate(read) if x), key=lambda i: len(read[i]))
    while todo:
        some = [todo.pop()]
        most = len(read[some[0]])
        while todo and (len(some) + 1) * most <= STEPS and len(read[todo[-1]]) * 2 >= most:
            some.append(todo.pop())
        for i, score in zip(some, model.scores([vectors(read[i]) for i in some])):
            out[i] = "\n".join(leaf.text for leaf, s in zip(read[i], score) if s >= 0.5)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
