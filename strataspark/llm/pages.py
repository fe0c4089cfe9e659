"""HTML extraction: a recurrent labeller of a page's leaf blocks.

A page is read once, tags in order, into leaf blocks: text between block-level boundaries, with
the path of tags, classes and ids above it.  Hashed path tokens, hashed words and a few figures
make a block's vector.  A bidirectional LSTM in numpy reads a page's vectors in order and labels
every block as main text or not, knowing the whole page.

Nobody labels the pages.  A teacher that knows what common tags and class names mean labels a
bounded sample, with further blocks of many kinds (menus, notices, comments, forms) put in between;
the labeller learns from these.

Character references are decoded, white space inside a block becomes one space, blocks of main
text are joined by two line ends.  Null and empty pages, and pages without main text, give an
empty text.  Rows that repeat are read each.
"""

from __future__ import annotations

import html
import re
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 400  # pages to learn from, at most
MAX_BLOCKS = 150  # pages with more blocks teach nothing (they are still read whole)
MAX_CHARS = 60_000  # nor do pages with more characters
PATHS, WORDS, FIGURES = 256, 32, 8
INPUTS = PATHS + WORDS + FIGURES
HIDDEN = 16
EPOCHS = 6
BATCH = 32

# Tags that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
# Elements without markup or text of the page inside.
RAW = frozenset("script style textarea title template noscript iframe svg math canvas".split())
# Of these, the ones that a slash before the tag's end closes at once.
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base col embed hr input link meta param track source img br wbr".split())
# An opening tag ends an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Names of parts that are not main text, and of parts that are.
SIDE = frozenset(
    "nav menu navbar header masthead footer aside sidebar ad ads advert adverts advertisement "
    "sponsor sponsored promo banner cookie cookies consent notice notices alert newsletter "
    "subscribe signup share social related recommended comments comment reply replies discussion "
    "disqus form button select breadcrumb breadcrumbs pagination pager copyright widget popup "
    "modal overlay toolbar search login tags meta byline fieldset legend navigation".split()
)
MAIN = frozenset("article main content post entry story".split())

_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# To a tag's end.  A quote opens where a value begins and nowhere else; one that is never closed opens
# nothing.  The group is a slash before the end that is not part of a value.
_TAG = re.compile(r"""(?:[^>=/]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|(/)(?=>)|/)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]  # per element: tag, then its name tokens
    text: str
    linked: int  # characters inside links


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """Where the tag at ``at`` ends (-1 if nowhere): the first ``>`` outside quoted values.

    And whether it closes itself.
    """
    tag = _TAG.match(page, at)
    return (tag.end() - 1, tag[1] is not None) if tag else (-1, False)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked = links = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text = html.unescape(page[at:start])
            parts.append(text)
            linked += len(text) if links else 0
        if start == size:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        following = page[start + 1 : start + 2]
        closing = following == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if following in ("!", "?", "/"):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                parts.append("<")
                at = start + 1
            continue
        end, alone = _tag_end(page, start)
        if end < 0:
            break
        tag, at = name[0].lower(), end + 1
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if alone and tag in FOREIGN:
            continue
        if tag in RAW:
            shut = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            end = page.find(">", shut.start()) if shut else -1
            at = size if end < 0 else end + 1
            continue
        if tag in VOID:
            continue
        links = 0
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "p":
                del stack[i:]  # no block-level element lies in a paragraph
                break
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            stack.pop()
        names = [tag]
        attributes = page[name.end() : end]
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                names += _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())
        stack.append(tuple(names))
    flush()
    return found


def path_inputs(path: tuple[tuple[str, ...], ...]) -> list[int]:
    """Places of a path's tokens: tags, names, and both of the innermost element."""
    tokens = {name if i == 0 else f".{name}" for names in path for i, name in enumerate(names)}
    tokens |= {f">{name}" for name in path[-1]} if path else {">"}
    return sorted({zlib.crc32(t.encode()) % PATHS for t in tokens})


def vector(block: Block, place: float, known: dict[tuple, list[int]]) -> np.ndarray:
    """A block's input vector; ``place`` is its share of the way through the page."""
    out = np.zeros(INPUTS)
    at = known.get(block.path)
    if at is None:
        at = known[block.path] = path_inputs(block.path)
    out[at] = 1.0
    words = block.text.lower().encode("utf-8", "replace").split(b" ")
    n, size = len(words), len(block.text)
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, n) % WORDS
    out[PATHS : PATHS + WORDS] = np.bincount(hashed, minlength=WORDS) / n
    stops = block.text.count(".") + block.text.count(",")
    out[PATHS + WORDS :] = (
        1.0,
        min(np.log1p(size) / 8, 1.5),
        min(block.linked / size, 1.0),
        min(stops / n, 1.0),
        place,
        1.0 if block.text[-1] in ".!?\"'" else 0.0,
        min(len(block.path) / 8, 1.5),
        1.0 if n < 5 else 0.0,
    )
    return out


def vectors(page: Sequence[Block]) -> np.ndarray:
    n, known = max(len(page) - 1, 1), {}
    return np.array([vector(b, i / n, known) for i, b in enumerate(page)]).reshape(-1, INPUTS)


def teach(page: Sequence[Block]) -> list[int]:
    """What the teacher says of each block."""
    has_main = any(names[0] in ("article", "main") for b in page for names in b.path)
    labels = []
    for b in page:
        inside = False
        side = False
        for names in b.path:
            if MAIN & set(names):
                inside = True
            bad = SIDE & set(names)
            # An article's own header belongs to it.
            if bad and not (inside and bad == {"header"}):
                side = True
        good = inside if has_main or inside else b.path and b.path[-1][0] == "p" and len(b.text) > 80
        labels.append(int(bool(good) and not side))
    return labels


_SIDE_PATHS = (
    (("nav",), ("ul",), ("li",)), (("header",), ("h1",)), (("header", "masthead"), ("p",)),
    (("footer",), ("p",)), (("footer",),), (("aside",), ("p",)), (("aside",), ("ul",), ("li",)),
    (("div", "sidebar"), ("p",)), (("div", "ad"),), (("div", "ads"), ("p",)),
    (("div", "advertisement"), ("p",)), (("div", "banner"),), (("div", "cookie", "notice"), ("p",)),
    (("div", "notice"), ("p",)), (("div", "newsletter"), ("form",), ("p",)), (("form",), ("label",)),
    (("form",),), (("form",), ("button",)), (("section", "comments"), ("p",)),
    (("div", "comments"), ("div", "comment"), ("p",)), (("ul", "comments"), ("li", "comment")),
    (("div", "comment"), ("p",)), (("div", "related"), ("ul",), ("li",)), (("div", "share"),),
    (("div", "promo"), ("h3",)), (("div", "menu"), ("a",)), (("section", "related"), ("h2",)),
    (("div", "popup"), ("p",)), (("ol", "breadcrumb"), ("li",)), (("div", "social"), ("span",)),
    (("select",), ("option",)), (("div", "alert"), ("p",)), (("div", "consent"),),
)
_MAIN_TOPS = (
    (("article",),), (("main",),), (("main",), ("article",)), (("div", "content"),),
    (("div", "post"),), (("div", "entry", "content"),), (("article", "post"),),
    (("main", "main"), ("div", "content")), (("div",), ("article",)), (("section",), ("article",)),
    (("div", "story", "body"),), (("div", "article", "body"),), (("section", "story"),),
    (("div", "post", "content"),), (("div", "entry"),), (("td", "content"),),
)
# Names that say nothing of what they hold; a part of them is told by its text.
_PLAIN = ("text", "body", "inner", "col", "row", "box", "wrap", "block", "copy", "left", "x", "module", "page")
_MAIN_LEAVES = (
    (("p",),), (("p",),), (("p",),), (("p",),), (("h1",),), (("h2",),), (("h3",),), (("ul",), ("li",)),
    (("blockquote",), ("p",)), (("pre",),), (("table",), ("tr",), ("td",)), (("section",), ("p",)),
    (("div",), ("p",)), (("header",), ("h1",)), (("ol",), ("li",)), (("figure",), ("figcaption",)),
    (("h4",),), (("h5",),), (("h6",),), (("dl",), ("dt",)), (("dl",), ("dd",)), (("address",),),
    (("details",), ("summary",)), (("details",), ("p",)), (("table",), ("tr",), ("th",)),
    (("table",), ("caption",)), (("blockquote",),), (("div",),), (("section",), ("h4",)),
)
_WRAPPERS = ((), (), (("div", "wrapper"),), (("div", "container"),), (("div", "page"),))


def varied(
    page: Sequence[Block], labels: Sequence[int], texts: Sequence[str], rng: np.random.Generator
) -> tuple[list[Block], list[int]]:
    """A page with its main part under other names and side blocks put in between."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    root: tuple[tuple[str, ...], ...] = (("html",), ("body",), *pick(_WRAPPERS))
    plain = rng.random() < 0.2
    top = root + ((("div", pick(_PLAIN), pick(_PLAIN)),) if plain else pick(_MAIN_TOPS))
    out, marks = [], []

    def side(inside: bool) -> None:
        path = (top if inside and rng.random() < 0.5 else root) + pick(_SIDE_PATHS)
        for _ in range(int(rng.integers(1, 4))):
            text = pick(texts)
            if rng.random() < 0.5:
                text = " ".join(text.split(" ")[: int(rng.integers(1, 12))])
            linked = len(text) if path[-1][0] in ("li", "a") and rng.random() < 0.7 else 0
            out.append(Block(path, text, linked))
            marks.append(0)

    for _ in range(int(rng.integers(0, 4))):
        side(False)
    for b, label in zip(page, labels, strict=True):
        if label:
            leaf = pick(_MAIN_LEAVES) if rng.random() < 0.6 else b.path[-1:]
            out.append(Block(top + leaf, b.text, b.linked))
            marks.append(1)
            if rng.random() < 0.08:
                side(True)
        elif rng.random() < 0.6:
            out.append(b)
            marks.append(0)
    for _ in range(int(rng.integers(0, 4))):
        side(True)
    return out, marks


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two LSTMs (forward, backward) and a logistic output over both states."""

    wx: np.ndarray  # 2 x inputs x 4 hidden: gates input, forget, output, candidate
    wh: np.ndarray  # 2 x hidden x 4 hidden
    b: np.ndarray  # 2 x 4 hidden
    wo: np.ndarray  # 2 hidden
    bo: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        b = np.zeros((2, 4 * HIDDEN))
        b[:, HIDDEN : 2 * HIDDEN] = 1.0
        return cls(
            rng.normal(0, 0.15, (2, INPUTS, 4 * HIDDEN)),
            rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)),
            b,
            rng.normal(0, 0.3, 2 * HIDDEN),
            np.zeros(1),
        )

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple:
        """Logits of rows ``x`` of pages of ``sizes`` blocks, and what training needs.

        Pages run side by side, longest first, so that those still running are a prefix.
        """
        order = np.argsort(-sizes, kind="stable")
        starts = np.r_[0, np.cumsum(sizes)[:-1]][order] if len(sizes) else sizes
        left = sizes[order]
        longest = int(left[0]) if len(left) else 0
        states = np.zeros((2, len(x), HIDDEN))
        trace: list[list] = [[], []]
        for way in (0, 1):
            fed = x @ self.wx[way] + self.b[way]
            h = np.zeros((len(sizes), HIDDEN))
            c = np.zeros((len(sizes), HIDDEN))
            for t in range(longest):
                n = int(np.searchsorted(-left, -t, side="left"))
                here = starts[:n] + (t if way == 0 else left[:n] - 1 - t)
                z = fed[here] + h[:n] @ self.wh[way]
                gates = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                c_before, h_before = c[:n], h[:n]
                c_now = f * c_before + i * g
                squashed = np.tanh(c_now)
                h_now = o * squashed
                if keep:
                    trace[way].append((here, i, f, o, g, c_before, squashed, h_before))
                # Pages that have ended keep nothing of use: their rows are no longer read.
                c, h = c_now, h_now
                states[way, here] = h_now
        logits = states[0] @ self.wo[:HIDDEN] + states[1] @ self.wo[HIDDEN:] + self.bo
        return logits, states, trace

    def slopes(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy, back through both directions."""
        logits, states, trace = self.run(x, sizes, keep=True)
        d = (_sigmoid(logits) - y) / len(y)
        out = {k: np.zeros_like(getattr(self, k)) for k in ("wx", "wh", "b", "wo", "bo")}
        out["wo"] = np.concatenate([states[0].T @ d, states[1].T @ d])
        out["bo"][0] = d.sum()
        for way in (0, 1):
            dstate = d[:, None] * self.wo[way * HIDDEN : (way + 1) * HIDDEN]
            dh = np.zeros((0, HIDDEN))
            dc = np.zeros((0, HIDDEN))
            dz_all = np.zeros((len(x), 4 * HIDDEN))
            for here, i, f, o, g, c_before, squashed, h_before in reversed(trace[way]):
                n = len(here)
                more = n - len(dh)
                dh = np.vstack([dh, np.zeros((more, HIDDEN))]) + dstate[here]
                dc = np.vstack([dc, np.zeros((more, HIDDEN))]) + dh * o * (1 - squashed**2)
                dz = np.hstack(
                    [
                        dc * g * i * (1 - i),
                        dc * c_before * f * (1 - f),
                        dh * squashed * o * (1 - o),
                        dc * i * (1 - g**2),
                    ]
                )
                dz_all[here] = dz
                out["wh"][way] += h_before.T @ dz
                dh = dz @ self.wh[way].T
                dc = dc * f
            out["wx"][way] = x.T @ dz_all
            out["b"][way] = dz_all.sum(axis=0)
        return out

    def texts(self, pages: Sequence[str]) -> pd.DataFrame:
        """Main text of every page."""
        found = [blocks(p) for p in pages]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        out = []
        if sizes.sum():
            x = np.vstack([vectors(f) for f in found if f])
            main = self.run(x, sizes)[0] > 0
        else:
            main = np.zeros(0, dtype=bool)
        at = 0
        for f in found:
            own = main[at : at + len(f)].tolist()
            out.append("\n\n".join(b.text for b, m in zip(f, own, strict=True) if m))
            at += len(f)
        return pd.DataFrame({"text": out, "n_blocks": sizes})


def fit(pages: Sequence[str], seed: int = 1) -> Labeller:
    """A labeller that learned from the teacher on these pages and variants of them."""
    rng = np.random.default_rng(seed)
    model = Labeller.new(seed)
    known = [(p, teach(p)) for p in map(blocks, pages) if 0 < len(p) <= MAX_BLOCKS]
    texts = [b.text for p, _ in known for b in p] or ["text"]
    if not known:
        known = [([Block((("article",), ("p",)), "text", 0)], [1])]
    names = ("wx", "wh", "b", "wo", "bo")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    step, steps = 0, EPOCHS * max(1, -(-len(known) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(known))
        for at in range(0, len(order), BATCH):
            xs, ys, sizes = [], [], []
            for k in order[at : at + BATCH]:
                page, labels = known[k]
                if rng.random() < 0.7:
                    page, labels = varied(page, labels, texts, rng)
                if page:
                    xs.append(vectors(page))
                    ys += labels
                    sizes.append(len(page))
            if not xs:
                continue
            step += 1
            found = model.slopes(np.vstack(xs), np.array(sizes), np.array(ys, dtype=float))
            for k in names:
                g = np.clip(found[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                pace = 0.02 * (1 - 0.9 * min(step / steps, 1.0))
                setattr(model, k, getattr(model, k) - pace * move)
    return model


def learn(pages: DataFrame, max_rows: int = SAMPLE, max_chars: int = MAX_CHARS) -> Labeller:
    """A labeller from at most ``max_rows`` different pages, those of the least hash of their text.

    Pages of over ``max_chars`` characters or ``MAX_BLOCKS`` blocks teach nothing.  Only hashes below a
    bound, which the number of pages sets at about twice as many as are wanted, go on from a task.
    """
    usable = pages.where(F.length("html").between(1, max_chars))
    hashed = usable.select("html", F.xxhash64("html").alias("_h"))
    share = min(1.0, 2 * max_rows / max(usable.count(), 1))
    bound = int(-(2**63) + share * (2**64 - 1))
    few = hashed.where(F.col("_h") <= F.lit(min(bound, 2**63 - 1)))
    sample = few.groupBy("_h").agg(F.min("html").alias("html")).orderBy("_h").limit(max_rows)
    return fit([r["html"] for r in sample.collect()])


def extract(pages: DataFrame, model: Labeller, source: str = "html", to: str = "main") -> DataFrame:
    """``pages`` with a struct ``to`` of ``text`` and ``n_blocks``; whole pages."""

    @F.pandas_udf("text string, n_blocks long")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            every = part.tolist()
            done = [model.texts(every[i : i + 256]) for i in range(0, len(every), 256)]
            yield pd.concat(done, ignore_index=True) if done else model.texts([])

    whole = F.coalesce(F.col(source), F.lit(""))
    return pages.withColumn(to, extracted.asNondeterministic()(whole))
