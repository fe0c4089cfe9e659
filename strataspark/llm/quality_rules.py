"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text go through a few hard rules and a boosted ensemble of small trees.
The trees are flattened into numpy arrays of nodes, so that a batch of rows descends all trees
together.  Chosen statistics (shares of symbols, repeated lines, repeated words, shouts) have
monotonic constraints: more of them never raises the score.

Null and empty texts have no words and fail the hard rules.  Rows that repeat are scored each.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import labelled_sample
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ROWS = 8000  # labelled rows to learn from, at most
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 64
LEAST = 20.0  # sum of second derivatives a leaf needs, times four
RIDGE = 1.0
WINDOW = 5

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_shouts", "n_upper", "n_lower", "n_digits", "n_distinct", "n_again",
)
#: Features of the trees; -1 marks those that must never raise the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1,
    "shouts": -1, "upper": 0, "digits": 0, "distinct": 0, "again": -1, "words_a_line": 0,
}
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def repeated_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array([i for i, w in enumerate(windows) if often[w] > 1])
    edges[at] += 1
    np.subtract.at(edges, at + width, 1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """The ``STATISTICS`` of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(raw)

    def count(of: bytes) -> int:
        return n - len(raw.translate(None, of))

    seen: set[bytes] = set()
    lines = again = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            again += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - count(b" \t\n\x0b\x0c\r"),
        count(b"#*$%&|<>"),
        again,
        repeated_words(words),
        lines,
        raw.count(b"!"),
        count(_UPPER),
        count(_LOWER),
        count(_DIGITS),
        len(set(words)),
        sum(map(eq, words, words[1:])),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per row of ``STATISTICS``."""
    s = dict(zip(STATISTICS, np.asarray(stats, dtype=float).reshape(-1, len(STATISTICS)).T))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / chars,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_repeat_words"] / words,
            s["n_shouts"] / chars,
            s["n_upper"] / (s["n_upper"] + s["n_lower"] + 1),
            s["n_digits"] / chars,
            s["n_distinct"] / words,
            s["n_again"] / words,
            s["n_words"] / np.maximum(s["n_lines"], 1),
        ]
    )


@dataclass
class Trees:
    """Flattened nodes of all trees; a leaf points to itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(below, self.low[at], self.high[at])
        z = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, signs: Sequence[int] = tuple(FEATURES.values())) -> Trees:
    """Boosting with logistic loss over binned features, by histograms of derivatives.

    A constrained feature splits only if the two leaf values keep its order; their middle then
    bounds both subtrees.
    """
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []  # feature, threshold, low, high, value
    roots: list[int] = []
    cuts, binned = [], np.zeros(x.shape, dtype=np.int64)
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else []
        cuts.append(np.asarray(edges))
        binned[:, f] = np.searchsorted(cuts[f], x[:, f], side="left")
    z = np.full(len(y), start)

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lo: float, hi: float):
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(gs / (hs + RIDGE), lo, hi))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if depth:
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                b, size = binned[rows, f], len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                gr, hr = gs - gl, hs - hl
                vl = np.clip(gl / (hl + RIDGE), lo, hi)
                vr = np.clip(gr / (hr + RIDGE), lo, hi)
                gain = gl * vl - (hl + RIDGE) * vl**2 / 2 + gr * vr - (hr + RIDGE) * vr**2 / 2
                gain -= gs * own - (hs + RIDGE) * own**2 / 2
                allowed = (hl >= LEAST / 4) & (hr >= LEAST / 4)
                if signs[f]:
                    allowed &= signs[f] * (vr - vl) >= 0
                gain = np.where(allowed, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        gain, f, k, vl, vr = best
        if f < 0:
            z[rows] += RATE * own
            return leaf(RATE * own)
        here = leaf(0.0)
        left = binned[rows, f] <= k
        middle = (vl + vr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi))}
        bounds[-1] = ((middle, hi), (lo, middle))
        (l1, h1), (l2, h2) = bounds[signs[f]]
        a = grow(rows[left], g, h, depth - 1, l1, h1)
        b = grow(rows[~left], g, h, depth - 1, l2, h2)
        nodes[here] = [f, float(cuts[f][k]), a, b, 0.0]
        return here

    everything = np.arange(len(y))
    for _ in range(TREES if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(everything, y - p, p * (1 - p), DEPTH, -4.0, 4.0))
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    whole = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(
        start, np.array(roots, dtype=np.int64), whole[:, 0], table[:, 1],
        whole[:, 1], whole[:, 2], table[:, 4], DEPTH,
    )


_STAT_COLUMNS = ", ".join(f"{s} long" for s in STATISTICS)


def with_statistics(docs: DataFrame, text: str = "text", to: str = "statistics") -> DataFrame:
    """``docs`` with a struct of ``STATISTICS`` of every whole text."""

    @F.pandas_udf(_STAT_COLUMNS)
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([statistics(t) for t in part], columns=list(STATISTICS))

    return docs.withColumn(to, measured.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from the statistics of at most ``max_rows`` labelled rows; texts stay in Spark.

    Held-out rows (crc32 of the id modulo 4 is 2) are never looked at.
    """
    sample = cut_lineage(
        with_statistics(labelled_sample(docs, labels, "quality", max_rows)).select(
            "doc_id", "label", "statistics.*"
        )
    )
    rows = sample.orderBy("doc_id", *STATISTICS).toPandas()
    return fit(features(rows[list(STATISTICS)].to_numpy()), rows["label"].to_numpy(float))


def judge(docs: DataFrame, trees: Trees, text: str = "text", to: str = "rules") -> DataFrame:
    """``docs`` with a struct ``to``: statistics, ``score``, ``base_failed``, ``kept``."""

    @F.pandas_udf(_STAT_COLUMNS + ", score double, base_failed boolean, kept boolean")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            stats = np.array([statistics(t) for t in part], dtype=np.int64)
            out = pd.DataFrame(stats.reshape(-1, len(STATISTICS)), columns=list(STATISTICS))
            out["score"] = trees.scores(features(stats))
            out["base_failed"] = (out["n_words"] < 10) | (
                100 * out["n_repeat_words"] > 20 * out["n_words"]
            )
            out["kept"] = ~out["base_failed"] & (out["score"] >= 0.5)
            yield out

    return docs.withColumn(to, judged.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
