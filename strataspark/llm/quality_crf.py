"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is labelled bad or good.  A line's own features and those of the lines
before and after it give its state scores; a 2 x 2 matrix scores neighbouring labels.  Forward
and backward sums give each line's marginal; marginals weighted by line length, with the worst
stretch of the text, go through a logistic curve to a document's score (1: good).

Lines learn from the label of their document.  Texts without a line with a word (null, empty,
blank) get the score of the share of good rows among the sample of such texts, or 0.  Rows that
repeat are scored each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import labelled_sample
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ROWS = 4000  # labelled documents to learn from, at most
MAX_LINES = 200  # documents with more lines teach nothing (they are still scored whole)
STEPS = 150
RIDGE = 1e-3

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_FEATURES = 11  # of one line


def line_features(text: str) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and byte lengths of a text's lines that hold a word."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in text.encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        symbols = size - len(line.translate(None, _SYMBOLS))
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        digits = size - len(line.translate(None, _DIGITS))
        shouts = line.count(b"!")
        again = sum(map(eq, words, words[1:]))
        rows.append(
            (
                min(symbols / size * 4, 1.0),
                min(shouts / size * 4, 1.0),
                upper / (upper + lower + 1),
                digits / size,
                again / n,
                1.0 - len(set(words)) / n if n > 4 else 0.0,
                1.0 if line in seen else 0.0,
                1.0 if n < 4 else 0.0,
                min(n / 100, 1.0),
                min(abs(size / n - 6.0) / 10, 1.0),
                1.0 if symbols else 0.0,
            )
        )
        sizes.append(size)
        seen.add(line)
    return rows, sizes


@dataclass
class Lines:
    """Lines of many texts, one after another."""

    inputs: np.ndarray  # features of a line, of the one before, of the one after, constant
    sizes: np.ndarray
    starts: np.ndarray  # first line of each text, and the end

    @classmethod
    def of(cls, texts: Sequence[str]) -> Lines:
        rows: list[tuple[float, ...]] = []
        sizes: list[int] = []
        starts = [0]
        for text in texts:
            more, lengths = line_features(text)
            rows += more
            sizes += lengths
            starts.append(len(rows))
        own = np.array(rows, dtype=float).reshape(-1, _FEATURES)
        first = np.zeros(len(own) + 1, dtype=bool)
        first[np.array(starts)] = True
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:] = own[:-1]
        before[first[:-1]] = 0
        after[:-1] = own[1:]
        after[first[1:]] = 0
        inputs = np.hstack([own, before, after, np.ones((len(own), 1))])
        return cls(inputs, np.array(sizes, dtype=float), np.array(starts))


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(
    states: np.ndarray, steps: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the logarithms of P(label), per text the partition sum, and expected transitions.

    ``states`` has a column per label, ``steps[i, j]`` scores label j after label i.  Chains run
    side by side, longest first, so that the chains still running are a prefix.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[:-1][order], sizes[order]
    longest = int(left[0]) if len(left) else 0
    active = [int(np.searchsorted(-left, -t, side="left")) for t in range(longest)]
    forward, backward = states.copy(), np.zeros_like(states)
    for t in range(1, longest):
        here = at[: active[t]] + t
        last = forward[here - 1]
        for j in (0, 1):
            forward[here, j] += _log_add(last[:, 0] + steps[0, j], last[:, 1] + steps[1, j])
    for t in range(longest - 2, -1, -1):
        here = at[: active[t + 1]] + t
        ahead = backward[here + 1] + states[here + 1]
        for i in (0, 1):
            backward[here, i] = _log_add(ahead[:, 0] + steps[i, 0], ahead[:, 1] + steps[i, 1])
    joint = forward + backward
    total = _log_add(joint[:, 0], joint[:, 1])
    expected = np.zeros((2, 2))
    inner = np.ones(len(states), dtype=bool)
    inner[starts[:-1][sizes > 0]] = False
    here = np.flatnonzero(inner)
    for i in (0, 1):
        for j in (0, 1):
            arc = forward[here - 1, i] + steps[i, j] + states[here, j] + backward[here, j]
            expected[i, j] = np.exp(arc - total[here]).sum()
    whole = total[starts[:-1][sizes > 0]]
    return joint - total[:, None], whole, expected


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * _FEATURES + 1))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0, 0.0]))
    blank: float = 0.0

    def line_marginals(self, lines: Lines) -> np.ndarray:
        """P(good) of every line."""
        states = np.zeros((len(lines.inputs), 2))
        states[:, 1] = lines.inputs @ self.weights
        return np.exp(marginals(states, self.steps, lines.starts)[0][:, 1])

    def inputs(self, lines: Lines) -> np.ndarray:
        """What the curve sees of each text with lines; rows of blank texts are zero."""
        good, sizes = self.line_marginals(lines), np.diff(lines.starts)
        out = np.zeros((len(sizes), 4))
        some = np.flatnonzero(sizes)
        if len(some):
            at = lines.starts[:-1][some]
            weight = np.add.reduceat(lines.sizes, at)
            mean = np.add.reduceat(good * lines.sizes, at) / weight
            bad = np.add.reduceat((good < 0.5) * lines.sizes, at) / weight
            mean = np.clip(mean, 1e-3, 1 - 1e-3)
            out[some] = np.column_stack(
                [np.ones(len(some)), np.log(mean / (1 - mean)), bad, np.minimum.reduceat(good, at)]
            )
        return out

    def scores(self, texts: Sequence[str]) -> pd.DataFrame:
        lines = Lines.of(texts)
        x = self.inputs(lines)
        score = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
        n = np.diff(lines.starts)
        return pd.DataFrame({"score": np.where(n > 0, score, self.blank), "n_lines": n})

    def line_labels(self, text: str) -> list[bool]:
        """Whether each line with a word is good."""
        return (self.line_marginals(Lines.of([text])) >= 0.5).tolist()


def fit(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """Conditional likelihood by gradient steps, then the curve by Newton's method."""
    model, wanted = Model(), np.asarray(labels, dtype=float)
    lines = Lines.of(texts)
    sizes = np.diff(lines.starts)
    blank = wanted[sizes == 0]
    model.blank = float(blank.mean()) if len(blank) else 0.0
    if len(set(wanted[sizes > 0])) < 2:
        model.curve[0] = 3.0 if len(wanted) and wanted.mean() >= 0.5 else -3.0
        return model
    truth = np.repeat(wanted, sizes)
    pairs = np.maximum(sizes - 1, 0)
    seen = np.array([[pairs[wanted == 0].sum(), 0.0], [0.0, pairs[wanted == 1].sum()]])
    n = len(truth)
    theta = np.zeros(3 * _FEATURES + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        states = np.zeros((n, 2))
        states[:, 1] = lines.inputs @ theta[:-4]
        steps = theta[-4:].reshape(2, 2)
        found, _, expected = marginals(states, steps, lines.starts)
        slope = np.concatenate(
            [lines.inputs.T @ (truth - np.exp(found[:, 1])), (seen - expected).ravel()]
        ) / n - RIDGE * np.r_[theta[:-4], 10 * theta[-4:]]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        rate = 0.15 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta = theta + rate
    model.weights, model.steps = theta[:-4], theta[-4:].reshape(2, 2)
    x, y = model.inputs(lines)[sizes > 0], wanted[sizes > 0]
    curve, ridge = np.zeros(4), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, x.T @ (p - y) + ridge @ curve)
        curve = curve - step
        if np.abs(step).max() < 1e-6:
            break
    model.curve = curve
    return model


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from at most ``max_rows`` labelled documents of at most ``MAX_LINES`` lines.

    Held-out rows (crc32 of the id modulo 4 is 2) are never looked at.
    """
    sample = labelled_sample(docs, labels, "quality", max_rows)
    short = F.length("text") - F.length(F.replace("text", F.lit("\n"))) < MAX_LINES
    stored = cut_lineage(sample.where(short & (F.length("text") < 100_000)).orderBy("doc_id"))
    rows = stored.select("text", "label").toPandas()
    return fit(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "quality") -> DataFrame:
    """``docs`` with a struct ``to`` of ``score`` (0 to 1) and ``n_lines``; whole texts."""

    @F.pandas_udf("score double, n_lines long")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield model.scores(part.tolist())

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(to, scored.asNondeterministic()(whole))
