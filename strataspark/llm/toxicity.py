"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are lower-cased and folded: homoglyphs of other scripts become Latin letters, digits and
signs that stand for letters inside a word become those letters, everything else that is no
letter becomes a blank.  An entry is a whole word or the beginning of a word; an exception phrase
that contains a hit takes it back.  The weighted hits, as such and per hundred words, go through
a logistic curve.

Entries come from a short list and from labelled rows: words and word beginnings that are far
more frequent among toxic texts.  Null and empty texts score as texts without a hit.  Rows that
repeat are scored each; without any labels the curve keeps its default.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import forget_stores, labelled_sample
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Known insults, each a whole word, with weight 1 until labelled rows say otherwise.
SEED_WORDS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "scum", "scumbag", "loser", "losers",
    "worthless", "pathetic", "disgusting", "stupid", "trash", "clown", "dumbass", "asshole",
    "bastard", "retard", "vermin",
)
#: Phrases in which such words insult nobody.
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "clown fish", "rodeo clown", "pond scum",
    "gracious loser", "stupid question",
)
# Letters of other scripts that look like the Latin ones after them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "ѵ": "v", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

MAX_ROWS = 8000  # labelled rows to learn from, at most
MIN_TOXIC = 8  # toxic rows an entry needs
MIN_ODDS = 4.0  # natural logarithm of how much likelier it is among toxic rows


def _folding() -> tuple[dict[int, str], re.Pattern[bytes], bytes, re.Pattern[bytes]]:
    wide = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for small in range(26):  # full-width and mathematical letters
        wide[0xFF21 + small] = wide[0xFF41 + small] = chr(97 + small)
        for block in range(0x1D400, 0x1D6A4, 52):
            wide[block + small] = wide[block + 26 + small] = chr(97 + small)
    wide |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    leads = {chr(c).encode()[0] for c in wide}
    odd = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in sorted(leads)) + b"]")
    plain = bytearray(range(256))
    for c in range(128):
        letter = chr(c).lower()
        plain[c] = ord(letter if letter.isalpha() else DIGITS.get(letter, " "))
    return wide, odd, bytes(plain), re.compile(rb"(?<=[a-z0-9])[@$!](?=[a-z0-9])")


_WIDE, _ODD, _PLAIN, _SIGN = _folding()
_SIGN_OF = {k.encode(): v.encode() for k, v in SIGNS.items()}


def fold(text: str) -> bytes:
    """Folded text in UTF-8 between two blanks."""
    text = text.lower()
    raw = text.encode("utf-8", "replace")
    if _ODD.search(raw):
        raw = text.translate(_WIDE).encode("utf-8", "replace")
    if b"@" in raw or b"$" in raw or b"!" in raw:
        raw = _SIGN.sub(lambda m: _SIGN_OF[m[0]], raw)
    return b" " + raw.translate(_PLAIN) + b" "


def _as_entry(word: str) -> str:
    return word.encode().decode("latin-1")


@dataclass
class Lexicon:
    """Entries with weights: ``" word "`` is a whole word, ``" wor"`` a beginning."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> object:
        import ahocorasick

        if self._automaton is None:
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                built.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                whole = fold(phrase).decode("latin-1")
                built.add_word(whole, (len(whole), None))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, text: str) -> tuple[float, int, int]:
        """Weighted hits, their number, and the number of words."""
        folded = fold(text)
        # By the place where a word begins: the heaviest entry found there.
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded.decode("latin-1")):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                at[start] = max(weight, at.get(start, 0.0))
        for first, last in spared:
            for start in [s for s in at if first <= s < last]:
                del at[start]
        return sum(at.values()), len(at), len(folded.split())

    def scores(self, texts: Sequence[str]) -> pd.DataFrame:
        found = np.array([self.hits(t) for t in texts], dtype=float).reshape(-1, 3)
        z = curve_inputs(found[:, 0], found[:, 2]) @ np.array(self.curve)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "n_hits": found[:, 1].astype("int64")})


def curve_inputs(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Constant, weighted hits, and weighted hits per hundred words, each damped."""
    per_hundred = 100 * raw / np.maximum(words, 1)
    return np.column_stack([np.ones_like(raw), np.log1p(raw), np.log1p(per_hundred)])


def _beginnings(text: str) -> set[str]:
    found = set()
    for raw in set(fold(text).split()):
        word = raw.decode("latin-1")
        found.add(f" {word} ")
        for size in range(4, min(len(word), 10)):
            found.add(f" {word[:size]}")
    return found


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget_stores()
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    rows = [0, 0]
    for frame in frames:
        for text, label in zip(frame["text"], frame["label"], strict=True):
            (toxic if label else clean).update(_beginnings(text))
            rows[int(bool(label))] += 1
    out = [(e, n, clean.get(e, 0)) for e, n in toxic.items()] + [("", rows[1], rows[0])]
    yield pd.DataFrame(out, columns=["entry", "toxic", "clean"])


def _uncovered(family: pd.DataFrame) -> pd.DataFrame:
    """The entries of a family that contain none of those before them and are in none."""
    kept: dict[str, float] = {}
    inside: set[str] = set()  # all beginnings of kept entries
    rows = zip(family["entry"], family["toxic"], family["odds"], strict=True)
    for entry, _, odds in sorted(rows, key=lambda r: (-r[1], -len(r[0].rstrip()), r[0])):
        beginnings = [entry[:n] for n in range(1, len(entry) + 1)]
        if entry not in inside and not any(b in kept for b in beginnings):
            kept[entry] = odds
            inside.update(beginnings)
    return pd.DataFrame({"entry": list(kept), "odds": list(kept.values())})


def learn_entries(sample: DataFrame) -> dict[str, float]:
    """Weights by entry from ``(text, label)`` rows.

    Tasks count rows by entry and take out entries that contain each other: the one with most toxic
    rows stays, of those with equally many the longest beginning.  All others that pass ``MIN_TOXIC``
    and ``MIN_ODDS`` are learned; the labelled rows bound their number.
    """
    counts = (
        sample.mapInPandas(_count, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    total = counts.where("entry = ''").first()
    if total is None or not total["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log(
        (F.col("clean") + 0.5) / (total["clean"] + 1.0)
    )
    best = (
        counts.where((F.col("entry") != "") & (F.col("toxic") >= MIN_TOXIC))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_ODDS)
        .select("entry", "toxic", "odds")
        # Entries that contain each other agree in their blank and the first four letters.
        .groupBy(F.substring("entry", 1, 5))
        .applyInPandas(_uncovered, "entry string, odds double")
        .collect()
    )
    return {r["entry"]: min(r["odds"], 8.0) / 4.0 for r in sorted(best)}


def fit_curve(raw: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's method."""
    x, w = curve_inputs(raw, words), np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - label) + ridge @ w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Lexicon:
    """A lexicon with weights and curve from at most ``max_rows`` labelled rows.

    Held-out rows (crc32 of the id modulo 4 is 2) are never looked at.
    """
    # Exact copies teach once, or all words of a much copied text would count as toxic.
    chosen = labelled_sample(docs, labels, "toxic", max_rows).select("text", "label")
    sample = cut_lineage(chosen.dropDuplicates())
    weights = {f" {_as_entry(w)} ": 1.0 for w in SEED_WORDS} | learn_entries(sample)
    lexicon = Lexicon(weights)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_stores()
        for frame in frames:
            found = [lexicon.hits(t) for t in frame["text"]]
            yield pd.DataFrame(
                {"raw": [f[0] for f in found], "n": [f[2] for f in found], "label": frame["label"]}
            )

    rows = sample.mapInPandas(measure, "raw double, n long, label int").toPandas()
    if rows["label"].nunique() == 2:
        lexicon.curve = fit_curve(
            rows["raw"].to_numpy(float), rows["n"].to_numpy(float), rows["label"].to_numpy(float)
        )
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``to`` of ``score`` (0 to 1) and ``n_hits``; all rows, whole texts."""

    @F.pandas_udf("score double, n_hits long")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget_stores()
        for part in texts:
            yield lexicon.scores(part.tolist())

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(to, scored.asNondeterministic()(whole))
