"""LM scoring: a log-bilinear neural model of word classes, trained by noise contrast.

A word's probability is that of its class after the two classes before it, times the word's own
share of its class.  The most frequent training words are classes of their own, every other word
belongs to one of some classes by its ending, and the end of a text is a class.  The class model
is log-bilinear: position-wise weighted class vectors of the context predict the vector of the
next class.  It learns by noise-contrastive estimation from the corpus-wide counts of all class
triples, none of which is left to chance; matrix products over all contexts at once then give probabilities normalised over the
classes.  Within its class a word has (count + 1) / (tokens + distinct words + 1), as all unseen
words together are one more.

Counts cover all texts that teach.  The most frequent words are sent to all tasks, at most a fixed
number of bounded length; counts of the others are joined by word, as no frequent word is among them.

Null and empty texts are the end alone.  Rows that repeat are counted and scored each.  Without
any text that teaches, all counts are zero and the class model is uniform.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import is_held_out
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OWN = 95  # frequent words that are classes of their own
ENDINGS = 32  # classes of all other words
CLASSES = 1 + OWN + ENDINGS  # class 0 is the end
SENT = 200_000  # frequent words sent to all tasks
SENT_BYTES = 64  # longer words are never sent
_HELD = 400_000  # different words a task counts before it passes them on

WIDTH = 24
NOISE = 8
STEPS = 500
PRIOR = 30.0  # precision of the vectors' normal prior, in triples


def ending(word: bytes) -> int:
    """The class of a word that has none of its own."""
    return 1 + OWN + zlib.crc32(word[-2:]) % ENDINGS


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, class, n)`` of ``texts (text)``; ``class`` is that of the word's ending.

    Tasks count what they read; the end of a text is counted as an empty word.
    """

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array([ending(w) if w else 0 for w in words], pa.int32()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["word", "class", "n"],
            )

        for batch in batches:
            for text in _texts(batch, 0):
                seen.update(words_of(text))
                seen[b""] += 1
                if len(seen) > _HELD:
                    yield passed_on()
                    seen.clear()
        yield passed_on()

    return (
        texts.mapInArrow(partly, "word string, class int, n long")
        .groupBy("word", "class")
        .agg(F.sum("n").alias("n"))
    )


@dataclass
class Vocabulary:
    """What tasks know of words: classes of their own, and counts of frequent words."""

    own: dict[bytes, int]
    sent: dict[bytes, int]

    def classes(self, words: list[bytes]) -> np.ndarray:
        own = self.own
        found = [own.get(w) or ending(w) for w in words]
        found.append(0)
        return np.array(found, dtype=np.int64)


def count_triples(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts of (class before last, last class, class) over all ``texts``; a bounded cube."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            codes = []
            for text in _texts(batch, 0):
                c = np.r_[0, 0, vocabulary.classes(words_of(text))]
                codes.append((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
            if codes:
                cube += np.bincount(np.concatenate(codes), minlength=len(cube))
        some = np.flatnonzero(cube)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(cube[some])], names=["code", "n"]
        )

    rows = (
        texts.mapInArrow(partly, "code long, n long")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    cube = np.zeros(CLASSES**3, dtype=np.float64)
    cube[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return cube.reshape(CLASSES, CLASSES, CLASSES)


@dataclass
class Bilinear:
    """Vectors of context classes and of predicted classes, weights of two positions, biases."""

    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, bias: np.ndarray, seed: int = 1) -> Bilinear:
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, (2, CLASSES, WIDTH))
        return cls(vectors[0], vectors[1], np.array([[0.5], [1.0]]) * np.ones((2, WIDTH)), bias)

    def table(self) -> np.ndarray:
        """log10 P(class | class before last, last class), normalised for every context."""
        far = self.context * self.position[0]
        near = self.context * self.position[1]
        mixed = (far[:, None, :] + near[None, :, :]).reshape(-1, WIDTH)
        scores = mixed @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return (scores / np.log(10)).reshape(CLASSES, CLASSES, CLASSES)


def train(cube: np.ndarray, seed: int = 1) -> Bilinear:
    """Noise-contrastive estimation on all triples, each weighed by its count; noise is by class.

    Nothing is drawn: every step takes the expectation over all counted triples and over all classes
    as noise, so the work depends on the number of different contexts, and the rarest triple counts.
    A normal prior keeps the vectors small where there are few triples; it fades as they grow.
    """
    single = cube.sum(axis=(0, 1)) + 1.0
    noise = single / single.sum()
    model = Bilinear.new(np.log(noise), seed)
    if not cube.any():
        return model
    by_context = cube.reshape(-1, CLASSES)
    at = np.flatnonzero(by_context.sum(axis=1))
    far, near = at // CLASSES, at % CLASSES
    given = by_context[at]
    # Of every triple, so many noise classes are expected beside it.
    wrong = given.sum(axis=1, keepdims=True) * (NOISE * noise)
    both = given + wrong
    names = ("context", "target", "position", "bias")
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in names}
    log_noise = np.log(NOISE * noise)
    for step in range(1, STEPS + 1):
        mixed = model.context[far] * model.position[0] + model.context[near] * model.position[1]
        pull = mixed @ model.target.T
        pull += model.bias - log_noise
        # P(data) of each context and class; overflow leaves 0.
        np.negative(pull, out=pull)
        with np.errstate(over="ignore"):
            np.exp(pull, out=pull)
        pull += 1
        np.divide(both, pull, out=pull)
        np.subtract(given, pull, out=pull)
        slope = {"target": pull.T @ mixed, "bias": pull.sum(axis=0)}
        back = pull @ model.target
        slope["context"] = np.zeros_like(model.context)
        np.add.at(slope["context"], far, back * model.position[0])
        np.add.at(slope["context"], near, back * model.position[1])
        slope["position"] = np.stack(
            [(back * model.context[far]).sum(axis=0), (back * model.context[near]).sum(axis=0)]
        )
        for k in ("context", "target"):
            slope[k] -= PRIOR * getattr(model, k)
        pace = 0.05 * (1 - 0.9 * step / STEPS)
        for k in names:
            g, (first, second) = slope[k], moments[k]
            first *= 0.9
            first += 0.1 * g
            second *= 0.99
            second += 0.01 * g * g
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            setattr(model, k, getattr(model, k) + pace * move)
    return model


@dataclass
class Model:
    vocabulary: Vocabulary
    bilinear: Bilinear
    counts: DataFrame  # (word, class, n), written to the shared folder
    tokens: int
    distinct: int
    ends: int
    class_log: np.ndarray  # log10 of tokens + distinct words + 1, by class of an ending


def _words(rows: DataFrame) -> dict[bytes, int]:
    found = rows.select("word", "n").toArrow()
    words = found.column("word").cast(pa.binary()).to_pylist()
    return dict(zip(words, found.column("n").to_pylist(), strict=True))


def _size_class() -> Column:
    """Counts in sixteen classes per power of two."""
    return F.floor(F.log2("n") * 16)


def sent_from(counts: DataFrame) -> int:
    """The lowest class of counts from which there are at most ``SENT`` words.

    Classes are counted, as there are a thousand at most; no task sorts all words.
    """
    classes = counts.groupBy(_size_class().alias("c")).agg(F.count(F.lit(1))).collect()
    total, limit = 0, 1 << 20
    for c, words in sorted(classes, reverse=True):
        total += words
        if total > SENT:
            break
        limit = c
    return limit


def learn(docs: DataFrame) -> Model:
    """A model of all rows of ``docs (doc_id, text)`` that are not held out (crc32 modulo 7)."""
    texts = docs.where(~is_held_out("doc_id", 7)).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = cut_lineage(count_words(texts))
    tokens, distinct = counts.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    ).first()
    ends = counts.where("word = ''").select("n").first()
    short = counts.where((F.col("word") != "") & (F.octet_length("word") <= SENT_BYTES))
    top = _words(short.orderBy(F.desc("n"), "word").limit(OWN))
    sent = top | _words(short.where(_size_class() >= sent_from(short)))
    vocabulary = Vocabulary({w: 1 + i for i, w in enumerate(top)}, sent)
    # Totals by ending, without the words that are classes of their own.
    class_log = np.zeros(CLASSES)
    totals = np.zeros((CLASSES, 2), dtype=np.int64)
    by_class = counts.where("word != ''").groupBy("class")
    for c, n, v in by_class.agg(F.sum("n"), F.count(F.lit(1))).collect():
        totals[c] = n, v
    for w in vocabulary.own:
        totals[ending(w)] -= sent[w], 1
    class_log[1 + OWN :] = np.log10(totals[1 + OWN :].sum(axis=1) + 1.0)
    return Model(
        vocabulary,
        train(count_triples(texts, vocabulary)),
        counts,
        int(tokens),
        int(distinct),
        int(ends[0]) if ends else 0,
        class_log,
    )


_PARTS = (
    "doc_id long, n_tokens long, n_known long, log_counts double, log_own double, "
    "log_classes double, words array<string>, times array<int>"
)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row.

    Tasks do all but the counts of words that were not sent to them; those words, with how often a
    text has them, are joined with the counts and added up.
    """
    vocabulary, bilinear, class_log, ends = (
        model.vocabulary, model.bilinear, model.class_log, model.ends
    )

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bilinear.table().reshape(-1)
        # Own classes hold one word, which is all of its class.
        within = class_log
        logs = {w: float(v) for w, v in zip(
            vocabulary.sent, np.log10(np.array(list(vocabulary.sent.values()), dtype=float) + 1),
            strict=True,
        )}
        own = {w: logs[w] for w in vocabulary.own}
        end_log = float(np.log10(ends + 1))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                words = words_of(text)
                classes = vocabulary.classes(words)
                c = np.r_[0, 0, classes]
                likely = table[(c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]].sum()
                times = Counter(words)
                known, all_logs, own_logs = int(ends > 0), end_log, end_log
                rest, often = [], []
                for word, n in times.items():
                    log = logs.get(word)
                    if log is None:
                        rest.append(word)
                        often.append(n)
                    else:
                        known += n
                        all_logs += n * log
                        if word in own:
                            own_logs += n * log
                row = (
                    doc_id, len(words) + 1, known, all_logs, own_logs,
                    float(likely - within[classes].sum()), rest, often,
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            arrays[6] = arrays[6].cast(pa.list_(pa.string()))
            names = [c.split(" ")[0] for c in _PARTS.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Written once, so that the row numbers below stay the same.
    parts = cut_lineage(rows.mapInArrow(partly, _PARTS)).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    rest = parts.select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "_row", F.col("w.words").alias("word"), F.col("w.times").alias("times")
    )
    joined = rest.join(model.counts.select("word", "n"), "word")
    added = joined.groupBy("_row").agg(
        F.sum("times").alias("_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_logs"),
    )
    logs = F.col("log_counts") + F.coalesce("_logs", F.lit(0.0))
    whole = float(np.log10(model.tokens + 1 * (model.distinct + 1)))
    return parts.drop("words", "times").join(added, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("log_classes") + logs - F.col("log_own")).alias("score"),
    )
