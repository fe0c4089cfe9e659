"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.llm import collocations as col

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, max_words=4, covered=80, top=2000):
    """Rows of the result by their definition."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            for size in range(1, max_words + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        held = Counter()
        for phrase, n in candidates.items():
            for size in range(2, len(phrase)):
                for i in range(len(phrase) - size + 1):
                    part = phrase[i : i + size]
                    held[part] = max(held[part], n)
        scored = []
        for phrase, a in candidates.items():
            cuts = []
            for k in range(1, len(phrase)):
                left, right = own[phrase[:k]], own[phrase[k:]]
                cuts.append((2000000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            if 100 * held[phrase] < covered * a:
                scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, least, **options):
    schema = "lang string, text string, rank int, phrase string, n string, w1 string"
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], schema).repartition(4)
    return sorted(tuple(r) for r in col.mine(df, least, **options).collect())


def sample(seed, rows=300, vocabulary=12):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Straße", "İx", "NEW", "york", "city"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(rows):
        text = ""
        for _ in range(draw.randrange(0, 60)):
            text += draw.choices(words, weights)[0]
            text += draw.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "  ", "\x0b", "; "])
            if draw.random() < 0.08:
                text += "new York city hall "
        out.append((draw.choice(["en", "fr", None, "und"]), text if i % 17 else None))
    return out


def test_equals_counting(spark):
    rows = sample(1)
    rows += [rows[5]] * 40 + [("en", ""), ("de", "allein"), ("x", "a b " * 50), ("en", "...,,,")]
    for least, max_words in ((5, 4), (12, 3), (30, 4), (20, 2), (9, 5)):
        wanted = brute(rows, least, max_words)
        assert wanted
        assert mined(spark, rows, least, max_words=max_words) == wanted


def test_hashes_are_those_of_spark(spark):
    words = ["the", "x", "Straße", ""]
    ids = col.WordIds(col.Bloom(np.full(1, 2**64 - 1, np.uint64), 6), "+")
    numbers = ids.numbers("en", [w.encode() for w in words])
    df = spark.createDataFrame([("en", w) for w in words], "lang string, word string")
    hashed = [r.h for r in df.select(col.word_hash("+").alias("h")).collect()]
    own = ids.hashes()[numbers]
    assert own.view(np.int64).tolist() == hashed
    pair = spark.createDataFrame([(hashed[0], hashed[1])], "a long, b long")
    wanted = pair.select(col.F.xxhash64("a", "b").alias("h")).first().h
    first = col._joined(np.full(1, 42, np.uint64), own[:1])
    assert col._joined(first, own[1:2]).view(np.int64)[0] == wanted


def test_salt_tells_words_apart(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, word string")
    assert col.distinguishing_salt(words) == ""
    monkeypatch.setattr(
        col, "word_hash", lambda salt: col.F.xxhash64("word") % col.F.lit(1 if salt == "" else 10**12)
    )
    assert col.distinguishing_salt(words) == "+"


def test_best_of_each_language(spark):
    rows = sample(2)
    assert mined(spark, rows, 4, top=7) == brute(rows, 4, top=7)


def test_crowded_words_and_small_chunks(spark, monkeypatch):
    """Leads of several words, slices within words' texts, dictionaries emptied: the same counts."""
    monkeypatch.setattr(col, "TASK_ROWS", 60)
    monkeypatch.setattr(col, "_CHUNK", 37)
    monkeypatch.setattr(col, "_SLICE", 50)
    monkeypatch.setattr(col, "_WORDS_KEPT", 9)
    rows = sample(3, 150) + [("en", "the of " * 400), ("en", "the of the and " * 100)]
    assert mined(spark, rows, 6) == brute(rows, 6)


def test_filters_that_hold_everything(spark, monkeypatch):
    """A saturated filter costs rows, no counts."""
    monkeypatch.setattr(col.Bloom, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    rows = sample(4, 120)
    assert mined(spark, rows, 6) == brute(rows, 6)


def test_large_counts_stay_exact(spark):
    rows = [("en", "a b", 2, 5_000_000_000_000_000), ("en", "a", 1, 9_000_000_000_000_000), ("en", "b", 1, 5_000_000_000_000_001)]
    found = spark.createDataFrame(rows, "lang string, phrase string, words int, n long").select(
        "lang", "phrase", "words", "n"
    )
    row = col.scored(found).first()
    assert row.score == 2000000 * rows[0][3] // (rows[1][3] + rows[2][3])
    assert col.uncovered(col.scored(found)).count() == 1


def test_no_rows(spark):
    assert mined(spark, [("en", None)], 2) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert col.mine(empty).collect() == []


def test_very_long_text(spark):
    rows = [("en", "one two three four " * 60000), ("en", "x" * 3_000_000)]
    assert mined(spark, rows, 30) == brute(rows, 30)


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.tuples(*[st.integers(0, 3)] * 4), min_size=1, max_size=60),
    st.integers(1, 6),
    st.integers(0, 2**32),
)
def test_quicksort_finds_all_frequent_beginnings(rows, least, seed):
    words = np.array(rows, np.int64)
    words[:, 0] += 1
    for i in range(1, 4):  # nothing follows an end
        words[:, i] *= words[:, i - 1] > 0
    n = np.random.default_rng(seed).integers(1, 4, len(words))
    wanted = Counter()
    for row, count in zip(words.tolist(), n.tolist(), strict=True):
        for depth in range(1, 5):
            if row[depth - 1]:
                wanted[tuple(row[:depth])] += count
    found = {}
    for depth, at, size in col.equal_partitions(words, n, least):
        for i, s in zip(at.tolist(), size.tolist(), strict=True):
            key = tuple(words[i, :depth].tolist())
            assert key not in found
            found[key] = s
    assert found == {k: v for k, v in wanted.items() if v >= least}


def test_suffixes_that_begin_alike_leave_a_task_side_by_side(spark):
    draw = random.Random(7)
    text = " ".join(draw.choice("abcdefgh") for _ in range(4000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string").coalesce(1)
    every = col.Bloom(np.full(1, -1, np.int64).view(np.uint64), 6)
    none = col.Bloom(np.zeros(1, np.uint64), 6)
    rows = [r[1:5] for r in col.suffixes(docs, every, none, every).collect()]
    changes = sum(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert len({r[0] for r in rows}) == 8 and changes == 7


def test_routes_are_not_moved(spark):
    schema = "lang string, lead string, w1 string, w2 string, w3 string, n long"
    routed = spark.createDataFrame([("en", "a", "b", "c", None, 40)], schema)
    found = col.phrase_counts(routed, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :]
    assert "xxhash64" not in moved and "route" not in moved
    assert [tuple(r) for r in found.collect()] == [("en", "a b c", 3, 40)]
