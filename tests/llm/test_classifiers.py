"""Toxicity, quality classifier and quality rules: brute force, edge cases, held-out accuracy."""

import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from strataspark.llm import common, quality_crf, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("text", "hits"),
    [
        ("", 0), ("You IDIOT!", 1), ("1d10t and m0r0n", 2), ("іdіоt", 1), ("ｉｄｉｏｔ", 1),
        ("st­upid", 1), ("idiotic", 0), ("a trash can, no trash", 1), ("sc$m", 0), ("l0$er", 1),
        ("no hits at all 123 $5 a@b.c", 0), ("clown fish", 0), ("idiot\nidiot idiot", 3),
    ],
)
def test_lexicon_folds_and_spares(text, hits):
    lexicon = toxicity.Lexicon({f" {w} ": 1.0 for w in toxicity.SEED_WORDS})
    assert lexicon.hits(text)[1] == hits


def test_lexicon_takes_beginnings():
    lexicon = toxicity.Lexicon({" lowe": 2.0, " idiot ": 1.0})
    assert lexicon.hits("Loweisch flowers lowe") == (4.0, 2, 3)


def test_every_toxic_word_is_learned(spark):
    letters = "bcdfghklmnprst"
    words = ["".join(w) + "otexa" for w in itertools.product(letters, repeat=3)][:500]
    rows = [(f"{w} in a row", 1) for k, w in enumerate(words) for _ in range(30 + k % 3)]
    rows += [("nothing in a row", 0)] * len(rows)
    learned = toxicity.learn_entries(spark.createDataFrame(rows, "text string, label int"))
    lexicon = toxicity.Lexicon(learned)
    assert [w for w in words if not lexicon.hits(w)[1]] == []
    assert lexicon.hits("nothing in a row")[1] == 0
    entries = sorted(learned)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(entries))


def brute_marginals(states, steps):
    n = len(states)
    weights = {}
    for path in itertools.product((0, 1), repeat=n):
        s = sum(states[t][path[t]] for t in range(n))
        s += sum(steps[path[t - 1]][path[t]] for t in range(1, n))
        weights[path] = np.exp(s)
    total = sum(weights.values())
    each = [sum(w for p, w in weights.items() if p[t]) / total for t in range(n)]
    arcs = np.zeros((2, 2))
    for p, w in weights.items():
        for t in range(1, n):
            arcs[p[t - 1], p[t]] += w / total
    return each, np.log(total), arcs


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 1, 6, 2, 0]
    starts = np.r_[0, np.cumsum(sizes)]
    states, steps = rng.normal(size=(starts[-1], 2)), rng.normal(size=(2, 2))
    logs, whole, arcs = quality_crf.marginals(states, steps, starts)
    expected = [brute_marginals(states[a:b], steps) for a, b in itertools.pairwise(starts) if b > a]
    assert np.allclose(np.exp(logs[:, 1]), [x for e in expected for x in e[0]])
    assert np.allclose(whole, [e[1] for e in expected])
    assert np.allclose(arcs, sum(e[2] for e in expected))


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    "", "   \n\t", "one", "a b c d e a b c d e", "x " * 40, "same line\nsame line\n\nother\nsame line",
    "é ü# $%& |<>*", "a b c d e f\x0bg\x0ch a b c d e", "１２　x y", "w1 w2 w3 w4 w5 w1 w2 w3 w4",
]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_equal_brute_force(text):
    assert quality_rules.statistics(text)[:5] == plain_statistics(text)


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    noisy = x[:, 2] + 0.3 * np.sin(9 * x[:, 2]) + 0.4 * x[:, 0] + rng.normal(0, 0.3, 3000)
    trees = quality_rules.fit(x, (noisy < 0.7).astype(float))
    rows = np.repeat(x[:50], 40, axis=0)
    rows[:, 2] = np.tile(np.linspace(0, 1, 40), 50)
    scores = trees.scores(rows).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()
    assert ((trees.scores(x) > 0.5) == (noisy < 0.7)).mean() > 0.8

    def walk(row):
        z = trees.start
        for node in trees.roots.tolist():
            while trees.low[node] != node:
                below = row[trees.feature[node]] <= trees.threshold[node]
                node = trees.low[node] if below else trees.high[node]
            z += trees.value[node]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(trees.scores(x[:200]), [walk(r) for r in x[:200]])


@pytest.mark.parametrize(
    ("query", "label", "least"),
    [("op7_toxicity", "toxic", 0.93), ("op6_quality", "quality", 0.97)],
)
def test_held_out_rows_are_told_apart(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").max(label)
    found = queries.QUERIES[query](spark, SF).where("held_out").join(labels, "doc_id")
    rows = found.select("predicted", f"max({label})").collect()
    assert len(rows) > 500
    assert sum(a == b for a, b in rows) / len(rows) > least


def frames(spark, rows):
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, label int, score double, toxicity string, quality int"
    )
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2, "x") for i in range(40)] + [(None, 1, 1, "x"), (3, None, None, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    return docs, labels


ROWS = [
    (i, ("all good words in this line here\n" * 1 if i % 2 else "### $$$ ***\n") * 3 + f"row {i}", None, 0.5, "t", 1)
    for i in range(40)
] + [
    (50, None, 1, None, None, None), (51, "", 1, None, None, None), (None, "no id", None, None, None, None),
    (52, "long " * 50_000, None, None, None, None), (0, "### $$$ ***\n", None, None, None, None),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_odd_rows_are_scored(spark, rows):
    docs, labels = frames(spark, rows)
    lexicon = toxicity.learn(docs, labels)
    model = quality_crf.learn(docs, labels)
    trees = quality_rules.learn(docs, labels)
    for scored, column in (
        (toxicity.score(docs, lexicon, to="_x"), "_x.score"),
        (quality_crf.score(docs, model, to="_x"), "_x.score"),
        (quality_rules.judge(docs, trees, to="_x"), "_x.score"),
    ):
        got = scored.select("doc_id", column, *docs.columns[1:]).collect()
        assert len(got) == len(rows)
        assert all(0 <= r[1] <= 1 for r in got)
        assert sorted(((r[0], r[2]) for r in got), key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)


def test_toxicity_lets_go_of_what_other_operators_kept():
    store = common.worker_store("words", dict)
    store["a"] = b"b"
    frame = pd.DataFrame({"text": ["an idiot"], "label": [1]})
    (counted,) = toxicity._count(iter([frame]))
    assert " idiot " in set(counted["entry"])
    assert common.worker_store("words", dict) == {}
