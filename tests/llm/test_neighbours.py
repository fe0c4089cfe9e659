"""Approximate neighbours: recall against brute force, exact scores, ties, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from strataspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, part int, score string"


def answers(found):
    by = {}
    for r in sorted(found.collect()):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return by


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = answers(neighbours.search(vectors, F.col("vec_id") % 20 == 0))
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids.tolist()])
    hits = 0
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        near = x @ rows[q]
        near[ids == q] = -np.inf
        truth = set(ids[np.lexsort((ids, -near))[:20]].tolist())
        hits += len(truth & {v for _, v, _ in got[q]})
        assert [r for r, *_ in got[q]] == list(range(1, 21))
        assert all(abs(s - float(rows[v] @ rows[q])) < 1e-12 for _, v, s in got[q])
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
    assert hits / (20 * len(queries)) >= 0.9


def test_odd_vectors_ties_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 7)
    rng = np.random.default_rng(0)
    same = [0.5, 0.25, -1.0]
    rows = [(i, same if i % 3 == 0 else rng.normal(size=3).tolist(), 1, "x") for i in range(400)]
    rows += [(1000, None, 1, "x"), (1020, [0.0, 0.0, 0.0], 1, "x"), (1040, [1.0, None, 2.0], 1, "x"),
             (1060, [float("nan"), 1.0, 1.0], 1, "x"), (1080, [1.0, 2.0], 1, "x"), (1100, [], 1, "x"),
             (1120, [float("inf"), 1.0, 1.0], 1, "x"), (None, [1.0, 1.0, 1.0], 1, "x"), rows[0], rows[60]]
    got = answers(neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, target=1.0))
    assert sorted(got) == list(range(0, 400, 20))
    crowd = [i for i in range(0, 400, 3)]
    # Rows 0 and 60 repeat, so they fill two places; ties go by id.
    for q in (0, 60, 300):
        own = sorted([i for i in crowd + [0, 60] if i != q])
        nearer = [v for _, v, s in got[q] if s > float(np.dot(same, same)) + 1e-9]
        tied = [v for _, v, s in got[q] if abs(s - float(np.dot(same, same))) < 1e-9]
        assert tied == own[: 20 - len(nearer)]


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.5, 1.0], 1, ""), (20, [0.1, 2.0], 1, "")], SCHEMA)
    got = answers(neighbours.search(few, F.col("vec_id") % 20 == 0))
    assert {q: [v for _, v, _ in a] for q, a in got.items()} == {0: [1, 20], 20: [1, 0]}
    assert neighbours.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
