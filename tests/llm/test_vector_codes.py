"""Product codes against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows, parts, entries, rounds, scale=256):
    """Codes and codebooks by the definition, in Python integers."""
    kept = [
        r
        for r in rows
        if r[1] and all(x is not None and math.isfinite(x) and abs(x) <= vc.LARGEST for x in r[1])
        and len(r[1]) % parts == 0
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return {}, None
    width = len(kept[0][1]) // parts
    whole = [[math.floor(scale * x) for x in r[1]] for r in kept]
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [[list(v) for v in part[:entries]] for part in cut]

    def nearest(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v, books[p])[0] for v in cut[p]]
            for e in range(len(books[p])):
                members = [v for v, n in zip(cut[p], own, strict=True) if n == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    coded = []
    for i, r in enumerate(kept):
        found = [nearest(cut[p][i], books[p]) for p in range(parts)]
        coded.append((r[0], r[2], [n for n, _ in found], sum(d for _, d in found)))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return coded, hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    books = vc.learn(df, parts=parts, entries=entries, rounds=rounds)
    coded = vc.with_label_error(vc.encode(df, books)).collect()
    return coded, books


def listed(rows):
    return sorted(rows, key=repr)


def test_equals_definition(spark):
    draw = np.random.default_rng(3)
    rows = [
        (i, (draw.normal(0, 0.2, 8) + (i % 5) * 0.3).tolist(), None if i % 7 == 0 else i % 4)
        for i in range(400)
    ]
    rows += [(i, rows[i][1], 9) for i in range(0, 400, 9)]  # repeated rows
    rows += [
        (1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [math.nan] * 8, 1), (1003, [math.inf] * 8, 1),
        (1004, [0.1] * 4, 1), (1005, [], 1), (None, [0.05] * 8, None), (1006, [-0.0] * 8, 2),
        (1007, [1e12, -1e12] * 4, 3), (1008, [1e300] * 8, 3),
    ]
    coded, books = run(spark, rows, 4, 16, 2)
    wanted, digest = brute(rows, 4, 16, 2)
    assert books.digest() == digest
    fits = [(i, lab, code, err if err < 2**63 else None) for i, lab, code, err in wanted]
    assert listed([(r.vec_id, r.label, r.code, r.error) for r in coded]) == listed(fits)
    per_label = {}
    for _, lab, _, err in fits:
        per_label[lab] = per_label.get(lab, 0) + (err or 0)
    assert all(r.label_error == per_label[r.label] for r in coded)


def test_fewer_vectors_than_entries(spark):
    rows = [(2, [0.5, 0.25], 1), (1, [0.5, 0.25], None), (3, [0.0, 1.0], None)]
    coded, books = run(spark, rows, 2, 64, 2)
    wanted, digest = brute(rows, 2, 64, 2)
    assert books.digest() == digest and len(books.books[0]) == 3
    assert listed([(r.vec_id, r.label, r.code, r.error) for r in coded]) == listed(wanted)


def test_no_vector_takes_part(spark):
    df = spark.createDataFrame([(1, None, 1, "x", "y"), (2, [math.nan], 1, "x", "y")], SCHEMA)
    assert vc.learn(df) is None
    assert vc.with_label_error(vc.encode(df, None)).collect() == []
    assert vc.learn(df.limit(0)) is None


def test_decoding_gives_the_entries(spark):
    rows = [(i, [i / 10, 1 - i / 10, 0.3, -i / 7], 0) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    books = vc.learn(df, parts=2, entries=8)
    found = vc.decode(vc.encode(df, books), books).collect()
    for row in found:
        wanted = [x for p, c in enumerate(row.code) for x in books.books[p][c]]
        assert [int(x) for x in row.vector] == wanted
        given = [math.floor(256 * x) for x in rows[row.vec_id][1]]
        assert row.error == sum((a - b) ** 2 for a, b in zip(given, wanted, strict=True))


def test_two_digits_each(spark):
    df = spark.createDataFrame([([0, 15, 16, 255],)], "code array<int>")
    assert df.select(vc.hexadecimal().alias("h")).first().h == "000f10ff"


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=40),
    st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=12),
)
def test_cells_never_lose_the_nearest(points, book):
    memo = vc.CellMemo(np.array(book, np.int64))
    for _ in range(2):  # the second time from memory
        codes, far = memo.nearest(np.array(points, np.int64))
        assert (codes.tolist(), far.tolist()) == vc._plain_nearest(np.array(points), [tuple(b) for b in book])


def test_colliding_cells_and_a_full_memo(monkeypatch):
    draw = np.random.default_rng(1)
    book = draw.integers(-200, 200, (20, 4))
    points = draw.integers(-260, 260, (3000, 4))
    monkeypatch.setattr(vc, "_CELLS_KEPT", 50)
    memo = vc.CellMemo(book)
    wanted = vc._plain_nearest(points, [tuple(b) for b in book.tolist()])
    for odd in (memo.odd, np.zeros(4, np.uint64)):  # zeros: all cells share one hash
        memo.odd = odd
        memo.clear()
        for at in range(0, 3000, 500):
            codes, _ = memo.nearest(points[at : at + 500])
            assert codes.tolist() == wanted[0][at : at + 500]


def test_memo_saves_evaluations():
    draw = np.random.default_rng(2)
    book = (draw.normal(0, 32, (64, 4))).astype(np.int64)
    points = (draw.normal(0, 32, (20000, 4))).astype(np.int64)
    memo = vc.CellMemo(book)
    memo.nearest(points)
    assert memo.evaluated < 0.5 * len(points) * len(book)


@pytest.mark.parametrize("parts", [3])
def test_lengths_that_do_not_divide_take_no_part(spark, parts):
    df = spark.createDataFrame([(1, [1.0] * 4, 0, "", ""), (2, [1.0] * 6, 0, "", "")], SCHEMA)
    books = vc.learn(df, parts=parts)
    assert [r.vec_id for r in vc.encode(df, books).select("vec_id", F.col("code")).collect()] == [2]
