"""Token ids against the whole tokenizer, packing against its own rules and a lower bound."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "don't DON'T I'll we'RE", "naïve café Ünï × ÷ ª 5½", "áb é", "x\u0085y z",
    "<|endoftext|> x<|startoftext|>y", "\x1c\x1d a\x1fb \x7f", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ",
    "中文 字 😀😀", "１２３ ²³ ٣", "ß ẞ SS Ö'S", "'s's 're'", "a" * 300, "1234 12.5e3 ###abc***",
    "Ａｂ ﬁ K ſ", "tab\tline\nreturn\r\x0b\x0c end",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_whole_tokenizer(tokenizer, text):
    words = packing.WordIds(PATH)
    for _ in range(2):
        got = np.frombuffer(words.of(text.encode()), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def check_plan(counts, size):
    """Every piece is placed once, sequences have no holes and hold at most ``size`` tokens."""
    matches, opened = packing.plan(counts, size)
    ranks = {}
    content = {}
    for length, first, n, sequence, offset in matches:
        for k in range(n):
            ranks.setdefault(length, set()).add(first + k)
            content.setdefault(sequence + k, []).append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == {k: c for k, c in enumerate(counts) if c}
    assert all(v == set(range(len(v))) for v in ranks.values())
    assert sorted(content) == list(range(opened))
    for parts in content.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return opened


def best_fit_decreasing(counts, size):
    gaps = []
    for length in range(size, 0, -1):
        for _ in range(counts[length]):
            room = min((g for g in gaps if g >= length), default=None)
            if room is None:
                gaps.append(size - length)
            else:
                gaps.remove(room)
                gaps.append(room - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_close_to_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([5, 16, 50, 128])
    counts = np.zeros(size + 1, dtype=np.int64)
    for _ in range(rng.choice([1, 20, 400])):
        counts[min(size, 1 + int(rng.paretovariate(0.8)))] += 1
    opened = check_plan(counts, size)
    bound = -(-int((counts * np.arange(size + 1)).sum()) // size)
    assert bound <= opened <= max(best_fit_decreasing(counts, size) * 1.05 + 1, bound)


def test_documents_are_packed_whole(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(["some", "words", "é1"], k=rng.randrange(200))), 0, 0) for i in range(60)]
    rows += [(200, "very long " * 3000, 0, 0), (201, None, 0, 0), (None, "no id", 0, 0), rows[5], rows[70]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, offset long")
    size = 256
    found = packing.best_fit(docs, PATH, size).collect()
    wanted = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), size)):
            own = np.array(ids[at : at + size], "<u4")
            wanted.append((doc_id, n, at, len(own), zlib.crc32(own.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in wanted)
    assert len(sequences) <= -(-total // size) + 2
    packed = packing.sequences(docs, PATH, size).collect()
    assert sorted(len(r.ids) for r in packed) == sorted(sum(p[1] for p in s) for s in sequences.values())


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit(empty, PATH).count() == 0


def test_a_worker_holds_the_ids_of_few_texts_at_a_time(spark, monkeypatch):
    texts = ["a b c " * n for n in (0, 1, 400, 2, 3000, 0, 5)] + [None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]
    )
    parts = list(packing.in_parts(batch, 3000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert len(parts) > 2 and all(n <= 3000 or p.num_rows == 1 for n, p in zip(sizes, parts, strict=True))
    assert not list(packing.in_parts(batch.slice(0, 0), 3000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = packing.pieces(docs, PATH).select(*columns).collect()
    monkeypatch.setattr(packing, "_HELD", 10)
    assert sorted(packing.pieces(docs, PATH).select(*columns).collect()) == sorted(whole)
    assert len({r["doc_id"] for r in whole}) == len(texts)
