"""Rows that repeat ids: near-duplicates and samples."""

from pyspark.sql import functions as F

from strataspark.llm import packing, simhash
from strataspark.llm.common import labelled_sample


def test_no_text_of_its_own_is_lost(spark):
    """16 ids that each occur twice, with a copied text and with a text of their own."""
    copied = "the same words in every one of these documents and nothing else at all " * 5
    own = [f"only here number {i} " + " ".join(f"w{i}x{j * 7919 % 101}" for j in range(60)) for i in range(16)]
    rows = [(i, copied, "a") for i in range(16)] + [(i, own[i], "b") for i in range(16)]
    rows += [(3, own[3], "c"), (None, copied, "d"), (None, copied, "d"), (40, None, "e"), (41, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = [tuple(r) for r in simhash.one_of_each(docs).select("doc_id", "text").collect()]
    assert sorted(kept, key=repr) == sorted(
        [(i, own[i]) for i in range(16)] + [(0, copied), (None, copied), (None, copied), (40, None)], key=repr
    )
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(5000).select(
        F.when(F.col("id") < 4990, 7).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
    )
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    for limit in (10, 3):
        found = labelled_sample(docs, labels, "quality", limit, by=1000).collect()
        assert len(found) <= limit
        assert all(r.text == "text 0" for r in found if r.doc_id == 7)


def test_ids_across_ranges_of_bytes(spark, monkeypatch):
    """Texts cut into ranges of a few bytes give the same pieces."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "one two  three\tfour\n", "x" * 300, None, "don't stop naïve 中文 " * 40, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted(tuple(r) for r in packing.pieces(docs, path, size=64).collect())
    words = packing.WordIds(path)
    import pyarrow as pa

    array = pa.array([t or "" for t in texts])
    ids, firsts = packing.ids_of(array, words, 0)
    monkeypatch.setattr(packing, "_RANGE", 5)
    again, begins = packing.ids_of(array, words, 0)
    assert ids.tolist() == again.tolist() and firsts.tolist() == begins.tolist()
    sizes = {}
    for doc_id, _, _, length, _ in whole:
        sizes[doc_id] = sizes.get(doc_id, 0) + length
    assert [sizes[i] for i in range(len(texts))] == [
        len(words.of((t or "").encode())) // 4 + 1 for t in texts
    ]
