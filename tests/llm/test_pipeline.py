"""Registered queries by their contracts, and the pipeline stage by stage against brute force."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from strataspark.llm import packing, quality_crf, queries, secrets, simhash, toxicity
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_all_queries_are_registered():
    named = entry_points.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in named if re.match(r"op\d", q)}
    assert "pipeline" in named and set(queries.SQL) <= set(entry_points.oracle_sql())


def test_secrets_equal_sql(spark):
    found = queries.op1_secrets(spark, SF)
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = base.execute(queries.SQL["op1_secrets"]).fetchdf()[found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.itertuples(index=False)))


@pytest.mark.parametrize(
    ("name", "table"),
    [("op11_vector_codes", "embeddings"), ("op12_phrases", "documents"), ("op13_warc", "pages")],
)
def test_new_queries_equal_sql(spark, name, table):
    found = queries.QUERIES[name](spark, SF)
    base = duckdb.connect()
    base.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = base.execute(queries.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in found.columns]
    wanted = [tuple(row[i] for i in at) for row in cursor.fetchall()]
    assert wanted and sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op2_merge_dropout", "doc_id n_pieces ids_crc32 lossless"),
        ("op3_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
        ("op8_log_bilinear", "doc_id held_out n_tokens n_known train_tokens base_score score"),
        ("op9_pages", "page_id url text n_chars"),
        ("op10_simhash", "doc_id fingerprint component_id"),
    ],
)
def test_queries_cover_their_tables(spark, name, columns):
    found = queries.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(found.columns)
    given = spark.read.parquet(f"{SF}/{'pages' if name == 'op9_pages' else 'documents'}.parquet")
    assert found.count() == given.count()
    if "lossless" in found.columns:
        assert found.where("not lossless").isEmpty()


def test_fingerprints_and_components_of_the_table(spark):
    found = queries.op10_simhash(spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in texts]
    wanted = {
        i: (f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints), strict=True)
    }
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == wanted


def test_stages_equal_brute_force(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    folder = str(tmp_path)

    def run(name, docs):
        stage = dict(corpus_pipeline.STAGES)[name]
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = given.collect()
    clean = run("toxicity", given)
    scores = toxicity.learn(given, labels).scores([r["text"] or "" for r in rows])["score"]
    kept = [r for r, s in zip(rows, scores, strict=True) if s < queries.TOXIC_FROM]
    assert clean.columns == given.columns
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, kept))
    assert 0 < len(rows) - len(kept) < 0.3 * len(rows)

    good = run("quality", clean)
    scores = quality_crf.learn(clean, labels).scores([r["text"] or "" for r in kept])["score"]
    kept = [r for r, s in zip(kept, scores, strict=True) if s >= queries.GOOD_FROM]
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, kept))

    once = run("near_duplicates", good)
    prints = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in kept]
    kept = [
        r for r, c in zip(kept, plain_components(prints), strict=True) if r["doc_id"] == c
    ]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, kept))

    hidden = run("secrets", once)
    before = {r["doc_id"]: r["text"] for r in kept}
    changed = 0
    for r in hidden.collect():
        text = before.pop(r["doc_id"])
        assert r["n_chars"] == len(r["text"])
        changed += r["text"] != text
        pattern = ".*".join(map(re.escape, r["text"].split("[secret]")))
        assert re.fullmatch(pattern, text, re.S)
    assert not before and changed
    left = secrets.scan(
        hidden.withColumnsRenamed({"source": "owner", "lang": "repository"}), "doc_id", "repository", "owner"
    )
    assert left.where("array_contains(verdicts, 'live')").isEmpty()

    packed = run("packing", hidden).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept}
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= 1.01 * total / packing.SIZE + 2


@pytest.mark.parametrize("some", [True, False])
def test_odd_documents_go_through(spark, tmp_path, some):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id, but a text of its own", "en", "s", 1),
        (3, "a plain text of words that say nothing, twice\n" * 2, "en", "s", 1), (3, "the same id again", "en", "s", 1),
        (5, "long words here " * 20_000, "en", None, 1), (6, "you idiot, you stupid moron", "en", "s", 1),
    ] if some else []
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert some or not found
    assert all(r["length"] > 0 for r in found)


def test_one_text_of_each_group_is_left(spark):
    rows = [(i, "one text that many documents share, word by word", "en", "s", 1) for i in range(300)]
    rows += [(1000 + i, f"text number {i} has words {i * 7} of its own {i * i}", "en", "s", 1) for i in range(40)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, *range(1000, 1040)]
