"""The operators of this package as queries, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import (
    collocations,
    log_bilinear,
    merge_dropout,
    neighbours,
    packing,
    pages,
    quality_crf,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    vector_codes,
    warc,
)
from strataspark.llm.common import id_and_text, is_held_out, table
from strataspark.session import durable_folder

#: Scores from which a row counts as positive.
TOXIC_FROM = 0.3
GOOD_FROM = 0.7


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def repositories(docs: DataFrame) -> DataFrame:
    """Documents with their owner (the source) and repository (the source's part by language)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.col("source").alias("owner"),
        F.concat_ws("/", "source", "lang").alias("repository"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with their ownership over the corpus."""
    docs = repositories(table(spark, sf_dir, "documents"))
    found = secrets.scan(docs, "doc_id", "repository", "owner")
    count = {k: F.size(secrets.of_kind(n)).cast("long") for n, k in enumerate(("assign", "access", "hex"))}
    live = F.filter("verdicts", lambda v: v == "live")
    copied = F.filter("verdicts", lambda v: v == "example")
    return found.select(
        "doc_id",
        *[n.alias(f"n_{k}") for k, n in count.items()],
        F.sha2(secrets.joined(secrets.base()), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(copied).cast("long").alias("n_examples"),
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in secrets.COUNTS],
    )


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces under merge-dropout, decoded and compared with its text."""
    docs = table(spark, sf_dir, "documents")
    return merge_dropout.encode(docs, vocabulary("piece_bpe_32k.model"), seed=7, share=0.1)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the quality rules for every document."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(id_and_text(docs), trees)
    columns = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score"
    ).split()
    return judged.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in columns])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.score(id_and_text(docs), model)
    return scored.select(
        "doc_id",
        is_held_out("doc_id", 4).alias("held_out"),
        F.col("quality.score").alias("score"),
        (F.col("quality.score") >= GOOD_FROM).cast("int").alias("predicted"),
        F.col("quality.n_lines").alias("n_lines"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(id_and_text(docs), lexicon)
    return scored.select(
        "doc_id",
        is_held_out("doc_id", 4).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.col("toxicity.n_hits").alias("n_hits"),
    )


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the unigram base and the neural model."""
    docs = table(spark, sf_dir, "documents")
    scored = log_bilinear.score(docs, log_bilinear.learn(docs))
    return scored.select(
        "doc_id",
        is_held_out("doc_id", 7).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = table(spark, sf_dir, "pages")
    return pages.extract(found, pages.learn(found), to="_main").select(
        "page_id",
        "url",
        F.col("_main.text").alias("text"),
        F.length("_main.text").cast("long").alias("n_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the errors by label."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.learn(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return coded.select(
        "vec_id",
        vector_codes.hexadecimal().alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).alias("codebooks_sha256"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives written."""
    folder = f"{durable_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]
    records = warc.read_archives(spark, folder, columns)
    return records.where("record_type in ('response', 'revisit')").select(
        warc.row_of("record_id").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        warc.row_of("refers_to").alias("refers_to"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_merge_dropout": op2_merge_dropout,
    "op3_rules": op3_rules,
    "op4_packing": op4_packing,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_log_bilinear": op8_log_bilinear,
    "op9_pages": op9_pages,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_phrases": op12_phrases,
    "op13_warc": op13_warc,
}

#: DuckDB SQL for the queries that SQL can express over whole tables.
SQL: dict[str, str] = {}


def _secrets_sql() -> str:
    """Candidates by kind, positions from the pieces between them, owners by value."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    finds = []
    for n, kind in enumerate(secrets.KINDS):
        pattern = quoted(kind.pattern)
        finds.append(
            f"select row_id, {n} as kind, '{kind.name}' as name, {kind.group} as grp, {kind.least} as least, "
            f"regexp_extract_all(body, {pattern}, 0) as m, string_split_regex(body, {pattern}) as p, "
            f"regexp_extract_all(body, {pattern}, {kind.group}) as v from docs"
        )
    return f"""
with docs as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as body, coalesce(source, '') as owner,
    concat_ws('/', source, lang) as repository
  from documents),
found as ({" union all ".join(finds)}),
cells as (
  select row_id, kind, name, least, v[i] as value,
    cast(list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as start, length(m[i]) as size
  from (select *, unnest(range(1, len(m) + 1)) as i from found where len(m) > 0)),
kept as (
  select * from cells where length(value) >= least and (name <> 'opaque' or (regexp_matches(value, '[0-9]')
    and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')))),
owned as (
  select value, count(distinct owner) as owners, count(distinct (owner, repository)) as repositories
  from kept join docs using (row_id) group by value),
judged as (
  select k.*, owners, repositories, case when owners >= {secrets.WIDE_OWNERS} or repositories >= {secrets.WIDE_REPOSITORIES} then 'example'
    when len(list_distinct(string_split(k.value, ''))) >= {secrets.LIVE_SYMBOLS} then 'live' else 'unsure' end as verdict,
    name || ':' || cast(start as varchar) || ':' || cast(start + size as varchar) as span
  from kept k join owned using (value)),
listed as (
  select row_id, count(*) filter (name = 'assign') as n_assign, count(*) filter (name = 'access') as n_access,
    count(*) filter (name = 'hex') as n_hex,
    string_agg(span, ',' order by start, kind) filter (kind < {secrets.BASE_KINDS}) as base,
    string_agg(span, ',' order by start, kind) as spans, count(*) filter (verdict = 'live') as n_live,
    string_agg(cast(owners as varchar), ',' order by start, kind) as owner_counts,
    string_agg(cast(repositories as varchar), ',' order by start, kind) as repository_counts,
    count(*) filter (verdict = 'example') as n_examples
  from judged where name <> 'opaque' or verdict = 'live' group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples,
  coalesce(owner_counts, '') as owners, coalesce(repository_counts, '') as repositories
from docs left join listed using (row_id)"""


SQL["op1_secrets"] = _secrets_sql()


def _codes_sql() -> str:
    """Every part against every entry of its codebook, round by round."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES

    def assigned(name: str, books: str) -> str:
        # Whole numbers of this size are exact in doubles.
        return f"""
{name} as (
  select row_id, part, min_by(entry, (dist, entry)) as entry, min(dist) as dist, any_value(v) as v
  from (select p.row_id, p.part, b.entry, p.v,
      list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as dist
    from cut p join {books} b using (part)) group by row_id, part)"""

    def moved(name: str, books: str, by: str) -> str:
        return f"""
{name} as (
  select b.part, b.entry, coalesce(s.v, b.v) as v from {books} b left join (
    select part, entry, list(cast(floor(total / n) as hugeint) order by pos) as v from (
      select part, entry, pos, sum(x) as total, count(*) as n from (
        select part, entry, unnest(range(1, len(v) + 1)) as pos, unnest(v) as x from {by})
      group by part, entry, pos) group by part, entry) s using (part, entry))"""

    return f"""
with usable as (
  select row_number() over () as row_id, vec_id, label, embedding from embeddings
  where len(embedding) > 0 and len(embedding) % {parts} = 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x) <= {vector_codes.LARGEST})) = len(embedding)),
kept as (
  select * from usable
  where len(embedding) = (select len(embedding) from usable order by vec_id nulls last, embedding limit 1)),
cut as (
  select row_id, part,
    list_transform(embedding[part * len(embedding) // {parts} + 1:(part + 1) * len(embedding) // {parts}],
      lambda x: cast(floor({vector_codes.SCALE} * cast(x as double)) as hugeint)) as v
  from (select row_id, embedding, unnest(range({parts})) as part from kept)),
seeds as (
  select row_id, row_number() over (order by vec_id nulls last, embedding) - 1 as entry from kept
  qualify entry < {entries}),
books0 as (select part, entry, v from cut join seeds using (row_id)),
{assigned("near0", "books0")},
{moved("books1", "books0", "near0")},
{assigned("near1", "books1")},
{moved("books2", "books1", "near1")},
{assigned("near2", "books2")},
coded as (
  select row_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(dist) as bigint) as error
  from near2 group by row_id),
digest as (
  select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) as codebooks_sha256
  from (select part, entry, unnest(range(len(v))) as pos, unnest(v) as x from books2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (row_id), digest"""


def _phrases_sql() -> str:
    """All runs of up to four words, counted as they are."""
    c, upper = collocations, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with pieces as (
  select row_number() over () as piece_id, lang, piece from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
words as (
  select piece_id, lang, unnest(w) as w, unnest(range(len(w))) as place from (
    select piece_id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w
    from pieces)),
runs as (
  select lang, w as w1, lead(w, 1) over places as w2, lead(w, 2) over places as w3, lead(w, 3) over places as w4
  from words window places as (partition by piece_id order by place)),
phrases as (
  select lang, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4]) as phrase
  from runs),
counts as (
  select lang, phrase, string_split(phrase, ' ') as w, count(*) as n
  from phrases where phrase is not null group by lang, phrase),
candidates as (select lang, phrase, w, n as a from counts where len(w) > 1 and n >= {c.LEAST}),
cuts as (
  select c.lang, c.phrase, c.w, c.a, k, l.n as l, r.n as r,
    cast((2000000::hugeint * c.a) // (l.n + r.n) as bigint) as score
  from (select *, unnest(range(1, len(w))) as k from candidates) c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, part, max(a) as longest from (
    select lang, a, w, size, unnest(list_transform(range(1, len(w) - size + 2),
      lambda i: array_to_string(w[i:i + size - 1], ' '))) as part
    from (select *, unnest(range(2, len(w))) as size from candidates where len(w) > 2)) group by lang, part),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(phrase)) as rank
  from best b left join inner_parts i on i.lang = b.lang and i.part = b.phrase
  where i.longest is null or 100::hugeint * i.longest < {c.COVERED}::hugeint * b.a),
totals as (select lang, sum(n)::bigint as n from counts where len(w) = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {c.TOP}"""


def _warc_sql() -> str:
    """Records as their rows define them."""
    digits = (
        "list_transform(range(40), lambda i: strpos('0123456789abcdef', sha1(payload)[i + 1]) - 1)"
    )
    # Four digits of 16 values and four bits each are 16 bits; letters take five bits of the whole.
    return f"""
with rows as (
  select page_id, coalesce(html, '') as payload from pages),
bits as (
  select page_id, strlen(payload) as payload_bytes,
    list_reduce(list_transform({digits}, lambda d: printf('%d%d%d%d', (d >> 3) & 1, (d >> 2) & 1, (d >> 1) & 1, d & 1)),
      lambda a, b: a || b) as b
  from rows),
digests as (
  select page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i:
    '{warc._BASE32}'[1 + list_sum(list_transform(range(5), lambda j: cast(b[i * 5 + j + 1] as integer) * (16 >> j)))::integer]),
    lambda a, b: a || b) as payload_digest
  from bits),
led as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as first from digests)
select page_id, payload_bytes, payload_digest,
  case when page_id < first and payload_bytes >= {warc.MIN_BYTES} then 'revisit' else 'response' end as record_type,
  case when page_id < first and payload_bytes >= {warc.MIN_BYTES} then first end as refers_to
from led"""


SQL["op11_vector_codes"] = _codes_sql()
SQL["op12_phrases"] = _phrases_sql()
SQL["op13_warc"] = _warc_sql()
