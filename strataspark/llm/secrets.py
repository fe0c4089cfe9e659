"""Secret scans with corpus-wide ownership frequency, by DataFrame functions only.

Every whole text is searched for candidates of several kinds.  Where a candidate starts follows
from the lengths of the pieces between the matches.  Candidates' hashes are then counted over the
corpus by distinct repositories and owners: what many owners hold, or very many repositories of
few owners, is a copied example; what few hold and what looks random is a live-looking credential.

An ``assign`` candidate's place is the whole match, from the name to the end of the value; its hash
and its looks are the value's alone.

Base kinds (``assign``, ``access``, ``hex``) are always reported.  ``vendor`` holds keys with a
vendor's prefix and is always reported too.  ``opaque`` holds long mixed strings, reported only
when their ownership makes them live-looking.

Null and empty texts have no candidates.  Null owners and repositories count as one owner or
repository named by an empty string.  Rows that repeat are each reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import looked_up
from strataspark.session import cut_lineage

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int = 0  # the credential within a match
    least: int = 0  # characters it needs


#: In the order in which kinds of the same start are listed.
KINDS = (
    Kind("assign", ASSIGN, 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal, so shorter ones cannot hide longer ones.
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
    Kind(
        "vendor",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
        r"|sk_live_[0-9A-Za-z]{24,}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
    ),
    Kind("opaque", r"[A-Za-z0-9+/_-]{24,}={0,2}"),
)
BASE_KINDS = 3
WIDE_OWNERS = 4  # owners from which a credential is a copied example
WIDE_REPOSITORIES = 12  # repositories from which it is one, however few own them
LIVE_SYMBOLS = 8  # different characters that a live-looking credential has at least

#: Of each reported candidate, how many distinct owners and repositories hold it.
COUNTS = ("owners", "repositories")

_FOUND = "array<struct<start:bigint,kind:int,end:bigint,hash:string,random:boolean>>"


def _size(x: Column) -> Column:
    return F.length(x).cast("long")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``found``: all candidates by start, then kind."""
    for n, kind in enumerate(KINDS):
        whole = F.coalesce(F.col(text), F.lit(""))
        docs = docs.withColumn(
            f"_m{n}", F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))
        ).withColumn(
            f"_p{n}", F.when(F.size(f"_m{n}") > 0, F.split(whole, kind.pattern, -1))
        )
    parts = []
    for n, kind in enumerate(KINDS):
        pairs = F.zip_with(
            F.slice(f"_p{n}", 1, F.size(f"_m{n}")),
            f"_m{n}",
            lambda piece, match: F.struct(_size(piece).alias("gap"), match.alias("match")),
        )

        def add(state: Column, x: Column) -> Column:
            value = (
                F.regexp_extract(x["match"], kind.pattern, kind.group)
                if kind.group
                else x["match"]
            )
            start = state["at"] + x["gap"]
            end = start + _size(x["match"])
            symbols = F.size(F.array_distinct(F.split(value, "")))
            mixed = F.lit(True)
            if kind.name == "opaque":
                mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            one = F.struct(
                start.alias("start"),
                F.lit(n).alias("kind"),
                end.alias("end"),
                F.sha2(value, 256).alias("hash"),
                (symbols >= LIVE_SYMBOLS).alias("random"),
            )
            keep = (F.length(value) >= kind.least) & mixed
            out = F.when(keep, F.concat(state["out"], F.array(one))).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("out"))
        parts.append(
            F.when(
                F.size(f"_m{n}") > 0, F.aggregate(pairs, nothing, add, lambda s: s["out"])
            ).otherwise(F.array().cast(_FOUND))
        )
    helpers = [f"_{c}{n}" for n in range(len(KINDS)) for c in "mp"]
    return docs.withColumn("found", F.array_sort(F.concat(*parts))).drop(text, *helpers)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """Rows, distinct repositories and owners by candidate ``hash``.

    Repeated (hash, repository, owner) triples combine map-side before the shuffle.
    """
    return (
        found.select(
            F.explode("found.hash").alias("hash"),
            F.coalesce(F.col(repository), F.lit("")).alias("repository"),
            F.coalesce(F.col(owner), F.lit("")).alias("owner"),
        )
        .groupBy("hash", "repository", "owner")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"), F.sum("copies").alias("copies"))
        .groupBy("hash")
        .agg(
            F.sum("copies").alias("copies"),
            F.count(F.lit(1)).alias("owners"),
            F.sum("repositories").alias("repositories"),
        )
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an ordered array of candidates, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = F.transform(
        spans,
        lambda s: F.concat_ws(
            ":",
            F.get(names, s["kind"]),
            s["start"].cast("string"),
            s["end"].cast("string"),
        ),
    )
    return F.array_join(one, ",")


def any_candidate(text: Column) -> Column:
    """Whether a text may hold a candidate; false means that it holds none."""
    hit = F.lit(False)
    for kind in KINDS:
        hit = hit | F.coalesce(text, F.lit("")).rlike(kind.pattern)
    return hit


def verdicts(found: DataFrame, key: str, repository: str, owner: str) -> DataFrame:
    """Distinct ``(_key, _found, verdicts, owners, repositories)`` of rows with candidates.

    A verdict is ``example`` (at least ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES`` repositories
    hold the candidate), ``live`` or ``unsure``.  Only candidates and keys are shuffled, never texts.
    """
    known = cut_lineage(ownership(found, repository, owner))
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # Rows that repeat share one cell.
    cells = found.select(F.col(key).alias("_key"), F.col("found").alias("_found")).distinct()
    each = cells.select("*", F.posexplode("_found").alias("_at", "_one")).select(
        "_key", "_found", "_at", F.col("_one.hash").alias("hash")
    )
    held = known.select("hash", "owners", "repositories", "copies")
    counted = looked_up(each, held, "hash", "copies", total)
    listed = counted.groupBy("_key", "_found").agg(
        F.array_sort(F.collect_list(F.struct("_at", "owners", "repositories"))).alias("_listed")
    )
    verdict = F.zip_with(
        "_found",
        "_listed",
        lambda s, n: F.when(
            (n["owners"] >= WIDE_OWNERS) | (n["repositories"] >= WIDE_REPOSITORIES), "example"
        )
        .when(s["random"], "live")
        .otherwise("unsure"),
    )
    counts = [F.col(f"_listed.{c}").alias(c) for c in COUNTS]
    return listed.select("_key", "_found", verdict.alias("verdicts"), *counts)


def judged(found: DataFrame, key: str, repository: str, owner: str) -> DataFrame:
    """``found`` with ``verdicts``; opaque candidates stay only if they are live-looking."""
    opaque = len(KINDS) - 1
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("found") == F.col("_found"))
    both = F.filter(
        F.arrays_zip("found", "verdicts", *COUNTS),
        lambda x: (x["found"]["kind"] != opaque) | (x["verdicts"] == "live"),
    )
    return (
        found.join(verdicts(found, key, repository, owner), same)
        .withColumn("_both", both)
        .withColumns({c: F.col("_both").getField(c) for c in ("found", "verdicts", *COUNTS)})
        .drop("_both", "_key", "_found")
    )


def scan(docs: DataFrame, key: str, repository: str, owner: str, text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``key``, ``found``, ``verdicts``, ``owners`` and ``repositories``.

    ``found`` is the ordered array of reported candidates; the other arrays have one item for each.
    """
    rows = docs.select(
        F.col(key).alias("_id"),
        F.col(repository).cast("string").alias("_repository"),
        F.col(owner).cast("string").alias("_owner"),
        F.col(text).alias("_text"),
    )
    found = cut_lineage(candidates(rows, "_text"))
    some = judged(found.where(F.size("found") > 0), "_id", "_repository", "_owner")
    nothing = {c: F.array().cast("array<bigint>") for c in COUNTS}
    none = found.where(F.size("found") == 0).withColumns(
        {"verdicts": F.array().cast("array<string>"), **nothing}
    )
    columns = [F.col("_id").alias(key), "found", "verdicts", *COUNTS]
    return some.select(*columns).unionByName(none.select(*columns))


def redact(
    docs: DataFrame, key: str, repository: str, owner: str, text: str = "text", to: str = "[secret]"
) -> DataFrame:
    """``docs`` with live-looking credentials replaced by ``to``; examples stay.

    Only texts that hold a candidate are joined with their verdicts.
    """
    # Rows travel as one struct, so that no column of theirs can clash with those used here.
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(text).alias("_text"),
        F.col(text).alias("_whole"),
        F.col(key).alias("_id"),
        F.col(repository).cast("string").alias("_repository"),
        F.col(owner).cast("string").alias("_owner"),
    )
    holds = any_candidate(F.col("_text"))
    found = cut_lineage(candidates(rows.where(holds), "_text"))
    some = judged(found.where(F.size("found") > 0), "_id", "_repository", "_owner")
    live = F.filter(
        F.arrays_zip("found", "verdicts"), lambda x: x["verdicts"] == F.lit("live")
    )
    whole = F.col("_whole")

    def cut(state: Column, x: Column) -> Column:
        s = x["found"]
        # Candidates of several kinds may overlap: what is already replaced is skipped.
        gap = F.greatest(s["start"] - state["at"], F.lit(0))
        before = F.substring(whole, (state["at"] + 1).cast("int"), gap.cast("int"))
        mark = F.when(s["start"] >= state["at"], F.lit(to)).otherwise(F.lit(""))
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"),
            F.concat(state["out"], before, mark).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(
            state["out"], F.substring(whole, (state["at"] + 1).cast("int"), F.length(whole))
        )

    cleaned = some.withColumn("_live", live).withColumn(
        "_clean",
        F.when(F.size("_live") > 0, F.aggregate("_live", start, cut, rest)).otherwise(whole),
    )
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    replaced = [F.col("_clean").alias(c) if c == text else x for c, x in zip(docs.columns, columns)]
    return (
        rows.where(~holds)
        .select(*columns)
        .unionByName(cleaned.select(*replaced))
        .unionByName(found.where(F.size("found") == 0).select(*columns))
    )


def of_kind(kind: int) -> Column:
    return F.filter("found", lambda s: s["kind"] == kind)


def base(found: str = "found") -> Column:
    return F.filter(found, lambda s: s["kind"] < BASE_KINDS)
