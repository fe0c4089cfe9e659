"""Rule files in INI form as a table, and as the scalars of a run."""

from __future__ import annotations

import logging
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import strip_quotes
from strataspark.plans.rules import MapRules
from strataspark.sources.paths import path_exists

log = logging.getLogger(__name__)

# Sections and keys of a rule file.
EXCEPTIONS, RECHECK, PROJECTS = "exceptions", "recheck", "projects"
DECLINATION, DECLINATION_VALUE = "declination", "declination_value"
BOUNDS, EPSG = "bounds", "epsg"
XMIN, YMIN, XMAX, YMAX = "xmin", "ymin", "xmax", "ymax"

_HEADER = r"^\s*\[(.+)\]"


def _stripped(column: Column) -> Column:
    """Without any white space around it; ``trim`` knows blanks only."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def parse_rules(texts: DataFrame) -> DataFrame:
    """Rules of whole files ``file, text``.

    ``file, line, section, key, value`` with 1-based lines.  Keys keep their
    case; a key without ``=`` or ``:`` has a NULL value; full-line comments
    (``#``, ``;``) are left out.  A section's header gives a row without key,
    so that empty sections show.  A file is cut at its headers inside its row:
    many files spread, and none needs a shuffle.
    """
    blocks = F.split("text", r"(?m)(?=^[ \t]*\[)")
    counts = F.transform(blocks, lambda b: F.regexp_count(b, F.lit("\n")))
    numbered = F.transform(
        blocks,
        lambda b, i: F.struct(
            b.alias("block"),
            F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("before"),
        ),
    )
    lines = texts.select("file", F.explode(numbered).alias("b")).select(
        "file",
        F.col("b.before").alias("before"),
        F.regexp_extract("b.block", _HEADER, 1).alias("section"),
        F.posexplode(F.split("b.block", r"\r?\n")).alias("at", "raw"),
    )
    entry = _stripped(F.col("raw"))
    header = entry.rlike(_HEADER)
    cut = F.regexp_instr(entry, F.lit("[=:]"))
    key = F.when(cut > 0, _stripped(F.substr(entry, F.lit(1), cut - 1))).otherwise(entry)
    value = F.when(cut > 0, _stripped(F.substr(entry, cut + 1)))
    return lines.where(
        (F.col("section") != "") & (entry != "") & ~entry.rlike("^[#;]")
    ).select(
        "file",
        (F.col("before") + F.col("at") + 1).cast("int").alias("line"),
        "section",
        F.when(~header, key).alias("key"),
        F.when(~header, value).alias("value"),
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules table of a file or of a folder of files."""
    texts = spark.read.text(path, wholetext=True)
    return parse_rules(
        texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    )


def repeated_rules(rules: DataFrame) -> DataFrame:
    """Keys (or, without key, sections) given twice in one file."""
    return (
        rules.groupBy("file", "section", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def project_names(rules: DataFrame) -> DataFrame:
    """Projects as ``file, PROJECT``, without quote characters."""
    wanted = (F.col("section") == PROJECTS) & F.col("key").isNotNull()
    return rules.where(wanted).select("file", strip_quotes(F.col("key")).alias("PROJECT"))


def rule_scalars(rules: DataFrame) -> DataFrame:
    """One row per file: declination and box, parsed.

    ``file, has_declination, declination, bounds_epsg, xmin, ymin, xmax, ymax``.
    The box counts only when all five of its values parse; otherwise all five
    are NULL.
    """

    def of(section: str, key: str):
        here = (F.col("section") == section) & (F.col("key") == key)
        return F.max(F.when(here, F.col("value")))

    pivoted = rules.groupBy("file").agg(
        F.bool_or(F.col("section") == DECLINATION).alias("has_declination"),
        of(DECLINATION, DECLINATION_VALUE).try_cast("double").alias("declination"),
        of(BOUNDS, EPSG).try_cast("int").alias("bounds_epsg"),
        *[of(BOUNDS, k).try_cast("double").alias(k) for k in (XMIN, YMIN, XMAX, YMAX)],
    )
    box = ["bounds_epsg", XMIN, YMIN, XMAX, YMAX]
    whole = F.lit(True)
    for name in box:
        whole = whole & F.col(name).isNotNull()
    return pivoted.select(
        "file",
        "has_declination",
        F.when(F.col("has_declination"), F.col("declination"))
        .otherwise(F.lit(0.0))
        .alias("declination"),
        *[F.when(whole, F.col(c)).alias(c) for c in box],
    )


def exceptions(rules: DataFrame) -> DataFrame:
    """The replaced keys as ``key, value``; without a value a key links nothing."""
    listed = (F.col("section") == EXCEPTIONS) & F.col("key").isNotNull()
    return rules.where(listed).select("key", "value")


def rechecks(rules: DataFrame) -> DataFrame:
    """The ids to check again as ``key``."""
    listed = (F.col("section") == RECHECK) & F.col("key").isNotNull()
    return rules.where(listed).select("key")


def load_rules(spark: SparkSession, path: str | None, as_tables: bool = False) -> MapRules:
    """The rules of one file; no file means defaults.

    Exceptions and rechecks are gathered in the driver, or stay tables with ``as_tables``, however
    many there are.

    Whether there is one, the path's own file system says.  A folder of several
    files raises: each of them is a rule set of its own.
    A declination section without a usable value, and a key or section given
    twice, raise.  A box that does not parse is logged and left out.
    """
    if path is None or not path_exists(spark, path):
        return MapRules()
    rules = read_rules(spark, path)
    files = [r["file"] for r in rules.select("file").distinct().limit(2).collect()]
    if len(files) > 1:
        raise ValueError(f"{path} holds several rule files, among them {files}")
    repeated = repeated_rules(rules).limit(20).collect()
    if repeated:
        raise ValueError(f"given twice in {path}, among others: {repeated}")
    scalars = rule_scalars(rules).first()
    if scalars is None:
        return MapRules()
    if scalars["declination"] is None:
        raise KeyError(DECLINATION_VALUE)
    bounds = None
    if scalars["bounds_epsg"] is not None:
        bounds = (scalars[XMIN], scalars[YMIN], scalars[XMAX], scalars[YMAX])
    elif not rules.where(F.col("section") == BOUNDS).isEmpty():
        log.error("bounds of %s do not parse and are left out", path)
    projects = [r["PROJECT"] for r in project_names(rules).collect()]
    listed, again = exceptions(rules), rechecks(rules)
    if not as_tables:
        listed = {r["key"]: r["value"] for r in listed.collect()}
        again = tuple(r["key"] for r in rechecks(rules.orderBy("line")).collect())
    return MapRules(
        projects=tuple(projects),
        bounds=bounds,
        bounds_epsg=scalars["bounds_epsg"],
        declination=scalars["declination"],
        exceptions=listed,
        rechecks=again,
    )
