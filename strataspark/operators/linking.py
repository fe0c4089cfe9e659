"""Linking child rows to observations.

Every link is an equi-join on the source and a key, followed by an aggregate
whose keys differ from the join's.  So a source or key that holds a large part
of all rows is split by adaptive execution in the join and reduced map-side
before the next shuffle.  When the selected observations are small enough to
broadcast, child tables are filtered where they are scanned; otherwise a filter of
the wanted keys keeps most rows that match nothing out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.functions.text import quoted_literal
from strataspark.operators.validation import require_tables
from strataspark.session import BROADCAST_BYTES, filter_words, kept, measured, through_filter

#: What is looked up in place of a key: from the driver, or a table ``key, value``.
Exceptions = Mapping[str, str | None] | DataFrame
# A map of exceptions up to this size is a literal in the plan, beyond it a table.
_LITERAL_ENTRIES = 256
# Row ids per group when an ordered list is put together in pieces.
PIECE = 1 << 14


def remap_key(df: DataFrame, key: str, exceptions: Exceptions, to: str) -> DataFrame:
    """Add ``to``: the key, or what the exceptions say in its place.

    One hop only.  A key listed without a value becomes NULL and links nothing.  A table of
    exceptions stays distributed: it is joined by key, and Spark picks the way by its size.
    """
    if isinstance(exceptions, DataFrame):
        return _remapped(df, key, exceptions, to)
    if not exceptions:
        return df.withColumn(to, F.col(key))
    if len(exceptions) <= _LITERAL_ENTRIES:
        entries = [F.lit(v).cast("string") for pair in exceptions.items() for v in pair]
        table = F.create_map(*entries)
        listed = F.map_contains_key(table, F.col(key))
        return df.withColumn(to, F.when(listed, table[F.col(key)]).otherwise(F.col(key)))
    rows = df.sparkSession.createDataFrame(list(exceptions.items()), "key string, value string")
    return _remapped(df, key, rows, to)


def _remapped(df: DataFrame, key: str, exceptions: DataFrame, to: str) -> DataFrame:
    rows = exceptions.select(
        F.col("key").alias(key), F.col("value").alias("_replacement"), F.lit(True).alias("_listed")
    )
    return (
        df.join(rows, key, "left")
        .withColumn(
            to, F.when(F.col("_listed"), F.col("_replacement")).otherwise(F.col(key))
        )
        .drop("_listed", "_replacement")
    )


def resolve_tectonic(tectonics: DataFrame, keys: list[str], order: str = m.RID) -> DataFrame:
    """One tectonic id per group of ``keys``: the one that first appears last.

    Returns ``keys, GDB_ID, n_ids``.  An id seen again later does not move.
    ``n_ids`` counts distinct ids, NULL included; above one it marks a group
    worth reporting.
    """
    first_seen = tectonics.groupBy(*keys, "GDB_ID").agg(F.min(order).alias("_first"))
    return first_seen.groupBy(*keys).agg(
        F.max_by("GDB_ID", "_first").alias("GDB_ID"), F.count(F.lit(1)).alias("n_ids")
    )


def first_distinct(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Distinct rows over ``keys`` with the least ``order`` as ``_rid``."""
    return df.groupBy(*keys).agg(F.min(order).alias(m.RID))


def piece_of(order: list[str]) -> Column:
    """Which piece of its group a row belongs to, as two numbers.

    A piece spans a range of row ids; under two order columns the first stays
    whole, so the pieces' own order is always the order of their rows.
    """
    last = F.floor(F.col(order[-1]) / PIECE).cast("long")
    lead, rest = (F.col(order[0]), last) if len(order) > 1 else (last, F.lit(0).cast("long"))
    return F.struct(lead.alias("p1"), rest.alias("p2"))


def group_by_piece(df: DataFrame, keys: list[str]) -> GroupedData:
    """Group by the keys and the row's ``_block``, as one struct ``_g``.

    One struct, not several columns: Spark would otherwise reuse a partitioning
    by the keys alone and put all pieces of a large group into one task.
    """
    return df.groupBy(F.struct(*keys, "_block").alias("_g"))


def sorted_items(order: list[str], value: Column) -> Column:
    """Aggregate: the values of a piece as an array in row order."""
    item = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"])


def joined_list(
    df: DataFrame, keys: list[str], order: list[str], value: Column, sep: str, to: str
) -> DataFrame:
    """One string per group: values in order, joined; ``_n`` counts them.

    Pieces are joined where they were sorted, so the last step only
    concatenates texts.
    """
    rows = df.withColumn("_block", piece_of(order))
    grouped = group_by_piece(rows, keys).agg(sorted_items(order, value).alias("items"))
    pieces = grouped.select(
        *[F.col("_g")[k].alias(k) for k in keys],
        F.struct(
            F.col("_g")["_block"].alias("block"),
            F.array_join("items", sep).alias("text"),
            F.size("items").alias("n"),
        ).alias("_piece"),
    )
    return (
        pieces.groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
        .select(
            *keys,
            F.array_join(F.transform("_pieces", lambda p: p["text"]), sep).alias(to),
            F.aggregate(
                "_pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]
            ).alias("_n"),
        )
    )


def texture_tuples(textures: DataFrame) -> DataFrame:
    """All ``ST_2`` of a rock as tuple text: ``_src, ROP_GID, ST_2``.

    Row order, repeats kept, NULL as ``None``, a lone value with a comma.
    """
    listed = joined_list(
        textures.where(F.col("ROP_GID").isNotNull()),
        [m.SRC, "ROP_GID"],
        [m.RID],
        quoted_literal(F.col("ST_2")),
        ", ",
        "_text",
    )
    tail = F.when(F.col("_n") == 1, ",)").otherwise(")")
    return listed.select(m.SRC, "ROP_GID", F.concat(F.lit("("), "_text", tail).alias("ST_2"))


@dataclass(frozen=True)
class Linker:
    """Links the children of one model to one set of observations.

    ``observations`` come from :func:`~.selection.observation_keys`.  ``small``
    says that their measured size allows a broadcast; ``count`` is how many they are, where
    that was measured.  ``resolved`` may hold :meth:`resolutions` already computed.
    """

    model: m.FieldModel
    observations: DataFrame
    exceptions: Exceptions
    small: bool
    resolved: DataFrame | None = None
    count: int | None = None

    @classmethod
    def over(
        cls,
        model: m.FieldModel,
        observations: DataFrame,
        exceptions: Exceptions | None = None,
    ) -> Linker:
        """Measure the observations, then link with the matching strategy.

        The observations and what they resolve to are kept in memory and on disk, as
        every link needs them; measuring fills the former.  A lost executor only means
        that its part is computed again.  :meth:`release` lets go of them.
        """
        require_tables(model)
        own = kept(observations)
        listed = {} if exceptions is None else exceptions
        size, count = measured(own)
        linker = cls(model, own, listed, size <= BROADCAST_BYTES, count=count)
        return replace(linker, resolved=kept(linker.resolutions()))

    @cached_property
    def narrowed(self) -> Linker:
        """The same links, whose rows name their observation and nothing else of it.

        Links move observations once per child table, and every linked row takes theirs along, so
        this moves less where only ids are asked for.  Rows that are distinct stay so as long as
        ``OBSID``, source and row id tell observations apart.
        """
        names = ["OBSID", m.SRC, m.OBS_RID]
        resolved = self.resolutions().select(*names, "GDB_ID", "n_ids")
        return replace(self, observations=self.observations.select(*names), resolved=resolved)

    def release(self) -> None:
        """Let go of what :meth:`over` and the links have kept."""
        linkers = [own for own in (self, self.__dict__.get("narrowed")) if own is not None]
        rocks = [linker.__dict__.get("_rock_rows") for linker in linkers]
        filters = [words for linker in linkers for words in linker._filters.values()]
        for own in (self.observations, self.resolved, *rocks, *filters):
            if own is not None:
                own.unpersist()

    @property
    def _attributes(self) -> list[str]:
        return self.observations.columns

    def _hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    @cached_property
    def _filters(self) -> dict[str, DataFrame | None]:
        """The filters of wanted keys that links have made so far, kept, by what their keys are."""
        return {}

    def _wanted(
        self, child: DataFrame, on: list[str], keys: DataFrame, count: int, of: str
    ) -> DataFrame:
        """A child's rows without most of those whose key is none of ``keys``.

        All links on the same keys share one filter; ``of`` names them.
        """
        if of not in self._filters:
            words = filter_words(keys, on, count)
            self._filters[of] = None if words is None else kept(words)
        words = self._filters[of]
        return child if words is None else through_filter(child, on, words, count)

    def _keyed(self, source: str, to: str, remapped: bool) -> DataFrame:
        exceptions = self.exceptions if remapped else {}
        return remap_key(self.observations, source, exceptions, to)

    def _children(self, child: DataFrame, key: str, remapped: bool) -> DataFrame:
        """Inner join of a child table to the observations on ``(_src, key)``."""
        parents = self._keyed("OBSID", "_key", remapped)
        on = [m.SRC, "_key"]
        rows = child.withColumnRenamed(key, "_key")
        if not self.small and self.count is not None:
            rows = self._wanted(rows, on, parents, self.count, "remapped" if remapped else "own")
        return rows.join(self._hint(parents), on)

    def resolutions(self) -> DataFrame:
        """Observations with tectonic rows: the id they resolve to, NULL included, and ``n_ids``."""
        if self.resolved is not None:
            return self.resolved
        linked = self._children(self.model.tectonics, "OBSID", remapped=True)
        return resolve_tectonic(linked, self._attributes)

    def tectonic_ids(self) -> DataFrame:
        """Observations that resolve to a tectonic id, with it as ``GDB_ID``."""
        return self.resolutions().where(F.col("GDB_ID").isNotNull())

    def ambiguous_observations(self) -> DataFrame:
        """Observations with several tectonic ids, and which one was taken."""
        found = self.resolutions().where("n_ids > 1")
        return found.select("OBSID", m.SRC, m.OBS_RID, "GDB_ID", "n_ids")

    def _measured(self, child: DataFrame, kind: str) -> DataFrame:
        resolved = self.tectonic_ids().select(
            *self._attributes, F.col("GDB_ID").alias("TM_GID")
        )
        # At most one row per observation, so the observations' bound holds.
        on = [m.SRC, "TM_GID"]
        if not self.small and self.count is not None:
            child = self._wanted(child, on, resolved, self.count, "tectonic")
        return self._distinct(child.join(self._hint(resolved), on), kind)

    def _distinct(self, rows: DataFrame, kind: str, order: Column | None = None) -> DataFrame:
        own = self._child_columns(kind)
        keys = [c for c in self._attributes if c not in own]
        return first_distinct(rows, [*keys, *own], F.col(m.RID) if order is None else order)

    @staticmethod
    def _child_columns(kind: str) -> list[str]:
        return list(m.CHILD_COLUMNS[kind])

    def planars(self) -> DataFrame:
        """Planar structures of each observation's tectonic id."""
        return self._measured(self.model.planars, m.PLANARS)

    def linears(self) -> DataFrame:
        """Linear structures of each observation's tectonic id."""
        return self._measured(self.model.linears, m.LINEARS)

    def images(self) -> DataFrame:
        """Images taken at each observation."""
        return self._distinct(self._children(self.model.images, "OBSID", False), m.IMAGES)

    def samples(self) -> DataFrame:
        """Samples taken at each observation."""
        return self._distinct(self._children(self.model.samples, "OBSID", True), m.SAMPLES)

    def required_rows(self, with_images: bool) -> dict[str, DataFrame]:
        """The rows of this run that must hold certain values, by table."""
        own = self.observations.select(
            m.SRC, F.col(m.OBS_RID).alias(m.RID), "OBSID", F.col("OBS_REMARKS").alias("REMARKS"), "PROJECT"
        )
        found = {m.OBSERVATION: own, m.ROCK: self._children(self.model.rocks, "OBSID", False)}
        if with_images:
            found[m.IMAGE] = self._children(self.model.images, "OBSID", False)
        return found

    @cached_property
    def _rock_rows(self) -> DataFrame:
        """Rocks of the observations with the id that leads to their textures, kept."""
        rows = self._children(self.model.rocks, "OBSID", False)
        keyed = remap_key(rows, "GDB_ID", self.exceptions, "ROP_GID").drop("_key")
        return kept(keyed)

    @cached_property
    def _few_rocks(self) -> bool:
        """Whether the rocks are few enough to broadcast; measured on the kept rows."""
        return self.small and self._rock_size[0] <= BROADCAST_BYTES

    @cached_property
    def _rock_size(self) -> tuple[int, int]:
        """Bytes and number of the kept rocks."""
        return measured(self._rock_rows)

    def _wanted_textures(self) -> DataFrame:
        """Textures without most of those that belong to none of the rocks."""
        textures = self.model.textures
        if self._few_rocks or self.count is None:
            return textures
        on = [m.SRC, "ROP_GID"]
        return self._wanted(textures, on, self._rock_rows, self._rock_size[1], "rocks")

    def _rock_hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self._few_rocks else df

    def rocks(self) -> DataFrame:
        """Rock observations with their textures as tuple text in ``ST_2``."""
        rows = self._rock_rows
        wanted = self._rock_hint(rows.select(m.SRC, "ROP_GID").distinct())
        textures = self._wanted_textures().join(wanted, [m.SRC, "ROP_GID"], "left_semi")
        tuples = texture_tuples(textures)
        return self._distinct(rows.join(tuples, [m.SRC, "ROP_GID"], "left"), m.ROCKS)

    def textures(self) -> DataFrame:
        """All textures of all rocks of each observation."""
        # Of rocks that lead to the same textures the first one counts, so rocks that share
        # an id are one row before the textures meet them.
        rows = (
            self._rock_rows
            .groupBy(*self._attributes, "ROP_GID")
            .agg(F.min(m.RID).alias("_rock_rid"))
        )
        linked = self._wanted_textures().join(self._rock_hint(rows), [m.SRC, "ROP_GID"])
        order = F.struct("_rock_rid", m.RID)
        return (
            self._distinct(linked, m.TEXTURES, order)
            .withColumn("_rid2", F.col(m.RID)[m.RID])
            .withColumn(m.RID, F.col(m.RID)["_rock_rid"])
        )

    def of_type(self, kind: str) -> DataFrame:
        """Child rows of one type, one row per distinct row and observation."""
        if kind not in m.ALL_TYPES:
            raise ValueError(f"unknown observation type {kind!r}; known are {m.ALL_TYPES}")
        builders = {
            m.PLANARS: self.planars,
            m.LINEARS: self.linears,
            m.ROCKS: self.rocks,
            m.IMAGES: self.images,
            m.SAMPLES: self.samples,
            m.TEXTURES: self.textures,
        }
        return builders[kind]()

    @staticmethod
    def order_columns(kind: str) -> list[str]:
        """Columns that order the rows of one observation."""
        return [m.RID, "_rid2"] if kind == m.TEXTURES else [m.RID]
