"""Compression of vectors to product codes, assigned through memoised grid cells.

A vector's components become integers, the vector is cut into equal parts, and each part is
replaced by the index of the nearest entry of its position's codebook.  To find it, the part's
coarse grid cell is hashed and looked up in a memo.  The memo keeps, per cell, the entries that no
other entry dominates across the cell's box: an entry is out when its smallest distance to the box is
over the largest distance of some other entry.  Only the entries kept are evaluated, exactly, on the
part itself; so results equal a search of the whole codebook, ties to the lower index.

Codebooks start from the vectors of the smallest ids and follow Lloyd's rounds.  A task sums its parts
per entry before anything is shuffled; the codebooks, whose size does not depend on the rows, are all
that the driver sees.

Which rows take part: vectors that are neither null nor empty, of a length that the number of parts
divides and that equals the length of the first seed's, all of whose components are finite numbers of
at most ``LARGEST``.  Rows that repeat each count.  Ids order with nulls last, equal ids by their
vectors.  An empty table, or one without such a vector, gives no rows.  Other columns, whatever their
names, are not looked at.  An error beyond a long is null.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import looked_up, worker_store
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1e22  # components up to here keep sums within 38 digits
_CELLS_KEPT = 20_000  # cells that a worker remembers per part position
_STEP = 4096  # vectors worked on at a time


@dataclass
class Codebooks:
    """``books[part]`` lists the integer components of each entry."""

    books: list[list[tuple[int, ...]]]

    @property
    def width(self) -> int:
        return len(self.books[0][0])

    def digest(self) -> str:
        numbers = (str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def taking_part(rows: DataFrame, vector: str, parts: int = PARTS) -> DataFrame:
    """Rows whose vector can be coded, whatever its length."""
    usable = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    )
    whole = (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    return rows.where(F.coalesce(whole & usable, F.lit(False)))


def _integers(x: float, scale: int) -> int:
    return int(np.floor(scale * float(x)))


def _small(width: int, entries: int) -> int:
    """The largest magnitude for which distances times entries stay within a long."""
    return int((2**60 / (width * max(entries, 1))) ** 0.5 / 2)


class CellMemo:
    """The undominated entries of grid cells met so far, for one part position.

    ``shift`` is the binary logarithm of a cell's side.  A cell is found by its hash and
    recognised by its coordinates; a cell whose hash another cell holds is worked out anew.
    """

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1).astype(float)
        np.fill_diagonal(gaps, np.inf)
        near = gaps.min(1)
        near = near[np.isfinite(near) & (near > 0)]
        side = float(np.sqrt(np.median(near))) / 2 if len(near) else 1.0
        self.shift = max(0, int(np.log2(max(side, 1.0))))
        self.odd = np.array(
            [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(book.shape[1])],
            dtype=np.uint64,
        )
        self.evaluated = 0
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, self.book.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.book)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries may be the nearest of a point in its box."""
        low = cells << self.shift
        high = low + (1 << self.shift) - 1
        out = np.empty((len(cells), len(self.book)), bool)
        for at in range(0, len(cells), 512):
            below = low[at : at + 512, None, :] - self.book
            above = self.book - high[at : at + 512, None, :]
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(-1)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(-1)
            out[at : at + 512] = least <= most.min(1)[:, None]
        return out

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """The undominated entries of each row's cell, remembered or worked out."""
        hashes = (cells.astype(np.uint64) * self.odd).sum(1, dtype=np.uint64)
        if len(self.hashes) > _CELLS_KEPT:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            new, first = np.unique(hashes[~known], return_index=True)
            fresh = cells[~known][first]
            self.hashes = np.concatenate([self.hashes, new])
            self.cells = np.concatenate([self.cells, fresh])
            self.open = np.concatenate([self.open, self.undominated(fresh)])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.cells, self.open = (
                self.hashes[order], self.cells[order], self.open[order]
            )
            at = np.searchsorted(self.hashes, hashes)
        found = self.open[at]
        other = (self.cells[at] != cells).any(1)
        if other.any():
            found[other] = self.undominated(cells[other])
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance."""
        open_here = self.candidates(points >> self.shift)
        row, entry = np.nonzero(open_here)
        self.evaluated += len(row)
        far = ((points[row] - self.book[entry]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(points)))
        # One number orders by distance, then by index.
        best = np.minimum.reduceat(far * len(self.book) + entry, first)
        return best % len(self.book), best // len(self.book)


def _plain_nearest(points: np.ndarray, book: list[tuple[int, ...]]) -> tuple[list, list]:
    """As :meth:`CellMemo.nearest`, in integers of any size."""
    codes, errors = [], []
    for point in points.tolist():
        far = [sum((x - e) ** 2 for x, e in zip(point, entry, strict=True)) for entry in book]
        errors.append(min(far))
        codes.append(far.index(errors[-1]))
    return codes, errors


class Coder:
    """Assigns parts to entries; one memo per part position."""

    def __init__(self, found: Codebooks) -> None:
        self.found = found
        limit = _small(found.width, len(found.books[0]))
        self.limit = limit
        self.memos = [
            CellMemo(np.array(book, np.int64))
            if all(abs(x) <= limit for entry in book for x in entry)
            else None
            for book in found.books
        ]

    def assign(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of vectors, given as whole numbers in doubles, by part."""
        width, parts = self.found.width, len(self.found.books)
        codes = np.zeros((len(whole), parts), np.int64)
        errors = np.zeros((len(whole), parts), object)
        for p in range(parts):
            part = whole[:, p * width : (p + 1) * width]
            fits = (np.abs(part) <= self.limit).all(1)
            memo = self.memos[p]
            if memo is None:
                fits[:] = False
            if fits.any():
                codes[fits, p], errors[fits, p] = memo.nearest(part[fits].astype(np.int64))
            if not fits.all():
                large = exact(part[~fits])
                codes[~fits, p], errors[~fits, p] = _plain_nearest(large, self.found.books[p])
        return codes, errors


def exact(whole: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, as Python integers."""
    return np.frompyfunc(int, 1, 1)(whole)


def _coder(found: Codebooks) -> Coder:
    """The worker's coder for these codebooks; what it remembers serves later tasks."""
    kept = worker_store("vector_coder", dict)
    key = found.digest()
    if key not in kept:
        kept.clear()
        kept[key] = Coder(found)
    return kept[key]


def _vectors(column: pa.Array, scale: int) -> np.ndarray:
    """List cells of equal length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


_SUMS = "part int, entry int, n long, sums array<decimal(38,0)>"


def _sums(rows: DataFrame, vector: str, found: Codebooks, scale: int) -> DataFrame:
    """Per task, part position and entry: the parts assigned to it and their sums."""
    parts, entries, width = len(found.books), len(found.books[0]), found.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(found)
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                whole = _vectors(batch.column(0).slice(at, _STEP), scale)
                codes, _ = coder.assign(whole)
                small = np.abs(whole).max() <= coder.limit
                numbers = whole.astype(np.int64) if small else exact(whole)
                for p in range(parts):
                    here = np.zeros((entries, width), numbers.dtype)
                    np.add.at(here, codes[:, p], numbers[:, p * width : (p + 1) * width])
                    total[p] += here
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        lists = [[int(x) for x in total[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(count[part, entry]),
                pa.array(lists, pa.list_(pa.decimal128(38, 0))),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return rows.select(vector).mapInArrow(add, _SUMS)


def learn(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks of all rows; None when no vector takes part."""
    usable = taking_part(rows, vector, parts).select(id, vector)
    seeds = usable.orderBy(F.col(id).asc_nulls_last(), vector)
    first = seeds.select(vector).limit(1).collect()
    if not first:
        return None
    size = len(first[0][0])
    equal = usable.where(F.size(vector) == size)
    chosen = equal.orderBy(F.col(id).asc_nulls_last(), vector).limit(entries).collect()
    width = size // parts
    books = [
        [tuple(_integers(x, scale) for x in r[1][p * width : (p + 1) * width]) for r in chosen]
        for p in range(parts)
    ]
    found = Codebooks(books)
    for _ in range(rounds):
        cells = _sums(equal, vector, found, scale).select(
            "part", "entry", "n", F.posexplode("sums").alias("position", "value")
        )
        # One row per part, entry and position, however many vectors there are.
        totals = (
            cells.groupBy("part", "entry", "position")
            .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
            .collect()
        )
        moved = [[list(entry) for entry in book] for book in found.books]
        for part, entry, position, n, value in totals:
            moved[part][entry][position] = int(value) // n
        found = Codebooks([[tuple(e) for e in book] for book in moved])
    return found


def encode(
    rows: DataFrame,
    found: Codebooks | None,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``id``, ``label``, ``code`` (array of indices) and ``error`` of every row that takes part."""
    names = [f.name for f in rows.select(id, label).schema.fields]
    kinds = [f.dataType.simpleString() for f in rows.select(id, label).schema.fields]
    schema = f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, code array<int>, error long"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, top = found.width * len(found.books), 2**63
    equal = taking_part(rows, vector, len(found.books)).where(F.size(vector) == size)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(found)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                here = batch.slice(at, _STEP)
                codes, errors = coder.assign(_vectors(here.column(2), scale))
                sums = [x if x < top else None for x in errors.sum(1).tolist()]
                lists = pa.ListArray.from_arrays(
                    np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1],
                    codes.astype(np.int32).ravel(),
                )
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(1), lists, pa.array(sums, pa.int64())],
                    names=[*names, "code", "error"],
                )

    return equal.select(id, label, vector).mapInArrow(code, schema)


def decode(codes: DataFrame, found: Codebooks, code: str = "code", to: str = "vector") -> DataFrame:
    """``codes`` with the integer vector that each code stands for, from the codebooks alone."""
    books = F.array(
        *[
            F.array(*[F.array(*[F.lit(x).cast("decimal(38,0)") for x in e]) for e in book])
            for book in found.books
        ]
    )
    parts = F.transform(F.col(code), lambda c, p: books[p][c])
    return codes.withColumn(to, F.flatten(parts))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of a label, nulls together, added up.

    A label's errors are added map-side first; labels of many rows are looked up from a broadcast.
    """
    key = F.when(F.col(label).isNull(), "").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    keyed = cut_lineage(coded.withColumn("_label", key))
    sums = keyed.groupBy("_label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"),
        F.count(F.lit(1)).alias("_rows"),
    )
    sums = sums.withColumn("label_error", F.expr("try_cast(label_error as long)"))
    return looked_up(keyed, sums, "_label", "_rows", keyed.count()).drop("_label")


def hexadecimal(code: str = "code") -> F.Column:
    """Codes of at most 256 entries as two lower-case digits each."""
    digits = F.transform(F.col(code), lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return F.array_join(digits, "")
