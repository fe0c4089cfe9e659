"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Bulk-synchronous best-fit.  Documents are cut into pieces; only those longer than a sequence are
cut.  Spark range-sorts the pieces by length and ranks them.  A round opens a share of the
sequences that the remaining tokens need, with the longest pieces; then gaps and pieces, both sorted by
descending size, are swept together: each gap takes the longest piece not longer than itself that
no larger gap has taken, so that equal wishes are settled by rank.  Gaps shrink and the sweep
repeats until nothing fits; what is left begins the next round, which keeps the gaps.

A piece has at most ``size`` tokens, so the sorted pieces and gaps are runs of equal sizes, and
all a sweep needs of them are run lengths: at most ``size`` counts, however many documents there
are.  These counts alone reach the driver.  The sweeps' matches, ranges of ranks to ranges of
sequences, go back to Spark, where each piece finds its sequence by its rank.

Null and empty texts are the end token alone.  Rows that repeat are packed each.  A null
``doc_id`` is kept.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import byte_ranges, text_bytes, words_in, worker_store
from strataspark.operators.points import with_row_index
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 2048
END = 0
OPENED = 8  # a round opens one of so many sequences that the remaining tokens need
_WORDS_KEPT = 600_000  # words whose ids a worker remembers
_RANGE = 1 << 22  # bytes of text whose words are numbered at a time
_HELD = 1 << 23  # bytes of text whose ids a worker holds at a time, or one text
# The bytes that part words.
_APART = np.zeros(256, bool)
_APART[list(b" \t\n\r\x0b\x0c")] = True

_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[\x21-\x7e]+")
_LATIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]"
    "|[^a-z0-9ß-öø-ÿ]+"
)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class WordIds(dict):
    """Ids (little-endian, four bytes each) by word, as the whole tokenizer gives them.

    The tokenizer drops white space, and nothing it does crosses it; so a text's ids are those of
    its words, most of which are met again and again.  Words of plain or Latin letters, signs and
    digits are cut as its pre-tokenizer cuts them and go to its model directly; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def part(self, letters: str) -> bytes:
        ids = self.parts.get(letters)
        if ids is None:
            if len(self.parts) > _WORDS_KEPT:
                self.parts.clear()
            found = [t.id for t in self.model.tokenize(letters)]
            ids = self.parts[letters] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _WORDS_KEPT:
            self.clear()
        if b"<|" not in word and _PLAIN.fullmatch(word):
            parts = [p.decode() for p in _ASCII.findall(word.lower())]
            ids = b"".join([self.part(p) for p in parts])
        else:
            text = word.decode("utf-8", "replace")
            if "<|" not in text and _LATIN.fullmatch(text):
                letters = self.letters
                ids = b"".join(
                    [
                        self.part("".join([letters[b] for b in p.encode()]))
                        for p in _PARTS.findall(text.lower())
                    ]
                )
            else:
                found = self.whole.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) < 100:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def ids_of(texts: pa.Array, words: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one behind the other and ``end`` behind each, and where each begins.

    A range's different words are looked up once; their occurrences are gathered by number.
    """
    data, begins = text_bytes(texts)
    counts = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    for at, to in byte_ranges(data, begins, _APART, _RANGE):
        here = begins[np.searchsorted(begins, at) : np.searchsorted(begins, to)] - at
        starts, found = words_in(data[at:to], here, _APART)
        if not len(starts):
            continue
        known = [words[w] for w in found.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        number = found.indices.to_numpy()
        own = sizes[number]
        before = np.cumsum(own) - own
        shift = np.repeat((np.cumsum(sizes) - sizes)[number] - before, own)
        parts.append(pool[shift + np.arange(len(shift))])
        text = np.searchsorted(begins, starts + at, side="right") - 1
        counts += np.bincount(text, own, len(texts)).astype(np.int64)
    firsts = np.cumsum(counts + 1) - (counts + 1)
    out = np.full(int(counts.sum()) + len(texts), end, "<u4")
    inner = np.ones(len(out), bool)
    inner[firsts + counts] = False
    if parts:
        out[inner] = np.concatenate(parts)
    return out, firsts


def in_parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts whose second column, a text, has about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``with_ids`` adds the ids themselves.  ``path`` is a tokenizer file that all workers can read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_store(f"words:{path}", lambda: WordIds(path))
        for batch in (part for whole in batches for part in in_parts(whole, _HELD)):
            ids, firsts = ids_of(batch.column(1), words, end)
            counts = np.diff(firsts, append=len(ids))
            pieces_of = -(-counts // size)
            text = np.repeat(np.arange(len(counts)), pieces_of)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
            start = piece * size
            length = np.minimum(size, counts[text] - start)
            begin = firsts[text] + start
            raw = memoryview(ids.tobytes())
            sums = [
                zlib.crc32(raw[4 * b : 4 * (b + n)])
                for b, n in zip(begin.tolist(), length.tolist(), strict=True)
            ]
            columns = [
                batch.column(0).take(pa.array(text)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array(sums, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                edges = pa.array(np.append(begin, len(ids)), pa.int32())
                columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


Match = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, offset


def sweep(
    gaps: dict[int, list[tuple[int, int]]], left: np.ndarray, size: int, take: Callable
) -> dict[int, list[tuple[int, int]]]:
    """One sweep of gaps over pieces, both by descending size; returns the gaps after it.

    ``gaps`` has runs (first sequence, sequences) by gap.  ``left`` counts the pieces by length
    before the sweep; ``take(length, n)`` gives the first rank of n of them.
    """
    after: dict[int, list[tuple[int, int]]] = {}
    length, unmet = size, 0  # the class that the sweep has reached, and what it still holds
    for gap in sorted(gaps, reverse=True):
        if length > gap:
            length, unmet = gap, int(left[gap])
        for first, count in gaps[gap]:
            while count:
                while not unmet and length > 1:
                    length -= 1
                    unmet = int(left[length])
                if not unmet:
                    after.setdefault(gap, []).append((first, count))
                    break
                n = min(count, unmet)
                take(length, n, first, size - gap)
                if gap > length:
                    after.setdefault(gap - length, []).append((first, n))
                first, count, unmet = first + n, count - n, unmet - n
    return after


def plan(counts: np.ndarray, size: int = SIZE) -> tuple[list[Match], int]:
    """Matches of all pieces, given their number by length, and the number of sequences."""
    left = np.array(counts, dtype=np.int64)
    taken = np.zeros_like(left)
    matches: list[Match] = []
    opened = 0
    lengths = np.arange(len(left))

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        matches.append((length, int(taken[length]), n, sequence, offset))
        taken[length] += n

    gaps: dict[int, list[tuple[int, int]]] = {}
    while left.sum():
        # Pieces over half a sequence never share one; after them, few at a time fit best.
        need = int(left[size // 2 + 1 :].sum())
        need = need or int(-(-int((left * lengths).sum()) // (size * OPENED)))
        for length in range(size, 0, -1):
            n = int(min(left[length], need))
            if n:
                take(length, n, opened, 0)
                if length < size:
                    gaps.setdefault(size - length, []).append((opened, n))
                opened, need = opened + n, need - n
        left = counts - taken
        while gaps and left.sum():
            gaps = sweep(gaps, left, size, take)
            now = counts - taken
            if (now == left).all():
                break
            left = now
    return matches, opened


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (rows with ``doc_id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    ranked = with_row_index(cut, ["length", "doc_id", "piece"], to="_rank")
    classes = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in classes:  # at most ``size`` rows
        counts[length] = n
    before = np.r_[0, np.cumsum(counts)[:-1]]
    matches, _ = plan(counts, size)
    rows = [
        (n, int(before[n]) + rank, int(before[n]) + rank + count, first, offset)
        for n, rank, count, first, offset in matches
    ]
    placed = spark.createDataFrame(
        rows, "_length long, _from long, _to long, _first long, offset long"
    )
    # A few matches per length and round, whatever the number of documents.
    here = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_to"))
    )
    return (
        ranked.join(F.broadcast(placed), here)
        .withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from"))
        .drop("_length", "_from", "_to", "_first", "_rank")
    )


def best_fit(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every piece of every document with its place; texts are tokenised once."""
    return pack(cut_lineage(pieces(docs, path, size, end)), size)


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, and the ``doc_ids`` in order."""
    whole = pack(cut_lineage(pieces(docs, path, size, end, with_ids=True)), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        whole.groupBy("sequence_id")
        .agg(parts.alias("_parts"))
        .select(
            "sequence_id",
            F.flatten("_parts.ids").alias("ids"),
            F.col("_parts.doc_id").alias("doc_ids"),
        )
    )
