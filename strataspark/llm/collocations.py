"""Collocations: phrases that occur more often than their parts would suggest.

A text's word positions are suffixes of at most ``max_words`` words.  Suffixes are routed over the
whole corpus by their leading words; each task sorts pointers to its suffixes by multikey three-way
quicksort, one word deeper at a time.  The size of an equal partition is the count of the phrase that
its suffixes begin with, and a partition too small for any phrase to be frequent is abandoned with
all that lies below it.

The sizes of the partitions by one and by two leading words are counted first, without moving what is
behind: words are counted, then pairs of frequent words as two keys, the words' hashes, which are checked
to differ for all words of the corpus.  These sizes are the counts of phrases of one and two words, and
partitions that are too small are abandoned before anything longer is routed: a suffix ends where its next
word makes an infrequent pair.  What remains is led by its words up to the first that is not crowded (is at
most one in ``FREQUENT`` of all words and occurs in at most ``TASK_ROWS`` places), so that what shares a lead
is bounded however common its first words are; phrases of crowded words alone are counted where they are
whole.  Equal suffixes of a task are one row with a count before they are shuffled.  Infrequent words and
pairs and crowded words are told by Bloom filters of bounded size: what is wrongly taken for frequent or
crowded costs a row or a longer lead, never a count.

A null text counts as empty, a null language as ``und``; rows that repeat each count, ids are not
looked at.  Texts of any length are read in slices.  An empty table gives no rows, and neither does a
language without candidates.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.llm.common import FREQUENT, release_shuffles
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 30  # occurrences of a candidate
MAX_WORDS = 4
TOP = 2000
COVERED = 80  # per cent of a phrase's places in a longer one
TASK_ROWS = 1_000_000  # suffixes that a task sorts at a time
BLOOM_BITS = 28  # at most so many binary digits of bits
_CHUNK = 1 << 20  # words whose suffixes a task merges
_SLICE = 1 << 22  # bytes of text read at a time
_WORDS_KEPT = 1 << 19  # words a task remembers

# Characters that part words, and those that end a piece.
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _BREAK
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Bloom:
    """A set of 64-bit hashes that may claim to hold others, too."""

    bits: np.ndarray
    power: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash, whether it may be in the set."""
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        found = np.ones(len(hashes), bool)
        for i in range(4):
            at = (low + np.uint64(i) * high) & np.uint64((1 << self.power) - 1)
            word = self.bits[(at >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom(hashes: DataFrame, column: str, rows: int) -> Bloom:
    """The filter of a column of 64-bit hashes, 16 bits each as far as ``BLOOM_BITS`` allows.

    Spark sets the bits; the driver gets the filter's words, of which there are at most
    ``2 ** (BLOOM_BITS - 6)``.
    """
    power = min(BLOOM_BITS, max(6, (16 * max(rows, 1)).bit_length()))
    low = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col(column), 32)
    places = F.array(*[(low + high * i).bitwiseAND(F.lit((1 << power) - 1)) for i in range(4)])
    words = (
        hashes.select(F.explode(places).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return Bloom(bits.view(np.uint64), power)


class WordIds:
    """Numbers from 1 for the words of each language; 0 stands for the end of a piece.

    With ``frequent``, a word that it does not hold is 0, too, and is not remembered; ``salt`` is what
    its hashes begin with.
    """

    def __init__(self, frequent: Bloom | None = None, salt: str = "") -> None:
        self.frequent = frequent
        self.salt = salt.encode()
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.of_language: dict[str, dict[bytes, int]] = {}
        self._hashes: list[np.ndarray] = [np.zeros(1, np.uint64)]

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The numbers of different words; new ones get the next."""
        known = self.of_language.setdefault(lang, {})
        out = np.fromiter((known.get(w, 0) for w in words), np.int32, len(words))
        new = np.flatnonzero(out == 0)
        if self.frequent is not None and len(new):
            prefix = self.salt + lang.encode() + b"\0"
            digests = (xxhash.xxh64_intdigest(prefix + words[i], seed=42) for i in new.tolist())
            hashes = np.fromiter(digests, np.uint64, len(new))
            often = self.frequent.holds(hashes)
            new = new[often]
            self._hashes.append(hashes[often])
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            out[new] = np.arange(len(self.words), len(self.words) + len(fresh))
            known.update(zip(fresh, out[new].tolist(), strict=True))
            self.words += fresh
            self.langs += [lang] * len(fresh)
        return out

    def hashes(self) -> np.ndarray:
        """The hash of each number's language and word, as Spark gives it."""
        self._hashes = [np.concatenate(self._hashes)]
        return self._hashes[0]


def _numbered(batches: Iterator[pa.RecordBatch], ids: WordIds) -> Iterator[np.ndarray]:
    """The word numbers of all texts in slices; a 0 wherever a piece or a text ends."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        texts = batch.column(1).cast(pa.binary())
        for code, name in enumerate(langs.dictionary.to_pylist()):
            own = texts if len(langs.dictionary) == 1 else texts.filter(pc.equal(langs.indices, code))
            offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
            data = own.buffers()[2]
            if data is not None:
                data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
                begins = offsets[:-1].astype(np.int64) - offsets[0]
                for at, to in _slices(data, begins):
                    here = begins[np.searchsorted(begins, at) : np.searchsorted(begins, to)] - at
                    yield _of_slice(data[at:to], here, name, ids)
            yield np.zeros(1, np.int32)


def _slices(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cut no word."""
    at = 0
    while at < len(data):
        to = min(at + _SLICE, len(data))
        if to < len(data):
            following = np.searchsorted(begins, to)
            end = int(begins[following]) if following < len(begins) else len(data)
            while to < end:
                apart = np.flatnonzero(_KIND[data[to : min(to + 4096, end)]])
                if len(apart):
                    to += int(apart[0])
                    break
                to = min(to + 4096, end)
        yield at, to
        at = to


def _of_slice(part: np.ndarray, begins: np.ndarray, lang: str, ids: WordIds) -> np.ndarray:
    """Word numbers of one slice, in which texts begin at ``begins``."""
    kind = _KIND[part]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(part)]
    first[begins] = inside[begins]
    ended = kind == _BREAK
    ended[begins] = True
    breaks = np.cumsum(ended, dtype=np.int32)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(int(len(part) > 0 and breaks[-1] > 0), np.int32)
    offsets = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(offsets[starts] - 1, offsets[-1]).astype(np.int32)
    letters = _LOWER[part[inside]]
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    ).dictionary_encode()
    numbers = ids.numbers(lang, words.dictionary.to_pylist())[words.indices.to_numpy()]
    before = breaks[starts]
    apart = np.diff(before, prepend=0) > 0
    out = np.zeros(len(starts) + int(apart.sum()) + int(breaks[-1] > before[-1]), np.int32)
    out[np.arange(len(starts)) + np.cumsum(apart)] = numbers
    return out


def _held(
    batches: Iterator[pa.RecordBatch], ids: WordIds, behind: int
) -> Iterator[tuple[np.ndarray, int]]:
    """Chunks of word numbers, and how many places of each begin a suffix of its own.

    The last ``behind`` places of a chunk come again with the next one, which has the words that
    follow them.  Between chunks the dictionary may be emptied.
    """
    parts: list[np.ndarray] = []
    waiting = 0
    for numbers in _numbered(batches, ids):
        parts.append(numbers)
        waiting += len(numbers)
        if waiting >= _CHUNK or len(ids) > _WORDS_KEPT:
            held = np.concatenate(parts)
            starts = max(0, len(held) - behind)
            yield held, starts
            tail = held[starts:]
            if len(ids) > _WORDS_KEPT:
                again = [(ids.langs[i], ids.words[i]) for i in tail.tolist()]
                ids.clear()
                tail = np.array([ids.numbers(a, [b])[0] if b else 0 for a, b in again], np.int32)
            parts, waiting = [tail], len(tail)
    if waiting:
        held = np.concatenate(parts)
        yield held, len(held)


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``word``, ``n`` of every word; a task adds up its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        total = np.zeros(0, np.int64)
        for held, _ in _held(batches, ids, 0):
            seen = np.bincount(held, minlength=len(ids))
            seen[: len(total)] += total
            total = seen
            if len(ids) > _WORDS_KEPT:
                yield from _word_rows(ids, total)
                total = np.zeros(0, np.int64)
        if len(total):
            yield from _word_rows(ids, total)

    found = _texts(docs, lang, text).mapInArrow(count, "lang string, word binary, n long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(
        F.sum("n").alias("n")
    )


def _word_rows(ids: WordIds, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(1, len(ids), 65536):
        words = ids.words[at : at + 65536]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids.langs[at : at + 65536], pa.string()),
                pa.array(words, pa.binary()),
                pa.array(total[at : at + len(words)]),
            ],
            names=["lang", "word", "n"],
        )


# Primes of the hash function.
_PRIMES = [
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    )
]


def _turned(value: np.ndarray, by: int) -> np.ndarray:
    return (value << np.uint64(by)) | (value >> np.uint64(64 - by))


def _joined(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """XXH64 of a word's hash, seeded by that of the run before it: what Spark's function gives."""
    p1, p2, p3, p4, p5 = _PRIMES
    mixed = run + p5 + np.uint64(8)
    mixed = mixed ^ (_turned(word * p2, 31) * p1)
    mixed = _turned(mixed, 27) * p1 + p4
    mixed = (mixed ^ (mixed >> np.uint64(33))) * p2
    mixed = (mixed ^ (mixed >> np.uint64(29))) * p3
    return mixed ^ (mixed >> np.uint64(32))


def _frequent_pairs(held: np.ndarray, hashes: np.ndarray, pairs: Bloom) -> np.ndarray:
    """At which places two words begin that may be a frequent pair."""
    both = held > 0
    both[:-1] &= held[1:] > 0
    both[-1:] = False
    at = np.flatnonzero(both)
    first = _joined(np.full(len(at), 42, np.uint64), hashes[held[at]])
    both[at] = pairs.holds(_joined(first, hashes[held[at + 1]]))
    return both


def pair_counts(
    docs: DataFrame, frequent: Bloom, salt: str = "", lang: str = "lang", text: str = "text"
) -> DataFrame:
    """``first``, ``second``, ``n``: the hashes of two words in a row that may be frequent, and their count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(frequent, salt)
        for held, starts in _held(batches, ids, 1):
            following = np.append(held, 0)[1 : starts + 1]
            at = np.flatnonzero((held[:starts] > 0) & (following > 0))
            found, n = np.unique((held[at].astype(np.int64) << 32) | following[at], return_counts=True)
            hashes = ids.hashes().view(np.int64)
            for lo in range(0, len(found), 1 << 18):
                cut = slice(lo, lo + (1 << 18))
                keys = (hashes[found[cut] >> 32], hashes[found[cut] & 0xFFFFFFFF])
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, keys), pa.array(n[cut])], names=["first", "second", "n"]
                )

    found = _texts(docs, lang, text).mapInArrow(count, "first long, second long, n long")
    return found.groupBy("first", "second").agg(F.sum("n").alias("n"))


def _merged(table: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of word numbers as one, their counts added; a word at a time."""
    key = table[:, 0].astype(np.int64)
    for i in range(1, table.shape[1]):
        key = pd.factorize((key << 32) | table[:, i])[0]
    # Numbers are given in the order of first places.
    first = np.flatnonzero(np.r_[True, key[1:] > np.maximum.accumulate(key)[:-1]])
    return table[first], np.bincount(key, n).astype(np.int64)


def suffixes(
    docs: DataFrame,
    frequent: Bloom,
    crowded: Bloom,
    pairs: Bloom,
    max_words: int = MAX_WORDS,
    salt: str = "",
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """Suffixes of three words or more: ``lang``, ``lead``, ``w1`` … and how often the task met them.

    ``lead`` is the words up to the first that is not crowded; ``w1`` and so on are those behind it.
    A suffix of crowded words alone has a row of its own for each of its beginnings of three words or
    more, with nothing behind.
    """
    rest = [f"w{i}" for i in range(1, max_words)]
    schema = f"lang string, lead string, {', '.join(f'{w} string' for w in rest)}, n long"

    def table_of(held: np.ndarray, starts: int, ids: WordIds) -> np.ndarray:
        """The suffixes at the first ``starts`` places, one row of numbers each."""
        goes_on = np.concatenate(
            [_frequent_pairs(held, ids.hashes(), pairs), np.zeros(max_words, bool)]
        )
        keep = np.flatnonzero(goes_on[:starts] & goes_on[1 : starts + 1])
        ends = np.concatenate([held, np.zeros(max_words, np.int32)])
        table = np.zeros((len(keep), max_words), np.int32)
        whole = np.ones(len(keep), bool)
        for i in range(max_words):
            if i:
                whole &= goes_on[keep + i - 1]
            table[:, i] = ends[keep + i] * whole
        return table

    def emit(table: np.ndarray, n: np.ndarray, ids: WordIds) -> Iterator[pa.RecordBatch]:
        packed = crowded.holds(ids.hashes())
        length = (table > 0).sum(1)
        plain = (table > 0) & ~packed[table]
        led = plain.any(1)
        to = plain.argmax(1) + 1
        if led.any():
            yield from batches_of(table[led], to[led], n[led], ids)
        for size in range(3, max_words + 1):
            whole = np.where(led, to > size, length >= size)
            if whole.any():
                alone = table[whole]
                alone[:, size:] = 0
                alone, sums = _merged(alone, n[whole])
                yield from batches_of(alone, np.full(len(alone), size), sums, ids)

    def batches_of(
        rows: np.ndarray, lead: np.ndarray, n: np.ndarray, ids: WordIds
    ) -> Iterator[pa.RecordBatch]:
        used, at = np.unique(rows, return_inverse=True)
        at = at.reshape(rows.shape)
        # Number 0 is no word.
        names = pa.array([ids.words[i] if i else None for i in used.tolist()], pa.binary())
        names = names.view(pa.string())
        langs = pa.array([ids.langs[i] for i in used.tolist()], pa.string())
        for lo in range(0, len(rows), 65536):
            here, ends = at[lo : lo + 65536], lead[lo : lo + 65536]
            within = [
                names.take(pa.array(here[:, i], mask=ends <= i)) for i in range(max_words)
            ]
            joined = pc.binary_join_element_wise(*within, " ", null_handling="skip")
            after = []
            for i in range(max_words - 1):
                place = np.minimum(ends + i, max_words - 1)
                own = here[np.arange(len(here)), place]
                after.append(names.take(pa.array(own, mask=ends + i >= max_words)))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(here[:, 0])), joined, *after, pa.array(n[lo : lo + 65536])],
                names=["lang", "lead", *rest, "n"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(frequent, salt)
        for held, starts in _held(batches, ids, max_words - 1):
            found = table_of(held, starts, ids)
            if len(found):
                found, n = _merged(found, np.ones(len(found), np.int64))
                # What begins alike goes to the same place, and takes less room side by side.
                order = np.lexsort(found.T[::-1])
                yield from emit(found[order], n[order], ids)

    return _texts(docs, lang, text).mapInArrow(cut, schema)


def equal_partitions(
    words: np.ndarray, n: np.ndarray, least: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of rows of numbers, each row counting ``n`` times.

    Yields, per step, ``(depth, row, size)`` arrays of the equal partitions of ``size >= least``:
    ``row`` is one of their rows, and its first ``depth`` numbers are what all rows share.  Number 0
    ends a row.  All partitions alive are split in the same step, each by the middle one of three of
    its rows; partitions smaller than ``least`` are abandoned unsorted.
    """
    pointers = np.arange(len(words))
    depth = np.zeros(1, np.int64)
    starts = np.zeros(1, np.int64)
    width = words.shape[1]
    while len(pointers):
        sizes = np.diff(np.r_[starts, len(pointers)])
        owner = np.repeat(np.arange(len(starts)), sizes)
        value = words[pointers, depth[owner]]
        samples = np.stack([value[starts], value[starts + sizes // 2], value[starts + sizes - 1]])
        pivot = np.sort(samples, axis=0)[1]
        side = 1 + np.sign(value - pivot[owner])
        order = np.argsort(owner * 3 + side, kind="stable")
        pointers, group = pointers[order], (owner * 3 + side)[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        weight = np.add.reduceat(n[pointers], first)
        which, side = group[first] // 3, group[first] % 3
        equal = side == 1
        deeper = depth[which] + equal
        ended = equal & (pivot[which] == 0)
        alive = (weight >= least) & ~ended
        told = alive & equal
        for d in np.unique(deeper[told]):
            here = told & (deeper == d)
            yield int(d), pointers[first[here]], weight[here]
        alive &= deeper < width
        lengths = np.diff(np.r_[first, len(pointers)])
        pointers = pointers[np.repeat(alive, lengths)]
        depth = deeper[alive]
        starts = np.r_[0, np.cumsum(lengths[alive])[:-1]].astype(np.int64)
        if not alive.any():
            return


def phrase_counts(
    routed: DataFrame, rows: int, least: int = LEAST, max_words: int = MAX_WORDS
) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` of the phrases of three words or more that are frequent.

    ``rows`` is about how many suffixes there are; it sets the number of tasks.
    """
    rest = [f"w{i}" for i in range(1, max_words)]
    spark = routed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))

    def numbers(table: pa.Table) -> np.ndarray:
        """Rows of word numbers; the first stands for the language and the lead."""
        lead = table["lead"].combine_chunks().dictionary_encode()
        lang = table["lang"].combine_chunks().dictionary_encode()
        first = lead.indices.to_numpy().astype(np.int64) * len(lang.dictionary)
        first += lang.indices.to_numpy() + 1
        words = pa.chunked_array([c for w in rest for c in table[w].chunks], pa.string())
        behind = words.combine_chunks().dictionary_encode().indices.cast(pa.int64())
        behind = pc.fill_null(pc.add(behind, 1), 0).to_numpy().reshape(len(rest), -1)
        return np.column_stack([first, *behind])

    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = numbers(table), table["n"].to_numpy()
        for depth, row, size in equal_partitions(words, n, least):
            at = pa.array(row)
            taken = [table["lead"].take(at), *[table[w].take(at) for w in rest[: depth - 1]]]
            phrase = pc.binary_join_element_wise(*taken, " ").combine_chunks()
            langs = table["lang"].take(at).combine_chunks()
            found = pa.table([langs, phrase, pa.array(size)], names=["lang", "phrase", "n"])
            yield from found.to_batches()

    def sort_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            # Rows come by route; what is held may be sorted once its last route has ended.
            route = batch.column(0).to_numpy()
            if waiting >= TASK_ROWS:
                before = held[-1].column(0)[-1].as_py()
                ended = np.flatnonzero(route != before)
                if len(ended):
                    changes = np.flatnonzero(route[1:] != route[:-1]) + 1
                    to = int(changes[-1]) if len(changes) else 0
                    held.append(batch.slice(0, to))
                    yield from sort(_without_route(held))
                    held, waiting, batch = [], 0, batch.slice(to)
            held.append(batch)
            waiting += batch.num_rows
        if held:
            yield from sort(_without_route(held))

    # The route is worked out where rows arrive, and not moved with them.
    dealt = (
        routed.repartition(parts, "lang", "lead")
        .select(F.xxhash64("lang", "lead").alias("route"), "*")
        .sortWithinPartitions("route")
    )
    found = dealt.mapInArrow(sort_all, "lang string, phrase string, n long")
    return found.select(
        "lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"
    ).where("words > 2")


def _without_route(held: list[pa.RecordBatch]) -> pa.Table:
    table = pa.Table.from_batches(held)
    return table.select(table.column_names[1:])


def counts(
    docs: DataFrame,
    least: int = LEAST,
    max_words: int = MAX_WORDS,
    lang: str = "lang",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of frequent phrases, words included, and ``(lang, n)`` of all words."""
    words = cut_lineage(word_counts(docs, lang, text))
    release_shuffles(docs.sparkSession)
    n_often, total = words.agg(
        F.count_if(F.col("n") >= least), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    salt = distinguishing_salt(words)
    hashed = words.withColumn("hash", word_hash(salt))
    often = hashed.where(F.col("n") >= least)
    crowd = hashed.where(F.col("n") > min(TASK_ROWS, total // FREQUENT))
    frequent = bloom(often, "hash", n_often)
    single = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    found = single
    if max_words > 1:
        pairs = pair_counts(docs, frequent, salt, lang, text).where(F.col("n") >= least)
        pairs = cut_lineage(pairs)
        release_shuffles(docs.sparkSession)
        firsts = often.select("lang", F.col("word").alias("_first"), F.col("hash").alias("first"))
        seconds = often.select(F.col("word").alias("_second"), F.col("hash").alias("second"))
        named = pairs.join(firsts, "first").join(seconds, "second")
        phrase = F.concat_ws(" ", "_first", "_second").alias("phrase")
        found = found.unionByName(named.select("lang", phrase, F.lit(2).alias("words"), "n"))
    if max_words > 2:
        crowded = bloom(crowd, "hash", crowd.count())
        joined = pairs.select(F.xxhash64("first", "second").alias("run"))
        n_pairs, rows = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        known = bloom(joined, "run", n_pairs)
        routed = suffixes(docs, frequent, crowded, known, max_words, salt, lang, text)
        found = found.unionByName(phrase_counts(routed, rows, least, max_words))
    return cut_lineage(found), words.groupBy("lang").agg(F.sum("n").alias("n"))


def word_hash(salt: str) -> F.Column:
    """The hash of ``lang`` and ``word``, as tasks work it out."""
    return F.xxhash64(F.concat(F.lit(salt), F.col("lang"), F.lit("\0"), F.col("word")))


def distinguishing_salt(words: DataFrame) -> str:
    """A salt under which all rows ``lang, word`` have different hashes."""
    salt = ""
    while True:
        equal = words.groupBy(word_hash(salt).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
        if equal.where("n > 1").isEmpty():
            return salt
        salt += "+"


def _wide(column: str) -> F.Column:
    return F.col(column).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """Candidates with ``a``, ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    parts = found.select("lang", "phrase", "n")
    cuts = found.where("words > 1").select(
        "lang", "phrase", "words", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    )
    cuts = cuts.withColumns(
        {
            "left": F.expr("substring_index(phrase, ' ', k)"),
            "right": F.expr("substring_index(phrase, ' ', k - words)"),
        }
    )
    lefts = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    both = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr(
        "cast((2000000BD * cast(a as decimal(20,0))) div"
        " (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"
    )
    best = both.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates without those that a longer candidate holds in ``covered`` per cent of their places."""
    longer = candidates.where("words > 2").select(
        "lang", F.col("a").alias("longest"), "words", F.split("phrase", " ").alias("w")
    )
    # Every part of two words or more, but the whole.
    inner = longer.select(
        "lang", "longest",
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, words - 1), size ->"
                " transform(sequence(1, words - size + 1), at -> array_join(slice(w, at, size), ' '))))"
            )
        ).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    joined = candidates.join(inner, ["lang", "phrase"], "left")
    held = _wide("longest") * 100 >= _wide("a") * covered
    return joined.where(~F.coalesce(held, F.lit(False))).drop("longest")


def mine(
    docs: DataFrame,
    least: int = LEAST,
    max_words: int = MAX_WORDS,
    covered: int = COVERED,
    top: int | None = TOP,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The best collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Ordered by score, then count, descending, then phrase.  ``top`` of None gives all.
    """
    found, totals = counts(docs, least, max_words, lang, text)
    kept = uncovered(cut_lineage(scored(found)), covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        # Tasks keep their own best before the shuffle.
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
