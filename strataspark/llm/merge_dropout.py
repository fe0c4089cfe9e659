"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the BPE of a SentencePiece model: blanks become the model's mark, a mark is put
before the text, characters are merged pair by pair, best score first, leftmost first among equals,
and what the vocabulary lacks is spelled in byte pieces.  With dropout, a candidate merge that comes
up on the agenda is skipped for good where a hash of the seed, the text's variant, the word, the
word's place in the text and the candidate's place falls below the given share.  A text's variant is a
64-bit hash of its document, so every occurrence of a word is cut anew, within a text and across
texts.  Segmentations repeat exactly with the same seed and variant, and decode to the same text.

No piece of such a vocabulary has a mark behind another character, so words are encoded by
themselves.  What a worker remembers of a word is its tree of decisions, in which an occurrence's own
hashes lead to its pieces; the tree holds for all seeds, variants and places.  A mark that is part of
the text itself is spelled in bytes, so that decoding gives it back.

Null and empty texts have no pieces.  Rows that repeat are encoded each, alike.  Rows without an id
have their text's hash as variant.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import worker_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
_WORDS_KEPT = 200_000  # words a worker remembers
_NODES_KEPT = 500_000  # decisions about them that it remembers
_OFTEN = 8  # occurrences that come to a decision before it is remembered
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LONG = 100  # characters from which a word's agenda is a heap
_NEVER = 1 << 30
_TOGETHER = 1 << 18  # words encoded side by side
_ALIKE = 20_000  # words of about one length whose agendas are worked off side by side
_SLOTS = 18  # bits of the table of pairs


_MASK = (1 << 64) - 1
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15  # between the keys of a text's places


def mixed(x: int) -> int:
    """A well-spread 64-bit hash of a 64-bit number."""
    x = ((x ^ (x >> 30)) * _ODD[0]) & _MASK
    x = ((x ^ (x >> 27)) * _ODD[1]) & _MASK
    return x ^ (x >> 31)


def mixed_many(x: np.ndarray) -> np.ndarray:
    """:func:`mixed` of many numbers at once."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(_ODD[0])
    x = (x ^ (x >> u(27))) * u(_ODD[1])
    return x ^ (x >> u(31))


def text_key(seed: int, variant: int) -> int:
    """What the keys of a text's words begin with."""
    return mixed(mixed(variant & _MASK) ^ (seed & _MASK))


def skipped(key: int, start: int, middle: int, end: int, share: float) -> bool:
    """Whether a keyed hash skips the merge of two neighbours; the same on all machines."""
    return mixed(key ^ (start << 42 | middle << 21 | end)) >> 24 < share * (1 << 40)


def skipped_many(
    keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, share: float
) -> np.ndarray:
    """:func:`skipped` for many candidates at once."""
    u = np.uint64
    places = start.astype(u) << u(42) | middle.astype(u) << u(21) | end.astype(u)
    return mixed_many(keys ^ places) >> u(24) < share * (1 << 40)


_INNER, _LEAF = 1, 2  # kinds of nodes; 0 is one that is not entered


class Words(dict):
    """Roots of the trees of decisions, by word without its mark.

    An inner node is a candidate merge: the first node below it is where the merge leads, the second
    one where skipping it leads.  A leaf knows where its ids lie in ``leaves``.  A word is
    entered when it is met again, a node when enough occurrences have come to it; others are encoded
    by themselves.
    """

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.once: set[str] = set()
        # A root's word, an inner node's parts, starts, agenda and best place.
        self.held: list = []
        self.leaves = np.zeros(1024, dtype=np.uint32)  # ids of all leaves
        self.filled = 0
        self.start = np.zeros(1024, dtype=np.int64)  # a leaf's first id
        self.size = np.zeros(1024, dtype=np.int64)
        self.kind = np.zeros(1024, dtype=np.uint8)
        self.met = np.zeros(1024, dtype=np.int64)
        self.crc = np.zeros(1024, dtype=np.uint64)  # of a root's word
        self.code = np.zeros(1024, dtype=np.uint64)  # a candidate's place
        self.below = np.zeros(1024, dtype=np.int64)
        self.above = np.zeros(1024, dtype=np.int64)

    def _new(self, *held: object) -> int:
        """Places of new nodes, one behind the other; the first one's."""
        at = len(self.held)
        self.held += held
        if len(self.held) > len(self.kind):
            for name in ("kind", "met", "crc", "code", "below", "above", "start", "size"):
                old = getattr(self, name)
                setattr(self, name, np.r_[old, np.zeros_like(old)])
        return at

    def __missing__(self, word: str) -> int:
        if len(word) >= _LONG - 1:
            return -1
        if word not in self.once:
            self.once.add(word)
            return -1
        marked = MARK + word
        at = self[word] = self._new(marked)
        self.crc[at] = zlib.crc32(marked.encode("utf-8", "replace"))
        self.above[at] = -1
        return at

    def learn(self, texts: Sequence[str]) -> None:
        """Enter the words of these texts."""
        for text in texts:
            for word in text.split(" "):
                self.once.add(word)
                self[word]

    def expand(self, node: int) -> None:
        """Find out what a node is."""
        get, above = self.model.ranks.get, int(self.above[node])
        if above < 0:
            word = self.held[node]
            parts, starts = list(word), list(range(len(word) + 1))
            agenda = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        else:
            parts, starts, agenda, i = self.held[above]
            parts, starts, agenda = parts[:], starts[:], agenda[:]
            if node > self.below[above]:
                agenda[i] = _NEVER
            else:
                self.model.merge_at(i, parts, starts, agenda)
        best = min(agenda, default=_NEVER)
        if best == _NEVER:
            ids = self.model.spell(parts)
            while self.filled + len(ids) > len(self.leaves):
                self.leaves = np.r_[self.leaves, np.zeros_like(self.leaves)]
            self.leaves[self.filled : self.filled + len(ids)] = ids
            self.start[node], self.size[node] = self.filled, len(ids)
            self.filled += len(ids)
            self.held[node] = None
            self.kind[node] = _LEAF
            return
        i = agenda.index(best)
        self.held[node] = parts, starts, agenda, i
        below = self._new(None, None)
        self.above[below : below + 2] = node
        self.below[node] = below
        self.code[node] = starts[i] << 42 | starts[i + 1] << 21 | starts[i + 2]
        self.kind[node] = _INNER

    def pieces(
        self, words: Sequence[str], base: np.ndarray, share: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many occurrences of words, one behind the other, and how many each has.

        ``base`` has the key of each one's text and place.
        """
        if len(self.held) > _NODES_KEPT or len(self) > _WORDS_KEPT:
            self.clear()
        if len(self.once) > _WORDS_KEPT:
            self.once.clear()
        n = len(words)
        root = np.fromiter(map(self.__getitem__, words), np.int64, n)
        alone = np.flatnonzero(root < 0)
        crc = self.crc[root] if self.held else np.zeros(n, dtype=np.uint64)
        crc[alone] = [zlib.crc32((MARK + words[i]).encode("utf-8", "replace")) for i in alone.tolist()]
        keys = mixed_many(base ^ crc)
        apart, start, size = [alone], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero(root >= 0)
        at, key = root[alive], keys[alive]
        while len(alive):
            kind = self.kind[at]
            if kind.min() < _INNER:
                nodes, times = np.unique(at[kind < _INNER], return_counts=True)
                self.met[nodes] += times
                for node in nodes[self.met[nodes] >= _OFTEN].tolist():
                    self.expand(node)
                kind = self.kind[at]
                apart.append(alive[kind < _INNER])
            done = kind == _LEAF
            start[alive[done]], size[alive[done]] = self.start[at[done]], self.size[at[done]]
            go = kind == _INNER
            alive, at, key = alive[go], at[go], key[go]
            skip = mixed_many(key ^ self.code[at]) >> np.uint64(24) < share * (1 << 40)
            at = self.below[at] + skip
        rest = np.concatenate(apart)
        merged, first, many = self.model.merged(
            [MARK + words[i] for i in rest.tolist()], keys[rest], share
        )
        start[rest], size[rest] = first + self.filled, many
        ids = np.concatenate([self.leaves[: self.filled], merged])
        return ids[spread(start, size)], size


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of many stretches, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class PieceModel:
    """Pieces, scores and byte pieces of a BPE model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece has a mark behind another character")
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        best_first = sorted(self.ids.values(), key=lambda i: -self.scores[i])
        rank = {i: n for n, i in enumerate(best_first)}
        self.ranks = {piece: rank[i] for piece, i in self.ids.items()}
        self.words = Words(self)
        self.pairs: dict[str, np.ndarray] | None = None

    def merge(self, word: str, key: int, share: float) -> list[int]:
        """Ids of one word; ``key`` seeds the skipping of a ``share`` of candidates."""
        if len(word) >= _LONG:
            return self.spell(self.merge_long(word, key, share))
        get = self.ranks.get
        parts = list(word)
        starts = list(range(len(word) + 1))
        agenda = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            if share and skipped(key, starts[i], starts[i + 1], starts[i + 2], share):
                agenda[i] = _NEVER
                continue
            self.merge_at(i, parts, starts, agenda)
        return self.spell(parts)

    def merge_at(self, i: int, parts: list[str], starts: list[int], agenda: list[int]) -> None:
        """Merge a part with the one behind it, and rank the pairs that this makes."""
        get = self.ranks.get
        parts[i] += parts.pop(i + 1)
        del agenda[i], starts[i + 1]
        if i:
            agenda[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
        if i < len(agenda):
            agenda[i] = get(parts[i] + parts[i + 1], _NEVER)

    def merge_long(self, word: str, key: int, share: float) -> list[str]:
        """The same with a heap, for words whose agenda is long."""
        get, n = self.ranks.get, len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        ends = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged away
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank = get(word[i : ends[j]])
            if rank is not None:
                heapq.heappush(agenda, (rank, i, j, ends[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, end = heapq.heappop(agenda)
            if not ends[i] or right[i] != j or ends[j] != end:
                continue
            if share and skipped(key, i, j, end, share):
                continue
            ends[i], ends[j] = end, 0
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        out, i = [], 0
        while i < n:
            out.append(word[i : ends[i]])
            i = right[i]
        return out

    def _pairs(self) -> dict[str, np.ndarray]:
        """A table of mergeable pairs of symbols and their ranks; pieces by rank, ids by character.

        A slot holds one pair; the others that belong there are found in the sorted list of spilled
        ones.  Characters that only occur inside pieces get ids behind the model's.
        """
        symbols = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                symbols.setdefault(c, len(self.bytes_of) + len(symbols))
        self.symbol_limit = len(self.bytes_of) + len(symbols) + 1
        keys, ranks = [], []
        for piece in self.ids:
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.symbol_limit + right)
                    ranks.append(self.ranks[piece])
        key, rank = np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32)
        order = np.argsort(key)
        key, rank = key[order], rank[order]
        slots, first = np.unique(self._slot(key), return_index=True)
        held = np.full(1 << _SLOTS, -1, dtype=np.int64)
        ranked = np.full(1 << _SLOTS, _NEVER, dtype=np.int32)
        held[slots], ranked[slots] = key[first], rank[first]
        spilled = np.ones(len(key), dtype=bool)
        spilled[first] = False
        crowded = np.zeros(1 << _SLOTS, dtype=bool)
        crowded[self._slot(key[spilled])] = True
        characters = np.full(sys.maxunicode + 1, self.symbol_limit - 1, dtype=np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1:
                characters[ord(symbol)] = i
        by_rank = np.zeros(len(self.ranks), dtype=np.int32)
        for piece, place in self.ranks.items():
            by_rank[place] = self.ids[piece]
        return {
            "held": held,
            "ranked": ranked,
            "crowded": crowded,
            # One that is no pair ends the list, so that every search has a place in it.
            "spilled": np.r_[key[spilled], np.iinfo(np.int64).max],
            "spilled_ranks": np.r_[rank[spilled], np.int32(_NEVER)],
            "characters": characters,
            "by_rank": by_rank,
        }

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``_NEVER`` where there is no such piece."""
        wanted = left * np.int64(self.symbol_limit) + right
        slot = self._slot(wanted)
        own = self.pairs["held"][slot] == wanted
        out = np.where(own, self.pairs["ranked"][slot], np.int32(_NEVER))
        look = np.nonzero(~own & self.pairs["crowded"][slot])
        if len(look[0]):
            at = np.searchsorted(self.pairs["spilled"], wanted[look])
            found = self.pairs["spilled"][at] == wanted[look]
            out[look] = np.where(found, self.pairs["spilled_ranks"][at], np.int32(_NEVER))
        return out

    def merge_many(self, words: Sequence[str], keys: Sequence[int], share: float) -> list[bytes]:
        """Ids (four bytes each) of many words, as :meth:`merge` gives them."""
        ids, start, size = self.merged(words, np.array(keys, dtype=np.uint64), share)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), size.tolist(), strict=True)]

    def merged(
        self, words: Sequence[str], keys: np.ndarray, share: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words as :meth:`merge` gives them; each word's first place in them, and its size.

        Words of about one length go through their agendas side by side: in each step every word
        merges or skips its best candidate, the leftmost among equals.
        """
        if self.pairs is None:
            self.pairs = self._pairs()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        start, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        out, filled, at = [np.zeros(0, dtype=np.uint32)], 0, 0
        while at < len(order):
            length = int(ordered[at])
            if length >= _LONG:
                some = order[at : at + 1]
                word = self.merge(words[some[0]], int(keys[some[0]]), share)
                ids, many = np.array(word, dtype=np.uint32), np.array([len(word)])
            else:
                longest = min(length + length // 6, _LONG - 1)
                some = order[at : np.searchsorted(ordered, longest, side="right")][:_ALIKE]
                ids, many = self._merge_alike([words[i] for i in some.tolist()], lengths[some], keys[some], share)
            out.append(ids)
            start[some], size[some] = filled + np.cumsum(many) - many, many
            filled += len(ids)
            at += len(some)
        return np.concatenate(out), start, size

    def _merge_alike(
        self, words: list[str], lengths: np.ndarray, key: np.ndarray, share: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of about one length, one behind the other, and how many each has.

        A part stays at the place of its first character; ``after`` and ``before`` lead to its
        neighbours.  Places before and behind a word hold a symbol that merges with nothing.
        """
        n, longest = len(words), int(lengths.max())
        width = longest + 2
        points = np.array(words, dtype=f"<U{longest}").view("<u4").reshape(n, longest)
        columns = np.arange(1, longest + 1)
        inside = columns <= lengths[:, None]
        matrix = np.full((n, width), self.symbol_limit - 1, dtype=np.int32)
        matrix[:, 1:-1][inside] = self.pairs["characters"][points[inside]]
        agenda = np.full((n, width), _NEVER, dtype=np.int32)
        agenda[:, 1:-1] = self._ranked(matrix[:, 1:-1], matrix[:, 2:])
        symbols, ranks = matrix.reshape(-1), agenda.reshape(-1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int64), n)
        heads = np.zeros((n, width), dtype=bool)
        heads[:, 1:-1] = inside
        alive = np.arange(n)
        by_rank = self.pairs["by_rank"]
        while len(alive):
            own = agenda[alive] if len(alive) < n else agenda
            first = own.argmin(axis=1)
            rank = own[np.arange(len(alive)), first]
            go = rank != _NEVER
            alive, first, rank = alive[go], first[go], rank[go]
            row = alive * width
            at = row + first
            middle = after[at]
            end = after[row + middle]
            if share:
                skip = skipped_many(key[alive], first - 1, middle - 1, end - 1, share)
                ranks[at[skip]] = _NEVER
                go = ~skip
                row, first, at, middle, end, rank = (
                    x[go] for x in (row, first, at, middle, end, rank)
                )
            merged = by_rank[rank]
            symbols[at] = merged
            ranks[row + middle] = _NEVER
            heads.reshape(-1)[row + middle] = False
            after[at] = end
            before[row + end] = first
            ranks[at] = self._ranked(merged, symbols[row + end])
            left = row + before[at]
            ranks[left] = self._ranked(symbols[left], merged)
        many = heads.sum(axis=1)
        ids = matrix[heads].astype(np.uint32)
        strange = (heads & (matrix >= len(self.bytes_of))).any(axis=1)
        if not strange.any():
            return ids, many
        # Words with parts that the vocabulary lacks are spelled anew.
        plain = ids[np.repeat(~strange, many)]
        spelled = []
        for i in np.flatnonzero(strange).tolist():
            edges, word = [*(np.flatnonzero(heads[i]) - 1).tolist(), int(lengths[i])], words[i]
            own = self.spell([word[a:b] for a, b in zip(edges, edges[1:], strict=False)])
            spelled += own
            many[i] = len(own)
        out = np.empty(many.sum(), dtype=np.uint32)
        anew = np.repeat(strange, many)
        out[~anew], out[anew] = plain, spelled
        return out, many

    def spell(self, parts: Sequence[str]) -> list[int]:
        """Ids of merged parts; what the vocabulary lacks goes in bytes."""
        out: list[int] = []
        for part in parts:
            found = self.ids.get(part)
            if found is None:
                out += [self.byte_ids[b] for b in part.encode("utf-8", "replace")]
            else:
                out.append(found)
        return out

    def key(self, word: str, seed: int, variant: int, place: int = 0) -> int:
        """What decides about a word's candidates: ``place`` counts the words before it in its text."""
        base = (text_key(seed, variant) + place * _STEP) & _MASK
        return mixed(base ^ zlib.crc32(word.encode("utf-8", "replace")))

    def known(self, seed: int, variant: int, share: float) -> Words:
        """What is remembered of words; it is the same for all seeds, variants and shares."""
        return self.words

    def encode(self, text: str, seed: int = 0, variant: int = 0, share: float = 0.0) -> bytes:
        """Ids of a text, four little-endian bytes each."""
        return self.encode_many([text], [variant], seed, share)[0]

    def encode_many(
        self, texts: Sequence[str], variants: Sequence[int], seed: int, share: float
    ) -> list[bytes]:
        """:meth:`encode` of many texts, side by side."""
        out: list[bytes] = []
        words: list[str] = []
        sizes: list[int] = []
        first = 0

        def flush() -> None:
            nonlocal first
            keys = np.array([text_key(seed, v) for v in variants[first : first + len(sizes)]], dtype=np.uint64)
            ends = np.cumsum(sizes)
            places = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
            base = np.repeat(keys, sizes) + places.astype(np.uint64) * np.uint64(_STEP)
            ids, many = [], []
            for at in range(0, len(words), _TOGETHER):
                to = at + _TOGETHER
                some = self.words.pieces(words[at:to], base[at:to], share)
                ids.append(some[0].astype("<u4").tobytes())
                many.append(some[1])
            raw = b"".join(ids)
            edges = 4 * np.r_[0, np.cumsum(np.concatenate([*many, np.zeros(0, dtype=np.int64)]))]
            for a, b in zip(edges[ends - sizes].tolist(), edges[ends].tolist(), strict=True):
                out.append(raw[a:b])
            first += len(sizes)
            words.clear()
            sizes.clear()

        for n, text in enumerate(texts):
            if MARK in text:
                if sizes:
                    flush()
                out.append(self._with_marks(text, seed, variants[n], share))
                first += 1
                continue
            if not text:
                own = []
            elif "  " not in text and text[0] != " " and text[-1] != " ":
                own = text.split(" ")
            else:
                own = [word[1:] for word in _WORD.findall(MARK + text.replace(" ", MARK))]
            words += own
            sizes.append(len(own))
            if len(words) >= _TOGETHER:
                flush()
        if sizes:
            flush()
        return out

    def _with_marks(self, text: str, seed: int, variant: int, share: float) -> bytes:
        """A text with marks of its own: these are spelled in bytes between its other parts."""
        out: list[int] = []
        place = 0
        for n, part in enumerate(text.split(MARK)):
            if n:
                out += [self.byte_ids[b] for b in MARK.encode()]
            for word in _WORD.findall(("" if n else MARK) + part.replace(" ", MARK)):
                out += self.merge(word, self.key(word, seed, variant, place), share)
                place += 1
        return np.array(out, dtype="<u4").tobytes()

    def decode(self, ids: bytes | Sequence[int]) -> str:
        """The text that these ids were made from."""
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, dtype="<u4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace")  # without the blank put before the text


_COLUMNS = "n_pieces long, ids_crc32 long, lossless boolean"


def encode(
    docs: DataFrame,
    path: str,
    seed: int,
    share: float,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``variant``, ``n_pieces``, ``ids_crc32``, ``lossless`` for every row.

    A row's variant is the 64-bit hash of its id with the seed, or of its text where it has no id, so
    there are as many variants as documents.  ``lossless`` compares the decoded ids with the text.  ``with_ids`` adds the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_store(f"pieces:{path}:{seed}:{share}", lambda: PieceModel(path))
        for batch in batches:
            variant_of = batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            counts, sums, same, lists = [], [], [], []
            for text, ids in zip(texts, model.encode_many(texts, variant_of, seed, share), strict=True):
                counts.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                same.append(model.decode(ids) == text)
                if with_ids:
                    lists.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "variant", "n_pieces", "ids_crc32", "lossless"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed)))
        .otherwise(F.xxhash64("doc_id", F.lit(seed)))
        .alias("variant"),
        "text",
    )
    schema = f"doc_id long, variant long, {_COLUMNS}" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (rows with ``ids``) with the decoded ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_store(f"pieces:{path}", lambda: PieceModel(path))
        for batch in batches:
            texts = [model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
