"""SimHash near-dedup: a binary trie self-join of fingerprints.

A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 hashes have it
set.  Distinct fingerprints form a binary trie.  Pairs of nodes are traversed together from the
root: children meet children, differing bits add up, and a pair is pruned once its bits pass the
budget.  Spark deals out the pairs of nodes at one depth; each task goes on below it.

Three differing bits leave at most one in one half of the 64 bits.  So the trie is built twice,
with either half above the other, and above the middle the budget is one bit.  Near the root this
leaves each node its own pair and one per level, instead of all pairs within three bits.

Null and empty texts have fingerprint zero, which links like any other.  Copies share a
fingerprint and are met once.  A null ``doc_id`` never becomes a component's id unless no member
has one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import looked_up
from strataspark.llm.components import connected
from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_NODE_ROWS = 256  # fingerprints a node holds on average where Spark deals out pairs of nodes
_TASK_ROWS = 500_000  # rows a task of the self-join gets on average
_FRONTIER = 1 << 20  # node pairs expanded at once
_LEAF = 16  # node pairs with at most so many leaf pairs are expanded to these


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    parts = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = np.fromiter(
        (digest(s, SEED) for s in map(b" ".join, parts)), np.uint64, len(words) - shingle + 1
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def marked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            found = np.array([fingerprint(t) for t in part], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.withColumn(to, marked.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component: as many as a forest needs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low = np.minimum(ru, rv)
        new = root.copy()
        np.minimum.at(new, ru, low)
        np.minimum.at(new, rv, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def trie_links(
    keys: np.ndarray, groups: np.ndarray, depth: int, max_bits: int = MAX_BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``keys`` (uint64), as the edges of a spanning forest.

    ``groups`` names the pair of nodes at ``depth`` that a key takes part in: its last six bits
    are 0 for a node met with itself, else 1 + the prefix bit in which the two nodes differ.
    Budgets hold per depth: max_bits // 2 down to the middle, then max_bits.
    """
    order = np.lexsort((keys, groups))
    keys, groups = keys[order], groups[order]
    heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(keys) else np.zeros(0, int)
    tails = np.r_[heads[1:], len(keys)].astype(np.int64) if len(keys) else heads
    names = groups[heads]
    flipped = (names & 63).astype(np.int64)
    own = flipped == 0
    split = tails.copy()
    for g in np.unique(flipped[~own]).tolist():
        # A pair's first node has the bit clear and so comes first.
        bit = ((keys >> np.uint64(64 - depth + g - 1)) & np.uint64(1)).astype(np.int64)
        ones = np.r_[0, np.cumsum(bit)]
        here = flipped == g
        split[here] = tails[here] - (ones[tails[here]] - ones[heads[here]])
    first = np.stack([heads, np.where(own, tails, split)])
    second = np.stack([np.where(own, heads, split), tails])
    frontier = np.vstack([first, second, (~own).astype(np.int64)[None]])
    frontier = frontier[:, (frontier[1] > frontier[0]) & (frontier[3] > frontier[2])]
    sums: dict[int, np.ndarray] = {}
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    waiting = 0
    stack = [(depth, frontier)]
    while stack:
        level, nodes = stack.pop()
        if not nodes.shape[1]:
            continue
        if nodes.shape[1] > _FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(level, nodes[:, half:]), (level, nodes[:, :half])]
            continue
        same = nodes[0] == nodes[2]
        n1, n2 = nodes[1] - nodes[0], nodes[3] - nodes[2]
        leaf = (n1 * n2 <= _LEAF) | (level == 64)
        for i, j in _leaf_pairs(nodes[:, leaf]):
            near = (i != j) & (_popcount(keys[i] ^ keys[j]) <= max_bits)
            found_a.append(keys[i[near]])
            found_b.append(keys[j[near]])
            waiting += len(found_a[-1])
        if waiting > 4 * _FRONTIER:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, waiting = [a], [b], 0
        nodes, same = nodes[:, ~leaf], same[~leaf]
        if not nodes.shape[1]:
            continue
        if level not in sums:
            bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
            sums[level] = np.r_[0, np.cumsum(bit.astype(np.int64))]
        ones = sums[level]
        cut1 = nodes[1] - (ones[nodes[1]] - ones[nodes[0]])
        cut2 = nodes[3] - (ones[nodes[3]] - ones[nodes[2]])
        lo1, hi1, lo2, hi2, bits = nodes
        below = np.hstack(
            [
                np.stack([lo1, cut1, lo2, cut2, bits]),
                np.stack([cut1, hi1, cut2, hi2, bits]),
                np.stack([lo1, cut1, cut2, hi2, bits + 1]),
                np.stack([cut1, hi1, lo2, cut2, bits + 1])[:, ~same],
            ]
        )
        budget = max_bits // 2 if level < 32 else max_bits
        alone = (below[0] == below[2]) & (below[1] - below[0] < 2)
        some = (below[1] > below[0]) & (below[3] > below[2])
        stack.append((level + 1, below[:, some & ~alone & (below[4] <= budget)]))
    if not found_a:
        return keys[:0], keys[:0]
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _leaf_pairs(nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs below pairs of nodes, some million at a time."""
    sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + (1 << 21), side="right")))
        n, some = sizes[at:to], nodes[:, at:to]
        which = np.repeat(np.arange(to - at), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (some[3] - some[2])[which]
        yield some[0][which] + k // width, some[2][which] + k % width
        at = to


def links(prints: DataFrame, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` that connect what links among distinct ``fingerprint`` values.

    Every fingerprint goes to its node's own pair and to one pair per level above ``depth``, in
    either trie; ``depth`` grows with the logarithm of the ``rows``.
    """
    if max_bits // 2 > 1:
        raise ValueError("at most three differing bits")
    depth = min(32, max(2, math.ceil(math.log2(max(rows, 1) / _NODE_ROWS + 1))))
    turned = prints.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("turn"), F.col("fingerprint").alias("key")),
                F.struct(
                    F.lit(1).alias("turn"),
                    F.shiftleft("fingerprint", 32)
                    .bitwiseOR(F.shiftrightunsigned("fingerprint", 32))
                    .alias("key"),
                ),
            )
        ).alias("t")
    ).select("t.turn", "t.key")
    node = F.shiftrightunsigned("key", 64 - depth)
    ids = [F.shiftleft(node, 6)] + [
        F.shiftleft(node.bitwiseAND(F.lit(~(1 << b))), 6) + F.lit(b + 1) for b in range(depth)
    ]
    dealt = turned.select(
        "turn",
        "key",
        F.explode(F.array(*ids)).alias("g"),
    )
    parts = max(
        int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(2 * rows * (depth + 1) / _TASK_ROWS),
    )
    cut = depth

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = list(frames)
        if not all_rows:
            return
        whole = pd.concat(all_rows)
        for turn, part in whole.groupby("turn"):
            keys = part["key"].to_numpy(np.int64).view(np.uint64)
            a, b = trie_links(keys, part["g"].to_numpy(np.int64), cut, max_bits)
            if turn:
                a, b = ((x << np.uint64(32)) | (x >> np.uint64(32)) for x in (a, b))
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.repartition(parts, "turn", "g").mapInPandas(meet, "a long, b long")


def components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs (doc_id, fingerprint)``.

    Fingerprints and links stay in Spark.
    """
    prints = cut_lineage(
        docs.groupBy("fingerprint").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        )
    )
    rows, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    rooted = _rooted(prints, rows, max_bits)
    least = rooted.groupBy("root").agg(
        F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")
    )
    named = looked_up(rooted, least, "root", "members", rows)
    named = cut_lineage(named.select("fingerprint", "component_id", "copies"))
    found = looked_up(docs.select("doc_id", "fingerprint"), named, "fingerprint", "copies", total)
    return found.select("doc_id", "fingerprint", "component_id")


def _rooted(prints: DataFrame, rows: int, max_bits: int) -> DataFrame:
    """Distinct fingerprints with the ``root`` of their component, a fingerprint itself."""
    roots = connected(links(prints.select("fingerprint"), rows, max_bits))
    return prints.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text)``."""
    marked = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return components(cut_lineage(marked.select("doc_id", "fingerprint")), max_bits)


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id``, then the least text hash.

    So rows that repeat an id are copies only if their texts link, and an id whose texts lie in several
    components stays once in each where it is the smallest.  Rows without an id stay (nothing tells
    them apart).  Rows that agree in id and text are reduced map-side before they move.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null")
    keys = named.select("doc_id", "text").withColumn("_hash", hashed)
    marked = cut_lineage(with_fingerprint(keys).select("doc_id", "_hash", "fingerprint"))
    own = F.struct("doc_id", "_hash")
    prints = cut_lineage(marked.groupBy("fingerprint").agg(F.min(own).alias("first")))
    rooted = _rooted(prints, prints.count(), max_bits)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    once = (
        named.withColumn("_hash", hashed)
        .groupBy("doc_id", "_hash")
        .agg(F.first(F.struct(*others)).alias("_row"))
    )
    stay = once.join(kept, ["doc_id", "_hash"], "left_semi").select("doc_id", "_row.*")
    return stay.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def hexadecimal(column: str) -> F.Column:
    """A fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
