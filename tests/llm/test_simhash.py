"""Fingerprints, trie self-join and components against brute force."""

import numpy as np
import pytest
import xxhash

from strataspark.llm import common, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component ids by all pairs, for ``[(id, fingerprint)]``."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    members = {}
    for i in range(len(prints)):
        members.setdefault(find(i), []).append(prints[i][0])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(prints))]


@pytest.mark.parametrize(
    "text",
    ["", "  \n", "One", "Two words", "A b c D e", "Élan É élan x y z", "w\x0bx\x0cy\rz " * 70],
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(rng, clusters, each):
    found = []
    for _ in range(clusters):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(each):
            flips = rng.integers(0, 64, rng.integers(0, 6))
            x = base
            for f in flips.tolist():
                x ^= 1 << f
            found.append(x)
    return found


@pytest.mark.parametrize("depth", [2, 7, 13, 32])
def test_trie_links_connect_what_all_pairs_connect(depth):
    rng = np.random.default_rng(depth)
    keys = sorted(set(clustered(rng, 12, 40) + [0, 1, 3, 7, 15, 31, 2**64 - 1]))
    edges = []
    for turn in (0, 1):
        turned = [((k << 32) | (k >> 32)) & (2**64 - 1) if turn else k for k in keys]
        rows = []
        for k in turned:
            node = k >> (64 - depth)
            rows.append((k, node << 6))
            rows += [(k, ((node & ~(1 << b)) << 6) | (b + 1)) for b in range(depth)]
        a, b = simhash.trie_links(
            np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), depth
        )
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            edges.append(
                tuple(((k << 32) | (k >> 32)) & (2**64 - 1) if turn else k for k in (x, y))
            )
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in edges:
        root[find(x)] = find(y)
    got = {}
    for k in keys:
        got.setdefault(find(k), []).append(k)
    wanted = plain_components([(k, k) for k in keys])
    least = {k: min(g) for g in got.values() for k in g}
    assert [least[k] for k in keys] == wanted


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fingerprint string")


@pytest.mark.parametrize("frequent", [1000, 4, 0])
def test_components_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(common, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(25):
        base = [WORDS[i] + str(rng.integers(0, 99)) for i in rng.integers(0, len(WORDS), 120)]
        texts += [" ".join(base)] * int(rng.integers(1, 5))
        for _ in range(4):
            near = list(base)
            near[int(rng.integers(0, 120))] = "changed"
            texts.append(" ".join(near))
    texts += ["", None, "  ", "same"] + ["same"] * 70 + ["long text " * 30_000]
    ids = rng.permutation(len(texts)).tolist()
    rows = [(i, t, "s", "clash") for i, t in zip(ids, texts, strict=True)]
    rows += [(None, "same", "s", "clash"), (None, "only without an id", None, None), rows[0]]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [(r[0], plain_fingerprint(r[1] or "")) for r in rows]
    wanted = sorted(
        zip([p[0] for p in prints], [p[1] for p in prints], plain_components(prints), strict=True),
        key=repr,
    )
    got = sorted(((r[0], r[1] % (1 << 64), r[2]) for r in found), key=repr)
    assert got == wanted


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rows = [
        (4, "a b c d e", "x", "p"),
        (2, "A b c d e", "y", "q"),
        (9, "other words here now", "z", "r"),
        (9, "other words here now", "z", "r"),
        (None, "a b c d e", "n", "s"),
    ]
    kept = simhash.one_of_each(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "fingerprint"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)


def test_no_rows(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0
