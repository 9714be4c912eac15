"""The prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fleetspark.llm import trie

SHAPE = "conv_id bigint, turn bigint, role string, text string, name string, depth int, start string, k int"


def frame(spark, rows):
    """The rows, with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "n", 7, "s", 3) for r in rows], SHAPE)


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole = tuple(own.get(base, [])[:h] + seq[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(ends[p])).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, **options):
    out = trie.prefix_trie(frame(spark, rows), **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, longest)):
            rows.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("block", [1, 2, 4, 32])
def test_prefixes(spark, block):
    rows = random_rows(block, 60, 14, ["a", "b", "é", None])
    assert found(spark, rows, block=block) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_edges(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, "user", "first"), (0, 3, None, None), (0, 3, None, ""), (0, 3, "a", "x"), (0, 3, "a", "x"),
        (-7, 1, "user", "below zero"), (-5, 1, "user", "below zero"), (1 << 40, 0, "user", "far" * 50_000), (2, 0, "user", "own"),
        (3, 5, "us", "er"), (3, 6, "use", "r"), (4, 10**15, "user", "late"), (4, -(10**15), "user", "early"),
    ]
    assert found(spark, rows) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    # members that have no turns end at the root
    short = [(c, 0, "user", f"t{c}") for c in range(1, 300)]
    got = found(spark, short)
    assert got == sorted(plain(short), key=lambda r: (r[0], r[1]))
    assert got[0][:2] == (1, 0) and got[0][7] != hashlib.sha256(b"").hexdigest()
    assert found(spark, [(None, 0, "user", "lost")]) == []
    assert trie.prefix_trie(frame(spark, short).where("false")).count() == 0


def test_tall_and_copied(spark):
    """One conversation of 700 turns with copies that leave it early and late, and many of one turn that are alike."""
    tall = [(10 * c, t, "user" if t % 2 else "assistant", f"turn {t}" if t < 90 * c + 8 else f"own {c}") for c in range(7) for t in range(700)]
    alike = [(1000 + c, 0, "user", "same") for c in range(4000)]
    for block in (8, 32):
        assert found(spark, tall + alike, block=block) == sorted(plain(tall + alike), key=lambda r: (r[0], r[1]))
