import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quillstone.llm import prefix_trie
from quillstone.llm.prefix_trie import build_trie, nearest_smaller, shared_turns

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = (*own.get(c - c % 100, [])[:h], *turns[h:])
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences(rows).items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p, m in members.items():
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(trie):
    assert tuple(trie.columns) == NAMES
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in trie.collect())


def talks(seed, n=120, words=2, depth=7):
    """Conversations that branch often, with copies, prefixes of others, and some far longer ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, "user" if t % 2 else None, f"text {rng.randrange(words)}" * rng.randint(1, 2)) for t in range(rng.randint(1, depth))]
    return rows


@pytest.mark.parametrize("seed, a_block", [(0, 1 << 15), (1, 3), (2, 10), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, a_block):
    monkeypatch.setattr(prefix_trie, "BLOCK_ENTRIES", a_block)
    rows = talks(seed, words=seed + 1)
    assert found(build_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_copies_over_many_blocks_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_ENTRIES", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 100)
    rows = [(c, t, "r", f"same {t}") for c in range(0, 3000, 100) for t in range(6)]
    rows += [(c, t, "r", f"same {t}" if t < 3 else f"own {c} {t}") for c in range(5000, 6000, 100) for t in range(5)]
    rows += [(7000, t, "r", "x" * (t % 5)) for t in range(400)] + [(7100, t, "r", "x" * (t % 5)) for t in range(300)]
    assert found(build_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_repeated_rows_turnless_and_absent_bases(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_ENTRIES", 2)
    rows = [
        (101, 0, "a", "x"), (102, None, None, None), (102, 1, "a", None), (102, 0, None, "y"), (None, 0, "a", "lost"), (None, None, None, None),
        (103, 0, "a", "x"), (103, 0, "a", "x"), (104, 5, "é", "\U0001f600"), (200, 0, "a", "x"), (205, 0, "b", "x"), (205, 1, "b", "x"), (206, 0, "", ""), (-7, 0, "n", "neg"),
    ]
    odd = spark.createDataFrame([(*r, i, "s", 1, "p") for i, r in enumerate(rows)], SCHEMA + ", depth int, seq string, n int, part string")
    assert () in sequences(rows).values()  # as its base is absent, one is cut to nothing
    assert found(build_trie(odd)) == brute(rows)


def test_one_and_none(spark):
    assert build_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert build_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    one = [(0, 0, "a", "b"), (0, 1, "a", "c")]
    assert found(build_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_nearest_smaller_and_shared_turns():
    rng = random.Random(4)
    for _ in range(50):
        values = [rng.randrange(6) for _ in range(rng.randint(1, 30))]
        nodes, of = nearest_smaller(values)
        for i, v in enumerate(values):
            left = max((j for j in range(i) if values[j] < v), default=None)
            right = min((j for j in range(i + 1, len(values)) if values[j] < v), default=None)
            assert nodes[of[i]][:3] == [v, left, right]
        assert [n[3] for n in nodes] == [Counter(of)[i] for i in range(len(nodes))]
    for n in range(1, 40):
        for m in (0, 1, n // 2, n):
            a, b = b"".join(bytes([i]) * 16 for i in range(n)), b"".join(bytes([i if i < m else 200]) * 16 for i in range(n))
            assert shared_turns(a, b) == min(m, n)
            assert shared_turns(a, a[: 16 * m]) == m
