"""The conversation trie against one built node by node, over few and many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slidelake.llm import prefix_trie
from slidelake.llm.prefix_trie import conversation_trie, trie_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            content = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append((turn is not None, turn or 0, hashlib.md5(content.encode()).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in (p[-1][1] if p else "").replace("\t", " ").replace("\n", " ").split(" ") if w])
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    out = []
    for p, m in members.items():
        joined = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["a", "b c", "", None, "d\ne f", "é"]
    rows = []
    for c in r.sample(range(-60, 4 * n), n):
        rows += [(c, t, r.choice(["user", "assistant"]) if r.random() < 0.9 else None, r.choice(words[: 1 + c % 6])) for t in range(r.randint(1, 6))]
    rows += [(7000, t, "user", "same") for t in range(300)] + [(7001, t, "user", "same") for t in range(290)]
    rows += [(8000 + i, t, "user", f"copy {t}") for i in range(120) for t in range(4)]
    rows += [(9000, None, "user", "x"), (9000, None, "user", "x"), (9000, 1, "a", "z"), (9000, 1, "a", "y"), (None, 1, "user", "nobody"), (9001, 0, "user", "w " * 50_000)]
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 50_000), (2, 3), (3, 25)])
def test_trie_equals_node_by_node(spark, monkeypatch, seed, size):
    monkeypatch.setattr(prefix_trie, "ROWS", size)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = rows_of(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("at", "words", "digest", "key", "depth", "n")})
    got = sorted(repr(tuple(r)) for r in conversation_trie(df).collect())
    assert got == expected(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = spark.createDataFrame([(i, b"", []) for i in range(3)], "conv_id long, sequence binary, words array<int>")
    (root,) = trie_nodes(turnless).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves) == (0, 0, None, 3, 0, 1)
    assert root.ends_sha256 == hashlib.sha256(b"0,1,2").hexdigest()
