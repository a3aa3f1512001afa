"""The Merkle manifest against a plain recomputation, and its edge cases."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slidelake.llm.merkle import proven, verified_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of a list of digests, and for each of them its siblings on the way up."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, at in enumerate(places):
            first = at - at % 3
            proofs[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
            places[i] = at // 3
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def expected(rows, changed):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, upper = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, _, leaf, r), below in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            node = leaf_of(changed(r))
            for before, after in below + above:
                node = digest(before, node, after)
            proof = digest(*[b + a for b, a in below + above])
            out.append((r[0], leaf, trees[s][0], root, proof, node, node == root))
    return sorted(map(repr, out))


def rows_of(n_sources, sizes):
    rows = [(i * 7 % 5000, f"s{s}", ["en", None][i % 2], i, f"text {i}\nline é") for s in range(n_sources) for i in range(sizes[s % len(sizes)])]
    return rows + [(None, None, None, None, None), (None, None, None, None, None), (3, None, "", 0, ""), (1, "é", "en", 5, "x" * 300_000), (1, "é", "en", 5, "y\n")]


@pytest.mark.parametrize(("n_sources", "sizes"), [(1, [1]), (3, [1, 81, 82]), (100, [3, 2, 1]), (4, [700, 1, 9, 28])])
def test_merkle_equals_recomputation(spark, n_sources, sizes):
    rows = rows_of(n_sources, sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # Clashing names of columns that take no part.
    df = df.withColumns({c: F.lit(1) for c in ("leaf", "root", "rank", "tree", "digest", "down", "size")})
    got = verified_documents(df, text=F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    have = sorted(repr(tuple(r)) for r in got.collect())
    strip = lambda r: (*r[:4], r[4].replace("\n", "") if r[4] and r[0] is not None and r[0] % 2 == 0 else r[4])
    assert have == expected(rows, strip)


def test_merkle_of_nothing_and_of_one(spark):
    assert verified_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    (one,) = verified_documents(spark.createDataFrame([(1, "a", "en", 1, "x")], SCHEMA)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest()


def test_proofs_belong_to_their_leaf_alone(spark):
    df = spark.createDataFrame([(i, "a", "en", 1, f"t{i}") for i in range(200)], SCHEMA)
    for r in proven(df).limit(20).collect():
        node = r.leaf
        for s in r.proof:
            node = digest(s.before, node, s.after)
        assert node == r.root and len(r.proof) == 5
