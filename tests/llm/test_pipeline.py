"""Every stage against its own input, on the table and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_jaccard import brute as components

AWKWARD = [
    (1, None, None, None, 0, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, "... 123 !!", "en", "a", 0, "x"),
    (4, "one two three four five six seven", "en", None, 0, "x"),
    (4, "one two three four five six seven", "en", None, 0, "x"),
    (5, "one two three four five six seven", "de", "b", 0, "x"),
    (None, "un deux trois quatre cinq", "fr", "b", 0, "x"),
    (None, "un deux trois quatre cinq", "fr", "b", 0, "x"),
    (6, "word " * 40_000, "en", "a", 0, "x"),
    (7, "eins zwei drei", None, "c", 0, "x"),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, `t my.doc` string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def contaminated(texts, items):
    """Whether words inside occurrences of 13-word windows of an item make up 5 % of a text's words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for w in map(words, items):
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[min(13, len(w))].add(tuple(w[i : i + 13]))
    out = []
    for w in map(words, texts):
        hit = {p for k, grams in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams for p in range(i, i + k)}
        out.append(bool(hit) and 20 * len(hit) >= len(w))
    return out


def mixed_copies(docs):
    """(doc_id, text): copies, from the words that a mix by weights 5, 2, 1 takes of each document's place in its stream."""
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    by = defaultdict(list)
    for d, text, source in docs:
        by[source].append((hashlib.md5(f"42|{'' if d is None else d}".encode()).hexdigest(), (d is not None, d or 0), size(text), d, text))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in by[s]) for s in order}
    weight, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order)
    while True:
        share = (sum(total.values()) - sum(3 * total[s] for s in order if s not in left)) / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * share > 3 * total[s]}
        if not above:
            break
        left -= above
    out = Counter()
    for s in order:
        words = min(int((weight[s] * share if s in left else 3.0 * total[s]) + 0.5), 3 * total[s])
        start = 0
        for _, _, n, d, text in sorted(by[s], key=lambda x: x[:3]):
            if n:
                taken = words // total[s] * n + max(0, min(start + n, words % total[s]) - start)
                out[d, text] += taken // n + (2 * (taken % n) >= n)
            start += n
    return Counter({k: v for k, v in out.items() if v})


def check_stages(spark, docs, sf_dir):
    by_text = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    kinds = docs.dtypes

    out = P.language_id(spark, docs, sf_dir).cache()
    assert out.dtypes == kinds
    want = [(d, t) for d, t in by_text(docs) if t and any(c.isalpha() for c in t)]
    assert by_text(out) == sorted(want, key=str)

    docs, out = out, P.near_duplicates(spark, out, sf_dir).cache()
    assert out.dtypes == kinds
    before = [(r.doc_id, r.text) for r in docs.collect()]
    firsts = {c for d, n, c in components(before) if d is not None and n and c == d}
    got = [r.doc_id for r in out.collect()]
    assert sorted(d for d in got if d is not None) == sorted(firsts)

    docs, out = out, P.benchmark_decontamination(spark, out, sf_dir).cache()
    assert out.dtypes == kinds
    before, items = docs.collect(), [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = contaminated([r.text for r in before], items)
    assert rows(out) == sorted((tuple(r) for r, b in zip(before, bad) if not b), key=str)

    docs, out = out, P.source_mix(spark, out, sf_dir).cache()
    assert out.dtypes == kinds
    counts = {}
    for r in rows(out):
        counts[r] = counts.get(r, 0) + 1
    assert set(counts) <= set(rows(docs)) and max(counts.values(), default=0) <= 3
    want = mixed_copies([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert Counter(by_text(out)) == want

    docs, out = out, P.token_output(spark, out, sf_dir)
    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want, got = [], []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, P.END_ID], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in sorted(out.collect(), key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        got.append((r.doc_id, r.n_tokens, r.ids_crc32))
    assert [d for d, _, _ in got] == sorted((d for d, _, _ in got), key=lambda d: (d is not None, d))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_on_the_table(spark, sf_dir):
    check_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_stages_on_awkward_rows(spark, sf_dir):
    check_stages(spark, spark.createDataFrame(AWKWARD, KIND), sf_dir)


def test_near_copies_without_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (58, 59)]
    docs = spark.createDataFrame([(None, t, "en", "a", 0, "x") for t in [" ".join(words), *near, "quite another text of six words", "a b"]], KIND)
    got = [r.text for r in P.near_duplicates(spark, docs, sf_dir).collect()]
    assert len(got) == 3 and {"quite another text of six words", "a b"} < set(got)


def test_stages_on_no_rows(spark, sf_dir):
    docs = spark.createDataFrame([], KIND)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        docs = out if stage is not P.token_output else docs


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.where(F.col("n_tokens") < 1).count() == 0 and out.count() > 0


def test_near_duplicates_shuffles_the_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.near_duplicates(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # From the result down to the join of the texts: only what works on rows that lie where they are needed.
    assert "SortMergeJoin" in plan and "Exchange" not in plan.partition("SortMergeJoin")[0]
