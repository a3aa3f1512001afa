"""Line templates and licence scans against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from slidelake.llm.licences import TEMPLATES, WHOLE_TEXTS, TemplateIndex, bigrams, scan_licences, words
from slidelake.llm.line_templates import without_recurring_lines
from slidelake.llm.queries import op4_line_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_lines(rows, depth=3, min_docs=3, min_tokens=3, similarity=0.7, min_fixed=8):
    """Rows are (doc_id, text); equal rows are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    lines, pairs = [], defaultdict(set)
    for row in docs:
        for i, line in enumerate(row[1].split("\n") if row[1] is not None else []):
            t = tuple(mask(x) for x in SPACE.split(line) if x)
            if len(t) >= min_tokens:
                lines.append((row, i, t, (len(t), *t[:depth])))
                pairs[lines[-1][3]].add((row, t))
    majority = {}
    for leaf, held in pairs.items():
        if leaf[0] >= min_fixed and len(held) >= min_docs and len({t for _, t in held}) > 1:
            top = [max(Counter(column).items(), key=lambda x: (x[1], x[0])) for column in zip(*[t for _, t in held])]
            majority[leaf] = [token if 2 * n >= len(held) else "<*>" for token, n in top]
    template_docs, of = defaultdict(list), defaultdict(list)
    for row, i, t, leaf in lines:
        if sum(x != "<*>" for x in t) >= similarity * len(t) - 1e-9:
            of[row, i].append(("own", leaf, t))
        if leaf in majority:
            agree = sum(a == b != "<*>" for a, b in zip(t, majority[leaf]))
            if agree >= min_fixed and agree >= similarity * len(t) - 1e-9:
                of[row, i].append(("leaf", leaf))
        for template in of[row, i]:
            if row not in template_docs[template]:
                template_docs[template].append(row)
    out = Counter()
    for row in rows:
        if row[1] is None:
            out[row[0], None, 0, 0] += 1
            continue
        all_lines = row[1].split("\n")
        gone = {i for i in range(len(all_lines)) for t in of.get((row, i), []) if len(template_docs[t]) >= min_docs and template_docs[t][0] != row}
        out[row[0], "\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(all_lines), len(gone)] += 1
    return out


def line_rows():
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta omega sigma kappa zeta theta iota".split())
    rows = []
    for i in range(40):
        lines = [" ".join(word() + str(r.randint(0, 99)) * (r.random() < 0.1) for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 5))]
        lines.insert(0, f"Posted by user{i} at {r.randint(0, 23)}:00 in the forum about many things")
        if i % 3 == 0:
            lines.append("All rights reserved by the owner of this page")
        if i % 7 == 0:
            lines.append(f"See page {word()} of the big book for more on this subject today")
        rows.append((i, "\n".join(lines)))
    long = "\n".join("line of words number and more words here" for _ in range(3000))
    return rows + [(100 + i, rows[1][1]) for i in range(5)] + [(7, rows[7][1]), (None, "a b c d"), (None, None), (200, ""), (201, "\n\n"), (202, None), (203, long), (204, long), (205, long)]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(d, t, "x", 1, t) for d, t in rows], "doc_id long, text string, leaf string, doc int, line string")
    got = Counter(tuple(r) for r in without_recurring_lines(df).collect())
    assert got == brute_lines(rows)
    assert sum(k[3] for k in got) > 50


def test_lines_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = Counter(tuple(r) for r in without_recurring_lines(df).collect())
    assert got == brute_lines([tuple(r) for r in df.collect()])


def test_no_lines(spark):
    assert without_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fields_with_recurring_values(spark):
    """Each value recurs, but no combination does."""
    authors, sections = [[f"{kind}{chr(97 + i)}{chr(97 + i // 5)}" for i in range(30)] for kind in ("author", "section")]
    line = lambda i, j: f"This article was written by {authors[i]} and was filed under {sections[j]} today"
    for size in (6, 30):
        rows = [(i * size + j, f"own{chr(97 + i)}{chr(97 + j)} text\n{line(i, j)}") for i in range(size) for j in range(size)]
        rows += [(10_000, "This article was written by nobody at all because there never was such a thing")]
        got = {r.doc_id: r.n_dropped for r in without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {d: int(0 < d < 10_000) for d, _ in rows}


def test_distinct_sentences_stay(spark):
    """However many documents there are: sentences that share their first words are no template."""
    r = random.Random(8)
    heads = ["She did not know", "It was a", "They went to the", "There is no"]
    words = [a + b for a in "ba ce di fo gu ha".split() for b in "ner lim tos vep rud".split()]
    for size in (3, 300, 30_000):
        sentences = set()
        while len(sentences) < 2 * size:
            sentences.add(" ".join([r.choice(heads), *r.choices(words, k=r.randint(1, 7))]))
        lines = sorted(sentences)
        rows = [(i, f"{lines[2 * i]}\n{lines[2 * i + 1]}\nThis page of {r.choice(words)} was last changed by its owner on a fine day") for i in range(size)]
        got = without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).agg(F.min("n_dropped"), F.max("n_dropped"), F.sum("n_dropped")).first()
        # The boilerplate goes everywhere but in the first document.
        assert tuple(got) == (0, 1, size - 1), size


def test_a_rare_word_varies_in_short_lines(spark, tmp_path):
    """What the query dropped before its rule of majorities and eight tokens it still drops: the words that vary are rare."""
    heads = [("Was filed under", ["Amber", "Birch", "Cedar", "Dune"]), ("the old mill road and the", ["bank", "bend"])]
    rows = [(i, f"own{i} text\n{heads[0][0]} {heads[0][1][i % 4]}.\nSee {heads[1][0]} {heads[1][1][i % 2]}") for i in range(4)]
    rows += [(9, "Was filed by nobody\nSee the old town road")]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(folder)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 0), 1: (3, 2), 2: (3, 2), 3: (3, 2), 9: (2, 0)}


def brute_licences(text, threshold=0.9):
    out, lines = [], (text or "").split("\n")
    units = [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]
    for i, unit in units:
        own = bigrams(words(unit))
        scored = []
        for name, template in TEMPLATES.items():
            other = bigrams(words(template))
            if own and 2 * len(own & other) / (len(own) + len(other)) >= threshold:
                scored.append((-2 * len(own & other) / (len(own) + len(other)), name))
        if scored:
            out.append((i, min(scored)[1], -min(scored)[0]))
    return out


def test_licences_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, None), (1, ""), (1, "..."), (2, TEMPLATES["MIT"].replace(". ", ".\n")), (3, TEMPLATES["MIT"].upper() + " extra"), (3, TEMPLATES["ISC"])]
    rows += [(4, "all rights   RESERVED"), (5, "released under the mit license. " * 3), (6, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, matches string")
    got = [(r.doc_id, [tuple(m) for m in r.matches]) for r in scan_licences(df).collect()]
    assert sorted(got, key=str) == sorted(((d, brute_licences(t)) for d, t in rows), key=str)
    assert sum(bool(m) for _, m in got) > 5


def brute_runs(text, templates, threshold=0.9):
    """Every run of lines against every template."""
    lines, found, taken = text.split("\n"), [], []
    sets = {name: bigrams(words(t)) for name, t in templates.items()}
    dice = lambda own, other: 2 * len(own & other) / (len(own) + len(other)) if own else 0
    bound = threshold / (2 - threshold)
    for a, b in [*((i, i) for i in range(len(lines))), *([(0, len(lines) - 1)] if len(lines) > 1 else [])]:
        own = bigrams(words("\n".join(lines[a : b + 1])))
        scored = min((-dice(own, s), name) for name, s in sets.items())
        if -scored[0] >= threshold:
            found.append((a if a == b else -1, scored[1], -scored[0]))
            taken.append((a, b, len(own)))
    best = {}
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            own = bigrams(words("\n".join(lines[a : b + 1])))
            for name, s in sets.items():
                if dice(own, s) >= threshold and words(lines[a]) and words(lines[b]):
                    best[a, name] = min(best.get((a, name), (0,)), (-dice(own, s), b - a + 1, a, name, b, len(own)))
    for d, _, a, name, b, n in sorted(best.values()):
        if not any(x <= b and a <= y and n * bound <= m <= n / bound for x, y, m in taken):
            found.append((a, name, -d))
            taken.append((a, b, n))
    return sorted(found)


def test_whole_licences_and_wrapped_notices(spark):
    mit, header = WHOLE_TEXTS["MIT-text"], WHOLE_TEXTS["Apache-2.0-notice"]
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(400))
    commented = "\n".join("# " + line for line in ["Copyright 2020 Somebody", *header.strip().split("\n")])
    texts = [mit, f"The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n{mit}", f"{code}\n{commented}\n{code}", f"{code}\n\n{mit}\n{code}\n{mit}"]
    texts += [f"{code}\nAll rights\nreserved.\n{code}", code, *WHOLE_TEXTS.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in scan_licences(df).collect()}
    assert "MIT-text" in {m[1] for m in got[0]} and "MIT-text" in {m[1] for m in got[1]}
    assert [m[:2] for m in got[2] if m[1] == "Apache-2.0-notice"] == [(401, "Apache-2.0-notice")]
    assert [m[1] for m in got[3]].count("MIT-text") == 2
    assert [m[:2] for m in got[4]] == [(400, "All-rights-reserved")] and got[5] == []
    for name, found in zip(WHOLE_TEXTS, [got[i] for i in range(6, len(texts))], strict=True):
        assert (-1, name, 1.0) in found


def test_runs_match_brute_force():
    r = random.Random(2)
    templates = {"a": "one two three four five six seven eight nine ten", "b": "one two three four five", "c": "two three four five six", "d": "one"}
    index, hits = TemplateIndex(templates, 0.9), 0
    for _ in range(600):
        text = " ".join(r.choice([templates["a"], templates["b"], r.choice(templates["a"].split()), "other words", "..."]) for _ in range(r.randint(1, 6)))
        text = re.sub(" ", lambda m: "\n" if r.random() < 0.3 else " ", text)
        assert sorted(index.scan(text)) == brute_runs(text, templates)
        hits += len(index.scan(text))
    assert hits > 300
