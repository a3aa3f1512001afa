"""Mixing, language, decontamination, URL rules and main text: twins, brute force, held-out accuracy and edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.llm import language, mixing
from slidelake.llm.decontaminate import ItemIndex, decontaminate
from slidelake.llm.html_text import leaf_blocks, main_texts, train
from slidelake.llm.labelled_pages import labelled_pages
from slidelake.llm.mixing import _needs, cycled_weights, mix_targets, mixed_documents, slot_schedule
from slidelake.llm.queries import QUERIES, URL_RULES
from slidelake.llm.urls import filter_urls, rules_table
from tests.compare import compare

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_twins(name, spark, sf_dir, con):
    run, sql = QUERIES[name]
    r = compare(run(spark, sf_dir), con, sql)
    assert r["ok"] and not r["types"] and r["rows"] > 0, r


# --- mixing


def mix_rows():
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), ["a", "b", "b", "b", "c", None, "é"][i % 7], 1) for i in range(300)]
    return rows + [(900, "w " * 9000, "a", 1), (901, None, "a", 1), (902, "", "empty", 1), (5, rows[5][1], rows[5][2], 1), (None, "x y", "b", 1), (None, "x y", "b", 1)]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = [r.asDict() for r in mixed_documents(df, block_words=64).collect()]
    assert len(got) == len(rows)
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    target, left = {}, set(order)
    while True:  # shares stop at three times a source's size until none is above
        share = (total - sum(3 * size[s] for s in order if s not in left)) / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * share > 3 * size[s]}
        if not above:
            break
        left -= above
    for s in order:
        target[s] = weight[s] * share if s in left else 3.0 * size[s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 0.5 + 1e-6
    again = [r.asDict() for r in mixed_documents(df.repartition(3), block_words=64).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 50_000), ("b", 30_000), ("c", 20_000)], "source string, source_size long")
    needs = _needs(mix_targets(cycled_weights(sizes)), 100, 3)
    need = {r.sid: r.need for r in needs.collect()}
    slots = sorted((r.slot, r.sid, r["rank"]) for r in slot_schedule(needs).collect())
    seen = defaultdict(int)
    for n, (_, sid, rank) in enumerate(slots, 1):
        assert rank == seen[sid] or n > sum(need.values()) - 20
        seen[sid] += 1
        # At every length each source has its share, but for a few slots.
        assert abs(seen[sid] - n * need[sid] / sum(need.values())) < 8
    assert dict(seen) == need


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixed_documents(empty).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in mixed_documents(none).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_slots_beyond_the_product_of_two_words(spark):
    """The points of slots from four thousand million on are those of exact arithmetic."""
    slots = [0, 1, 65_535, 65_536, 3_474_701_534, 4_000_000_000, 2**32 - 1, 2**32 + 5, 2**40 + 12_345]
    low, high = F.col("slot") % mixing.HALF, F.expr(f"slot div {mixing.HALF}") % mixing.HALF
    point = (low * mixing.GOLDEN + high * mixing.GOLDEN % mixing.HALF * mixing.HALF) % mixing.POINTS
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", point.alias("p")).collect()
    assert [r.p for r in got] == [s * mixing.GOLDEN % 2**32 for s in slots]


def test_mix_is_even_in_order(spark, sf_dir):
    """In order of first_slot the sources of the table come evenly: none waits much longer than its share."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixed_documents(documents, block_words=64).where("taken > 0").collect()
    by, end = defaultdict(set), max(r.first_slot for r in rows)
    for r in rows:
        by[r.source].add(r.first_slot)
    for source, slots in by.items():
        slots = sorted(slots)
        once = [s for s in slots if s <= end]
        gaps = [b - a for a, b in zip(once, once[1:])]
        assert max(gaps) <= 12 * sum(gaps) / len(gaps), source
    assert all((r.first_slot is None) == (r.taken == 0) for r in mixed_documents(documents).collect())


# --- language


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op2_language"][0](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert len(rows) > 20 and right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_presence_kernel_by_hand():
    p = language.Presence(3)
    of = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert abs(len(p.of("Ab, ab--cd")) - len(of(" ab ab cd "))) <= 1  # one place may hold two n-grams
    assert len(p.of("123 !!")) == 0 and len(p.of("")) == 0
    long = "abc def " * 400_000
    assert set(p.of(long)) == set(p.of("abc def abc def abc"))


def test_scores_are_the_kernel_machines():
    """The folded matrices give what the kernel row times the dual weights gives."""
    texts = ["the cat sat on the mat", "the dog ran", "le chat est là", "la souris et le chien"]
    p, bits = language.Presence(2), []
    for t in texts:
        row = np.zeros(1 << language.BITS, np.uint8)
        row[p.of(t)] = 1
        bits.append(np.packbits(row))
    names = ["en", "en", "fr", "fr"]
    model = language.fit(list(zip(names, bits, strict=True)), landmarks=4, ridge=1e-3, grams=2)
    sets = [set(p.of(t).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    root = vectors / np.sqrt(values)
    mapped, target = k @ root, np.array([[0.5, -0.5]] * 2 + [[-0.5, 0.5]] * 2)
    dual = root @ np.linalg.solve(mapped.T @ mapped + 4e-3 * np.eye(4), mapped.T @ target)
    for t in ["the mat", "le chat", "a"]:
        own = set(p.of(t).tolist())
        want = np.array([kernel(own, s) for s in sets]) @ dual
        (name,), (score,) = model.predict([t], p)
        assert name == ("en", "fr")[int(want.argmax())] and abs(score - (want.max() + 0.5)) < 1e-5


def test_language_edges(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "12 !?", "en", 1), (103, "日本", None, 1), (None, "the cat", None, 1), (104, "the dog " * 50_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, language.train(df)).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[104][0] == got[None][0] == "en" and got[103][0] in ("en", "fr")
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict(unlabelled, language.train(unlabelled)).collect()} == {"und"}
    assert language.predict(df.limit(0), language.train(df)).collect() == []


# --- decontamination


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD))
    w, hit, names = words(text or ""), set(), set()
    for item, t in items:
        v = words(t or "")
        size = min(13, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(str(item))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("group_chars", [2_000_000, 200])
def test_decontamination_by_brute_force(spark, group_chars):
    r = random.Random(4)
    word = lambda: r.choice("ab cd Ef gh é".split())
    items = [(i, " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(25)]
    items += [(i + 100, " ".join(word() + str(r.randint(0, 99)) for _ in range(r.choice([1, 4, 13, 40])))) for i in range(20)] + [(3, items[3][1]), (500, None), (501, "...")]
    docs = []
    for i in range(80):
        w = [word() + r.choice(["", "", "1", "7"]) for _ in range(r.randint(0, 60))]
        at = r.randint(0, len(w))
        own = items[r.randrange(45)][1].upper().split()
        docs.append((i, " ".join(w[:at] + own[: r.randint(0, 40)] + w[at:])))
    docs += [(None, None), (1, ""), (1, "§$%"), (200, "zz " * 30_000 + items[44][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame([*items, (None, "no id at all")], "item_id long, text string")
    got = decontaminate(df, bench, group_chars=group_chars, cleaned=True).collect()
    have = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in got), key=str)
    want = [(d, *brute_hits(t, items)) for d, t in docs]
    assert have == sorted(((d, n, h, names, h > 0 and 20 * h >= n) for d, n, h, names in want), key=str)
    for x in got:
        left = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x.text or "").translate(FOLD)))
        assert left == x.n_words - x.n_hit
    assert decontaminate(df.limit(0), bench).collect() == []
    assert {x.n_hit for x in decontaminate(df, bench.limit(0)).collect()} == {0}


def test_automaton_tracks_longest_matches():
    index = ItemIndex([("a", b"x y z x y"), ("b", b"y z q")], 3)
    got = {(f, e, tuple(i)) for f, e, i in index.matches([b"z", b"x", b"y", b"z", b"q", b"x", b"y", b"z", b"x"])}
    assert got == {(0, 2, ("a",)), (1, 3, ("a",)), (2, 4, ("b",)), (5, 7, ("a",)), (6, 8, ("a",))}


# --- URL rules


def test_url_rules(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "http://badexample.com/en/", "http://a.net/es/1?x=/fr/", "http://net/fr/", "x.net/es/",
            "http://com", "http://com/", None, "", "ftp://q.org/com/", "http://a.com?y", "http://a.com#/en/", "http://b.net/ES/", "a://b://example.com/en/", "://net/es/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    got = {}
    for r in filter_urls(df, rules_table(spark, URL_RULES), ("page_id",)).collect():
        got.setdefault(r.page_id % len(urls), set()).add((r.host, r.path, r.rule, r.verdict))
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert got[i] == {(host, path, rule, verdict)}, u


def test_url_rules_without_whole_tokens(spark):
    df = spark.createDataFrame([(1, "http://a.b/foobar"), (2, "http://a.b/fo"), (3, "http://c.d/")], "page_id long, url string")
    rules = rules_table(spark, [("block", "a.b", "/foo"), ("block", "", "/zzz"), ("odd", "c.d", "")])
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules, ("page_id",)).collect()}
    assert got == {1: ("a.b/foo", "block"), 2: (None, "allow"), 3: ("c.d", "odd")}
    assert {r.verdict for r in filter_urls(df, rules.limit(0), ("page_id",)).collect()} == {"allow"}
    assert filter_urls(df.limit(0), rules, ("page_id",)).collect() == []


# --- main text


@pytest.fixture(scope="module")
def model():
    return train()


def test_held_out_pages(model):
    right = total = 0
    for html, marks in labelled_pages(80, seed=11):
        blocks = leaf_blocks(html)
        assert len(blocks) == len(marks)
        right += sum(a == b for a, (_, b) in zip(model.labels(blocks), marks, strict=True))
        total += len(marks)
    assert right / total > 0.98


def test_viterbi_is_the_best_sequence(model):
    for html, _ in labelled_pages(30, seed=12):
        blocks = leaf_blocks(html)[:9]
        on = model.features(blocks)
        score = lambda y: sum(model.emission[a][k].sum() for a, k in zip(y, on)) + sum(model.transition[a, b] for a, b in zip(y, y[1:]))
        every = [tuple(n >> i & 1 for i in range(len(blocks))) for n in range(2 ** len(blocks))]
        if blocks:
            assert abs(score(model.labels(blocks)) - max(map(score, every))) < 1e-9


def test_table_pages(spark, sf_dir, model):
    """On the given layout the main text is the article element's headings and paragraphs."""
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in main_texts(pages, model).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_page_edges(spark, model):
    texts = {
        1: None, 2: "", 3: "   ", 4: "<html><body></body></html>", 5: "<p", 6: "<script>var a='</p>';", 7: "<!-- <p>no</p>",
        8: "<article><p>A&amp;B&nbsp;&eacute;\n\n c &lt;p&gt;<br>d</p><script>x</script><p>Second one here.</article><footer>end",
        9: "<article><p>" + "long text here. " * 60_000 + "</p></article>",
        10: "<div><a href='x>y'>q</a></div></p></div></nav>",
    }
    df = spark.createDataFrame([(i, "u", h, "t", 3) for i, h in [*texts.items(), *texts.items()]], "page_id long, url string, html string, text string, n_chars int")
    rows = main_texts(df, model).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 2 * len(texts)
    assert all(got[i] == "" for i in range(1, 8) if i != 5)
    assert got[8] == "A&B é c <p> d\n\nSecond one here."
    assert got[9] == ("long text here. " * 60_000).strip()
    assert main_texts(df.limit(0), model).collect() == []


def test_hashes_of_items(spark, sf_dir):
    rows = QUERIES["op6_decontaminate"][0](spark, sf_dir).where("n_items = 0").limit(1).collect()
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_text_behind_drawings():
    article = "<article><p>The first sentence of the article.</p><p>The second one.</p></article>"
    want = ["The first sentence of the article.", "The second one."]
    inner = '<svg class="a"><svg x="1"><text>no</text></svg><text>nor this</text></svg>'
    for drawing in ('<svg class="icon"/>', "<svg/>", "<svg d='a=b' />", "<SVG width=1 />", inner, inner + "<svg/>", "<svg class=icon/><path/></svg>", "<svg><svg/></svg>"):
        assert [b.text for b in leaf_blocks(f"{drawing}{article}")] == want, drawing
        assert [b.text for b in leaf_blocks(f"<div>{drawing}</div>{article}<svg><text>no</text></svg>")] == want, drawing
    assert leaf_blocks("<svg><text>never closed" + article) == []


#: Pages that no rule of the generator makes, and their main text.
LAYOUTS = [
    ("<article><div>Plain text in a div, long enough to be one.</div><div>More of it, and then some words.</div></article>", ["Plain text in a div, long enough to be one.", "More of it, and then some words."]),
    ("<article><p>The council met on Monday to discuss the budget for the next year.</p></article>", ["The council met on Monday to discuss the budget for the next year."]),
    ("<body><h1>A title</h1><div>Some long text of many words. It goes on and on.</div><div>Another block. It says things.</div></body>", ["A title", "Some long text of many words. It goes on and on.", "Another block. It says things."]),
    ("<body><h1>Title here</h1><p>First paragraph.</p><p>Second paragraph.</p></body>", ["Title here", "First paragraph.", "Second paragraph."]),
    ("<article><h1>T</h1><p>See these.</p><ul><li><a href=x>One link</a></li><li><a href=y>Two links</a></li></ul><p>A closing paragraph.</p></article>", ["T", "See these.", "One link", "Two links", "A closing paragraph."]),
    ("<article><h1>Title</h1><div>One.</div><div>Two is here as well.</div></article>", ["Title", "One.", "Two is here as well."]),
    ("<main><section><h2>Part one</h2><p>Text of part one.</p></section><section><h2>Part two</h2><p>Text of part two.</p></section></main><aside><h3>Related</h3><a href=a>Other story</a></aside>", ["Part one", "Text of part one.", "Part two", "Text of part two."]),
    ("<nav><a href=/>Home</a> <a href=/x>News</a></nav><div id=content><h2>Storm hits coast</h2><span>The storm came at night.</span><br><span>It left.</span></div><div class=sidebar><p>Most read this week.</p></div><footer>All rights reserved</footer>", ["Storm hits coast", "The storm came at night. It left."]),
    ("<div class='cookie-banner'>We use cookies. <button>OK</button></div><div class='entry'><p>Real text is here.</p><dl><dt>Term</dt><dd>What the term means.</dd></dl></div><div class='comments'><div class=comment><p>I disagree with that.</p></div></div>", ["Real text is here.", "Term", "What the term means."]),
    ("<article><header><h1>Head</h1></header><p>Body text.</p></article><form><label>Your mail</label><button>Send</button></form>", ["Head", "Body text."]),
    ("<!-->Text behind<!---> comments<!-- no --!> that are closed<!-- open <p>no</p>", ["Text behind comments that are closed"]),
    ("<p title='a>b'>Quoted.</p><p title='open>Ends here.</p><p>And on.</p>", ["Quoted.", "Ends here.", "And on."]),
]


@pytest.mark.parametrize(("html", "want"), LAYOUTS)
def test_layouts_the_generator_does_not_know(model, html, want):
    assert model.main_text(html).split("\n\n") == want


def test_broken_pages_take_linear_time(model):
    import time

    n = 100_000
    broken = ["<a ", "<a b='", "<!--", "<![", "</script", "<svg ", "<h1>", "<b>", "<div class=x>", "<", "<a \"'", "</p"]
    pages = [b * n + end for b in broken for end in ("", ">", "<p>x</p>")]
    pages += ["<div>" * n + "</p>" * n, "<script>" + "</script" * n, "<svg>" + "<svg>" * n, "".join(f"<div class=n{chr(97 + i % 26) * (i % 50)}>" for i in range(n))]
    for html in pages:
        began = time.thread_time()
        model.main_text(html)
        assert time.thread_time() - began < 10, html[:20]
