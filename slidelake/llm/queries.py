"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.llm.decontaminate import decontaminate
from slidelake.llm.html_text import main_texts
from slidelake.llm.html_text import train as train_blocks
from slidelake.llm.jaccard import linked_documents
from slidelake.llm.katz import katz_scores
from slidelake.llm.language import held_out, predict, train
from slidelake.llm.licences import TEMPLATES, scan_licences
from slidelake.llm.line_templates import without_recurring_lines
from slidelake.llm.merkle import verified_documents
from slidelake.llm.mixing import mixed_documents
from slidelake.llm.neighbours import nearest
from slidelake.llm.prefix_trie import conversation_trie
from slidelake.llm.token_files import read_token_files, write_token_files
from slidelake.llm.urls import filter_urls, rules_table
from slidelake.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight FROM sources),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source IS NULL, source) AS k FROM weighed),
shares AS (
  SELECT a.k, CAST((SELECT sum(source_size) FROM ordered) - coalesce((SELECT sum(3 * source_size) FROM ordered b WHERE b.k < a.k), 0) AS DOUBLE)
            / CAST((SELECT sum(weight) FROM ordered) - coalesce((SELECT sum(weight) FROM ordered b WHERE b.k < a.k), 0) AS DOUBLE) AS share,
         weight, source_size FROM ordered a),
level AS (
  SELECT share FROM shares WHERE weight * share <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * share > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * share END AS target
  FROM weighed, level),
words AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS words,
         row_number() OVER (ORDER BY source IS NULL, source) AS sid, (source_size + 4095) // 4096 AS blocks FROM targets),
needs AS (
  SELECT *, words // greatest(source_size, 1) AS passes, words % greatest(source_size, 1) AS rest,
         words // greatest(source_size, 1) * blocks + (words % greatest(source_size, 1) + 4095) // 4096 AS need FROM words),
spans AS (SELECT sid, need, sum(need) OVER (ORDER BY sid) AS cum, sum(need) OVER () AS n FROM needs),
edges AS (
  SELECT sid, need, floor(CAST(cum - need AS DOUBLE) * 4294967296.0::DOUBLE / CAST(n AS DOUBLE)) AS lo,
         floor(CAST(cum AS DOUBLE) * 4294967296.0::DOUBLE / CAST(n AS DOUBLE)) AS hi FROM spans),
slots AS (
  SELECT s.slot, e.sid, e.need, row_number() OVER (PARTITION BY e.sid ORDER BY s.slot) - 1 AS rank
  FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS slot FROM (SELECT DISTINCT n FROM spans)) s
  JOIN edges e ON s.slot::HUGEINT * 2654435769 % 4294967296 >= e.lo AND s.slot::HUGEINT * 2654435769 % 4294967296 < e.hi),
met AS (SELECT e.sid, e.need, count(s.slot) AS met FROM edges e LEFT JOIN slots s ON s.sid = e.sid GROUP BY e.sid, e.need),
schedule AS (
  SELECT slot, sid, rank FROM slots WHERE rank < need
  UNION ALL SELECT (SELECT max(n) FROM spans)::BIGINT + r, sid, r FROM (SELECT sid, unnest(range(met, need::BIGINT)) AS r FROM met)),
placed AS (
  SELECT row_number() OVER () AS k, s.doc_id, s.size, n.*,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('42|' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sizes s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source),
pieces AS (SELECT *, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS block FROM placed WHERE size > 0),
first AS (
  SELECT p.k, min(s.slot) AS first_slot FROM pieces p JOIN schedule s ON s.sid = p.sid AND s.rank % p.blocks = p.block
  WHERE greatest(p.start, p.block * 4096) < CASE WHEN s.rank // p.blocks < p.passes THEN p.source_size ELSE p.rest END GROUP BY p.k)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE words // source_size * size
         + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken, f.first_slot
FROM placed p LEFT JOIN first f USING (k)
"""

#: The rules of the contract: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES), ("page_id",))


OP8_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
best AS (
  SELECT p.n, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n)
SELECT p.page_id, p.host, p.path, b.best.rule AS rule, coalesce(b.best.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (n)
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, train(documents)).withColumn("held_out", held_out(F.col("doc_id")))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), train_blocks())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_recurring_lines(table(spark, sf_dir, "documents"), rare_words=True)


OP4_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT row_number() OVER (ORDER BY doc_id IS NULL, doc_id, text) AS d, doc_id, text FROM docs),
lines AS (
  SELECT d, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT d, string_split(text, chr(10)) AS l FROM keyed)),
cut AS (
  SELECT d, line_no, line, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM (SELECT d, line_no, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM lines) WHERE len(t) >= 3),
leafed AS (SELECT d, line_no, line, t, array_to_string(t, ' ') AS form, [len(t)::VARCHAR] || t[1:3] AS leaf FROM cut),
pairs AS (SELECT DISTINCT d, leaf, form, t FROM leafed WHERE len(t) >= 8),
leaves AS (SELECT leaf, count(*) AS n FROM pairs GROUP BY leaf HAVING count(*) >= 3 AND count(DISTINCT form) > 1),
words AS (SELECT leaf, unnest(range(len(t))) AS place, unnest(t) AS token FROM pairs SEMI JOIN leaves USING (leaf)),
counted AS (SELECT leaf, place, token, count(*) AS docs FROM words GROUP BY ALL),
most AS (SELECT leaf, place, max(row(docs, token)) AS m FROM counted GROUP BY leaf, place),
majorities AS (
  SELECT leaf, list(CASE WHEN 2 * m[1] >= n THEN m[2] ELSE '<*>' END ORDER BY place) AS majority FROM most JOIN leaves USING (leaf) GROUP BY leaf),
fitting AS (
  SELECT l.d, l.line_no, l.leaf, len(l.t) AS n, len(list_filter(list_zip(l.t, m.majority), lambda x: x[1] = x[2] AND x[1] <> '<*>')) AS agree
  FROM leafed l JOIN majorities m ON m.leaf = l.leaf),
shared AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT d) >= 3),
once AS (SELECT leaf, line, any_value(t) AS t, count(DISTINCT d) AS docs FROM leafed SEMI JOIN shared USING (leaf) GROUP BY leaf, line),
placed AS (SELECT leaf, line, docs, unnest(range(len(t))) AS place, unnest(t) AS token FROM once),
fixed AS (SELECT leaf, place, token FROM placed WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 3),
rare AS (
  SELECT p.leaf, p.line, string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.place) AS template,
         count(f.token) AS n_fixed, count(*) AS n
  FROM placed p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token GROUP BY p.leaf, p.line),
templated AS (
  SELECT 'own' AS kind, d, line_no, leaf, form AS template FROM leafed WHERE len(list_filter(t, lambda x: x <> '<*>')) >= 0.7 * len(t) - 1e-9
  UNION ALL SELECT 'leaf', d, line_no, leaf, '' FROM fitting WHERE agree >= 8 AND agree >= 0.7 * n - 1e-9
  UNION ALL SELECT 'rare', l.d, l.line_no, leaf, r.template FROM leafed l JOIN rare r USING (leaf, line) WHERE r.n_fixed >= 0.7 * r.n - 1e-9),
recurring AS (SELECT kind, leaf, template, min(d) AS keeps FROM templated GROUP BY kind, leaf, template HAVING count(DISTINCT d) >= 3),
gone AS (SELECT DISTINCT t.d, t.line_no FROM templated t JOIN recurring r USING (kind, leaf, template) WHERE t.d <> r.keeps),
cleaned AS (
  SELECT l.d, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.d IS NULL) AS text, count(*) AS n_lines, count(g.d) AS n_dropped
  FROM lines l LEFT JOIN gone g ON g.d = l.d AND g.line_no = l.line_no GROUP BY l.d)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM documents o LEFT JOIN keyed k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text LEFT JOIN cleaned c USING (d)
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP6_SQL = r"""
WITH item_words AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS n, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT g.n, g.i, g.size, x.item FROM grams g JOIN windows x USING (size, gram)),
hit AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT n, i, size FROM found)) GROUP BY n),
named AS (SELECT n, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY n)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(m.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(m.items, ','), '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit h USING (n) LEFT JOIN named m USING (n)
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bigrams_sql(words: str) -> str:
    return f"CASE WHEN len({words}) < 2 THEN {words} ELSE list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) END"


OP9_SQL = rf"""
WITH templates(name, body) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES.items())}),
wanted AS (
  SELECT name, {_bigrams_sql("w")} AS b FROM (SELECT name, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM templates)),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT n, unnest(range(len(l))) AS line, unnest(l) AS unit FROM (SELECT n, string_split(text, chr(10)) AS l FROM docs)
  UNION ALL SELECT n, -1, text FROM docs WHERE contains(text, chr(10))),
sets AS (
  SELECT n, line, {_bigrams_sql("w")} AS b FROM (SELECT n, line, regexp_extract_all(lower(unit), '[\p{{L}}\p{{N}}]+') AS w FROM units) WHERE len(w) > 0),
scored AS (
  SELECT n, line, name, 2 * len(list_intersect(s.b, t.b))::DOUBLE / (len(s.b) + len(t.b)) AS dice FROM sets s, wanted t
  WHERE len(s.b) BETWEEN 0.5 * len(t.b) AND 2 * len(t.b)),
best AS (
  SELECT n, line, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY n, line ORDER BY dice DESC, name) AS r FROM scored WHERE dice >= 0.9) WHERE r = 1)
SELECT d.doc_id, count(b.line) AS n_matches, coalesce(array_to_string(list_sort(list(DISTINCT b.name) FILTER (b.name IS NOT NULL)), ','), '') AS licences,
       coalesce(max(b.dice), 0)::DOUBLE AS best
FROM docs d LEFT JOIN best b USING (n) GROUP BY d.n, d.doc_id
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_token_files(spark, folder)
    n_tokens = F.expr("octet_length(ids) div 4").cast("long")
    return read.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Where 2 divides the CRC of the id, the row was tampered with: its text lost its line ends.
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified_documents(table(spark, sf_dir, "documents"), text=text)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text: each byte is put in ahead of its eight shifts."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ord({text}[i]), 0, 0, 0, 0, 0, 0, 0]))"
    one = "(xor(c, x) >> 1)", "3988292384 * (xor(c, x) & 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda c, x: xor({one[0]}, {one[1]})), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(fields)})"


OP12_SQL = rf"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS other
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed),
nodes(level, tree, pos, digest, n) AS (
  SELECT 0, tree, rank, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 3, n),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops(level, pos, digest, n) AS (
  SELECT 0, tree, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (
  SELECT l.tree, l.rank, n.level AS level,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < l.rank // CAST(3 ** n.level AS BIGINT)), '') AS before,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > l.rank // CAST(3 ** n.level AS BIGINT)), '') AS after
  FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.n > 1 AND n.pos // 3 = l.rank // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.tree, l.rank, 1000 + n.level,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < l.tree // CAST(3 ** n.level AS BIGINT)), ''),
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > l.tree // CAST(3 ** n.level AS BIGINT)), '')
  FROM leaves l JOIN tops n ON n.n > 1 AND n.pos // 3 = l.tree // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, rank ORDER BY level) AS k FROM steps),
folds(tree, rank, k, digest) AS (
  SELECT tree, rank, 0::BIGINT, other FROM leaves
  UNION ALL
  SELECT f.tree, f.rank, f.k + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN numbered s ON s.tree = f.tree AND s.rank = f.rank AND s.k = f.k + 1),
folded AS (SELECT tree, rank, arg_max(digest, k) AS digest FROM folds GROUP BY tree, rank),
proofs AS (SELECT tree, rank, sha256(string_agg(before || after, '' ORDER BY k)) AS digest FROM numbered GROUP BY tree, rank),
root AS (SELECT digest FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.digest, sha256('')) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN folded f ON f.tree = l.tree AND f.rank = l.rank LEFT JOIN proofs p ON p.tree = l.tree AND p.rank = l.rank, root r
"""

def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
used AS (
  SELECT i.conv_id, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL SELECT i.conv_id, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h),
listed AS (
  SELECT i.conv_id, coalesce(list(md5(strlen(u.role) || ':' || u.role || u.text) ORDER BY u.k) FILTER (u.k IS NOT NULL), []) AS path,
         coalesce(list(len(regexp_extract_all(u.text, '[^\x20\x09-\x0D]+')) ORDER BY u.k) FILTER (u.k IS NOT NULL), []) AS words
  FROM ids i LEFT JOIN used u USING (conv_id) GROUP BY i.conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, array_to_string(path[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS above,
         CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(path) AS ends
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM listed)),
nodes AS (
  SELECT node, above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, above, depth),
kids AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
sub AS (
  SELECT a.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) b LEFT JOIN kids k ON k.node = b.node
  JOIN nodes a ON a.node = left(b.node, 32 * b.d) GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.above LEFT JOIN kids k ON k.node = n.node JOIN sub s ON s.node = n.node
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_mix_sources": (op1_mix_sources, OP1_SQL),
    "op2_language": (op2_language, None),
    "op3_main_text": (op3_main_text, None),
    "op4_line_dedup": (op4_line_dedup, OP4_SQL),
    "op5_nearest": (op5_nearest, None),
    "op6_decontaminate": (op6_decontaminate, OP6_SQL),
    "op7_jaccard_join": (op7_jaccard_join, None),
    "op8_url_rules": (op8_url_rules, OP8_SQL),
    "op9_licences": (op9_licences, OP9_SQL),
    "op10_token_files": (op10_token_files, None),
    "op11_katz_scores": (op11_katz_scores, None),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
