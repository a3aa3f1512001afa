"""From documents to token files: language, near duplicates, benchmark passages, source mix, tokens.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but
the last return the columns of the documents they are given, whatever these are called, and never look at columns other
than doc_id, text, lang and source.  ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.

Defined results: null and empty texts go in the first stage, as they have no language; of a group of near duplicates the
row with the smallest doc_id stays, and of repeated rows one; rows without a doc_id are only ever compared with equal
ones; empty tables pass through as empty ones.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.llm.decontaminate import decontaminate
from slidelake.llm.jaccard import linked_documents
from slidelake.llm.language import UNKNOWN, predict, train
from slidelake.llm.mixing import mixed_documents
from slidelake.llm.token_files import read_token_files, write_token_files
from slidelake.session import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text, lang, source): all columns but the text in one, so that no name can clash with a result."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("doc"), "doc_id", "text", "lang", "source")


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in columns])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["t"].eqNullSafe(b["t"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a language: those whose text is null or has no letter."""
    packed = _packed(docs)
    judged = predict(packed, train(packed), keep=("doc", "text"))
    return _unpacked(judged.where(F.col("lang_pred") != UNKNOWN), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word-shingle sets with a Jaccard similarity of 0.8 or more."""
    keyed = _packed(docs).withColumn("t", F.xxhash64("text"))
    linked = linked_documents(keyed, keep=("t",), root="root")
    grouped = F.col("root").isNotNull()
    first = F.row_number().over(W.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "t"))
    key = F.struct("doc_id", F.coalesce("t", F.lit(0)).alias("t")).alias("key")
    chosen = linked.where(grouped).withColumn("nth", first).where("nth = 1").select(key)
    chosen = chosen.unionByName(linked.where(~grouped).select(key)).distinct()
    # One key of one type for both steps, in which nulls are equal, and no semi join, which would be planned on other
    # columns: so the texts are shuffled once.  No t is null.
    kept = keyed.select("doc", "text", key).join(chosen, "key").dropDuplicates(["key"])
    return _unpacked(kept, docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which benchmark passages make up 5 % of the words or more."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    judged = decontaminate(_packed(docs), benchmark, keep=("doc", "text"))
    return _unpacked(judged.where(~F.col("contaminated")), docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents as the mix takes them: each as often as the nearest whole number."""
    keyed = _packed(docs).withColumn("t", F.xxhash64("text"))
    mixed = mixed_documents(keyed, keep=("t",))
    copies = F.expr("taken div size + if(2 * (taken % size) >= size, 1, 0)")
    # Equal rows are one row here; each of them comes as often as all of them are taken.
    taken = mixed.where("size > 0").groupBy("doc_id", "t").agg(F.sum(copies).alias("copies"))
    once = keyed.dropDuplicates(["doc_id", "t"])
    out = once.join(taken, _same(once, taken)).where("copies > 0")
    return _unpacked(out.withColumn("nth", F.explode(F.expr("sequence(1, copies)"))).select("doc", "text"), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold: doc_id, start, n_tokens and ids_crc32."""
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    n_tokens = F.expr("octet_length(ids) div 4").cast("long")
    return read_token_files(spark, folder).select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)


#: SQL cannot express training, joins by links or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
