"""Queries of the corpus operators: ``QUERIES`` and ``ORACLES``.

Each applies its operator with production parameters to its whole table and
derives the columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    ann_forest, bpe, dual_lloyd, hnsw_dedup, html_mincut, line_dedup, mixing, oracle, quality_cnn, rule_ledger, simhash, toxicity, url_graph, whitening,
)
from .common import read
from .sampling import fold

QUERIES, ORACLES = {}, {}


def tokenizer_path() -> str:
    """The tokenizer of the contract, from the installed public files."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


def _judged(scores: DataFrame, held, threshold: float) -> DataFrame:
    return scores.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("id", 3) != 1)
    return _judged(toxicity.score(docs, model), fold("id", 3) == 1, toxicity.THRESHOLD)


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The rules of the contract.
URL_RULES = (
    url_graph.Rule("allow", "com", "/"), url_graph.Rule("block", "example.com", "/en/"),
    url_graph.Rule("allow", "www.example.com", "/en/"), url_graph.Rule("block", "net", "/es/"),
    url_graph.Rule("block", "net", "/fr/"))


@query("op3_url_graph")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(read(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op5_html_mincut")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_mincut.extract(pages, html_mincut.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_quality_cnn")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    net = quality_cnn.train(docs, labels, fold("id", 4) != 2)
    return _judged(quality_cnn.score(docs, net), fold("id", 4) == 2, quality_cnn.THRESHOLD)


@query("op7_line_dedup", oracle.LINE_DEDUP)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.clean(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.col("source").alias("host"), F.col("_llm_n_lines").alias("n_lines"),
                        F.col("_llm_n_dropped").alias("n_dropped"), F.col("_llm_clean").alias("text"))


@query("op8_mixing", oracle.MIXING)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"])


@query("op9_rule_ledger")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.ledger(read(spark, sf_dir, "documents"))
    return book.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.kept(rule_ledger.BASE)).alias("base_failed"), rule_ledger.kept(rule_ledger.STRICT).alias("kept"),
        "failed", F.lit(rule_ledger.STRICT.version).alias("policy"))


@query("op10_ann_forest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann_forest.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op11_dual_lloyd", oracle.DUAL_LLOYD)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = dual_lloyd.encode(read(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), dual_lloyd.hex_code().alias("code"), "error", "label_error",
                        F.lit(dual_lloyd.digest(books)).alias("codebooks_sha256"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op13_hnsw_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
