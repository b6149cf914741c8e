"""The numbered queries over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.llm import (
    byte_bpe, decontamination, divergence, jaccard_join, mixing, neighbours, page_text, quality_classifier, quality_rules, spelling, token_counts, token_files, url_filters,
)
from meadowlark.llm.batches import scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that labels call good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.quality_rules(docs, trusted_ids(spark, sf_dir))
    return out.select("doc_id", *quality_rules.RESULTS, "base_failed", "kept")


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_text.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op3_source_mix"] = mixing.SQL


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path,
                                  public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.encode_and_decode(docs, *vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Model:
    """Learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~quality_classifier.held_out(F.col("doc_id")))
    return quality_classifier.fit(docs, labels.select("doc_id", F.col("quality").cast("double")))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.score(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under one vocabulary; those not in English are then revised to another, by a
    delete and an insert in two batches with a snapshot between."""
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    count = {v: token_counts.token_count(spark, public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN)
             for v in (first, second)}
    other = ~F.col("lang").eqNullSafe("en")
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", F.when(other, F.col("text")).alias("again"))
    counts = written(docs.select("source", "lang", count[first]("text").alias("n1"), count[second]("again").alias("n2")),
                     "token-counts")
    old = counts.withColumns({"tokenizer": F.lit(first), "tokens": F.col("n1")})
    new = counts.withColumns({"tokenizer": F.lit(second), "tokens": F.col("n2")})
    ledger = scratch(spark, "token-ledger")
    token_counts.commit(token_counts.signed(old, 1), ledger, "load")
    token_counts.commit(token_counts.signed(old.where(other), -1), ledger, "delete")
    token_counts.compact(spark, ledger)
    token_counts.commit(token_counts.signed(new.where(other), 1), ledger, "insert")
    token_counts.commit(token_counts.signed(old, 1), ledger, "load")  # a retried batch counts once
    return token_counts.totals(spark, ledger)


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "url_score")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op11_spelling_variants"] = spelling.SQL


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated")


ORACLE["op12_decontamination"] = decontamination.SQL


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE["op13_source_divergence"] = divergence.SQL
