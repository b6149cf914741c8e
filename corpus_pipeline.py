"""From raw documents to token ids in five stages, each over all that the one before kept.

What the operators define holds for the stages; taken together:

* quality classifier: a null or empty text is scored like any text; rows of one id are scored one
  by one; without labels every score is 0.5 and all documents stay.
* quality rules: null, empty and short texts (under ten words) go, as does what repeats itself;
  a text of any length is judged whole; equal texts get equal verdicts.
* near duplicates: of every class the document with the smallest id stays, once if its row repeats;
  rows without id stay if no row of their class has one; documents without words stay.
* source mix: rows come out as often as their source's target asks for, whole, in no order; null
  sources are one source; a document without words may be drawn, a source without any is left out.
* byte BPE: a null text has no ids; every row, repeated ones too, is encoded and decoded whole.

Only the columns of ``documents`` are carried, so further columns, whatever their names, are left
behind. An empty table goes through all stages and stays empty. Ids are whole numbers.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.llm import byte_bpe, jaccard_join, mixing, quality_classifier, quality_rules
from meadowlark.llm.batches import written
from meadowlark.llm.queries import quality_model, table, trusted_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.tiktoken"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; it learns from the labels of this stage's documents."""
    model = quality_model(spark, docs, sf_dir)
    return quality_classifier.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble trusted ones."""
    return quality_rules.quality_rules(docs.select(*COLUMNS), trusted_ids(spark, sf_dir)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return jaccard_join.one_per_class(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    vocabulary = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = byte_bpe.encode_and_decode(docs.select(*COLUMNS), *vocabulary)
    same = F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("byte BPE", encode_tokens),
]
ORACLE_SQL = None  # kernel scores, hashed n-grams and merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
