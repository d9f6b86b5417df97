"""A corpus pipeline: language ID, SimHash near-dedup, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as Parquet in the cluster's
shared folder and reads them again for the next. All but the last return the columns of documents.

Defined results, for every stage: any column may be null; an empty table gives no rows; very long texts are read whole; columns besides
those of documents are dropped, whatever their names, before an operator sees them. A null text counts as an empty one. What ties, repeated
rows and repeated ids give is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm import bpe, langid, mixing, pii, simhash
from cartolake.llm.shared import materialize

TOKENIZER = "word_bpe_49k.json"
#: Five-word similarity of texts that count as near copies, besides fingerprints that differ in two bits or fewer.
SIMILAR = 0.8
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go, as do texts without letters.

    Rows are judged one by one, whatever their ids; repeated rows all stay or all go. Languages that fit equally go by name.
    """
    docs = docs.select(COLUMNS)
    return langid.keep(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; a null id only where there is no other.

    Of rows with the same id in a group, that of the smallest digest of the text stays, and of rows alike in id and text one. Texts without
    words are a group.
    """
    return simhash.keep_one(docs.select(COLUMNS), similar=SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the new text. Every row stays, once; a null text stays null, with n_chars null."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most 3 times; a null source is a source. Repeated rows each get their own share."""
    return mixing.mix(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the text's ids and their number, for every row; no ids for a null or empty text."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
