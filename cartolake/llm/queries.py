"""The queries opN_* of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, host_rules, html_lstm, langid, mixing, pii, quality_pu, rans, simhash, tiff


TOKENIZER, END = "word_bpe_49k.json", 1


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    counts = [pii.count("base_spans", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return tiff.read_back(tiff.store_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scorer = quality_pu.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality_pu.score(docs, scorer)
    return found.select("doc_id", quality_pu.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality_pu.THRESHOLD).cast("int").alias("predicted"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir)).select("doc_id", *host_rules.MEASURES, "kept")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_lstm.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, each with its own hosts; the texts of labelled documents are the model's."""
    docs, pages = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = langid.fit(docs)
    plain = langid.classify(docs, model, declared=langid.declared_in("text")).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "lang", "confidence", "text_lang", "kept")
    marked = langid.classify(langid.page_evidence(pages), model, "page_id", host_col="host", suffix=F.col("suffix"), declared=F.col("declared"))
    found = plain.unionByName(marked.withColumnRenamed("id", "page_id").withColumn("doc_id", F.lit(None).cast("long")))
    return found.select("doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "kept")


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END)
    return rans.index(rans.read(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_bpe": op2_bpe, "op3_pii": op3_pii, "op4_mixing": op4_mixing, "op5_tiff": op5_tiff, "op6_quality": op6_quality, "op7_host_rules": op7_host_rules, "op8_html": op8_html, "op9_langid": op9_langid, "op10_rans": op10_rans}


#: The measures, the hosts' shrunk rates and the verdicts of op7, as DuckDB takes them.
_OP7 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r),
measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM base LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS marked FROM measured),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR marked THEN 1 ELSE 0 END)::DOUBLE AS f FROM judged GROUP BY source),
totals AS (SELECT sum(f) / sum(n) AS m, sum((f / n) * (f / n)) / count(*) AS s2, sum(f / n) / count(*) AS s1, sum(1.0::DOUBLE / n) / count(*) AS inv FROM hosts),
spreads AS (SELECT m, s2 - 2 * m * s1 + m * m AS spread, m * (1 - m) * inv AS chance FROM totals),
prior AS (SELECT m, CASE WHEN spread > chance THEN greatest(1.0::DOUBLE, least(100.0::DOUBLE, (m * (1 - m) - spread) / (spread - chance))) ELSE 100.0::DOUBLE END AS strength FROM spreads),
rated AS (SELECT source, m, (f + m * strength) / (n + strength) AS rate, n + strength + 1 AS weight FROM hosts, prior),
verdicts AS (SELECT source, rate - m > 0.67::DOUBLE * sqrt(rate * (1 - rate) / weight) AS suspect, rate - 0.5::DOUBLE > 3.0::DOUBLE * sqrt(rate * (1 - rate) / weight) AS rejected FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AND NOT (suspect AND marked) AS kept
FROM judged JOIN verdicts ON verdicts.source IS NOT DISTINCT FROM judged.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_host_rules": _OP7}
