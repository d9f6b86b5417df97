"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from character trigrams, hashed into BUCKETS, whose frequencies are fitted to a bounded sample of
each language's labelled rows. A host's prior is what its other rows' texts say, smoothed towards its address suffix's, and that towards the whole
table's; these are grouped sums. Where a row declares a language in its markup, that is another observation, as reliable as declarations
prove to be over the whole table. The posterior combines the three. A row is rejected if its text fits no language,
being FOREIGN or less a trigram against even ones, or if no language has a posterior of ACCEPT.

Sums by host are partial before their shuffle. Hosts come back to their rows, which are a few numbers each by then, by an equi-join that AQE
splits if one host has a third of them. What goes to the driver is the model's counts, BUCKETS numbers a language, for the LANGUAGES most
frequent of the whole table at most.

Defined results: a null text, or one without letters, has no trigrams and is rejected with the language null; a very long text is counted
whole, in pieces; a null host is a host of its own; repeated rows and ids are judged row by row; an empty table gives no rows. Columns other
than those named aren't read by classify(); keep() passes all through and refuses its own names. Beliefs are whole multiples of 2^-24, so that
sums by host don't depend on the order of tasks and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import TEXTS, materialize, refuse

#: SAMPLE is in rows of each language.
BUCKETS, SAMPLE, LANGUAGES, SMOOTHING = 1 << 14, 2000, 64, 0.3
#: Trigrams of a text overlap and repeat; each counts for this much of an independent observation.
TEMPER = 0.25
#: Rows that a parent's prior is worth, and the least posterior of a language.
STRENGTH, ACCEPT = 20.0, 0.5
#: Mean log likelihood of a trigram, against even shares, below which a text fits no language: one odd word of a few stays far above it, another script is near -5 with the whole sample.
FOREIGN = -2.0
_STEP = 1 << 20
_ONE = 1 << 24  # what a belief of 1 is in sums; 10^11 rows fit a long


def trigrams(text: str | None) -> np.ndarray:
    """How often each hashed trigram of letters occurs in a text; all else separates words like a space."""
    counts = np.zeros(BUCKETS, np.int64)
    text = (text or "").lower()
    for at in range(0, len(text), _STEP):
        piece = text[max(0, at - 2) : at + _STEP]
        points = np.frombuffer((" " + piece + " ").encode("utf-32-le", "replace"), np.uint32)
        letter = (points >= 97) & (points <= 122) | (points >= 0xC0)
        points = np.where(letter, points, 32).astype(np.uint64)
        mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
        mixed = mixed[letter[1:-1]]
        counts += np.bincount(((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(12)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log of each bucket's share of a language's trigrams against even shares."""

    languages: list[str]
    weights: np.ndarray

    def likelihoods(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the log likelihood of each language against even trigrams."""
        counts = trigrams(text)
        at = np.flatnonzero(counts)
        return int(counts.sum()), self.weights[:, at] @ counts[at].astype(np.float64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial trigram counts by language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[lang] = total.get(lang, 0) + trigrams(text.as_py())
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """The text model of each language's sample rows with the smallest hashed ids, rows held out (crc32 of the id modulo 4 being 2) excepted.

    All labelled rows are counted by language; the LANGUAGES most frequent are the model's.
    """
    key = F.col(id_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & key.isNotNull() & (F.crc32(key) % 4 != 2)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    counted = labelled.groupBy("_lang").agg(F.count("*").alias("n"), F.approx_count_distinct("_id").alias("ids")).orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    if not counted:
        return Model([], np.zeros((0, BUCKETS)))
    common = [r["_lang"] for r in counted]
    # Somewhat more ids than the sample has, of which the first are taken: no language's rows are sorted as a whole.
    bounds = F.create_map(*[F.lit(x) for r in counted for x in (r["_lang"], (1.25 * sample + 100) / max(1, r["ids"]))])
    near = labelled.where(F.xxhash64("_id") / float(1 << 64) + 0.5 <= F.element_at(bounds, F.col("_lang"))).distinct()
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = materialize(near.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place"), "langid-sample")
    texts = docs.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l"), F.col(text_col).alias("text")).join(F.broadcast(chosen), (F.col("_i") == F.col("_id")) & (F.col("_l") == F.col("_lang")))  # sample rows of each language at most
    counted = texts.select("_lang", "text").mapInArrow(_counted, "lang string, bucket long, n long")
    languages = sorted(common)
    counts = np.zeros((len(languages), BUCKETS))
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[languages.index(r["lang"]), r["bucket"]] = r["n"]
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(languages, np.log(shares * BUCKETS))


class _Read:
    def __init__(self, model: Model) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [self.model.likelihoods(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([n for n, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.float64()))], [*batch.schema.names[1:], "n", "logs"])


def _softmax(logs: Column) -> Column:
    def shifted(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return F.transform(F.array(e), lambda y: F.transform(y, lambda v: v / F.aggregate(y, F.lit(0.0), lambda a, b: a + b)))[0]

    return F.transform(F.array(logs), shifted)[0]


def _sums(by: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Sums of the text posteriors by keys, as an array."""
    sums = by.groupBy(*keys).agg(*[F.sum(F.col("belief")[k]).alias(f"_{k}") for k in range(size)])
    return sums.select(*keys, F.array(*[F.col(f"_{k}") / float(_ONE) for k in range(size)]).alias(name))


def _smoothed(own: Column, parent: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.transform(F.array(own), lambda o: F.zip_with(o, parent, lambda a, b: (F.greatest(a, F.lit(0.0)) + STRENGTH * b) / (total(o) + STRENGTH)))[0]


def classify(rows: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", suffix: Column | None = None, declared: Column | None = None, more: Column | None = None) -> DataFrame:
    """For every row: id, lang, confidence, text_lang (by the text alone), kept, and, if given, a second number more that goes with the id."""
    out = ["id", *(["more"] if more is not None else []), "lang", "confidence", "text_lang", "kept"]
    more = (F.lit(None) if more is None else more).cast("long")
    size = len(model.languages)
    if not size:
        none = F.lit(None).cast("string")
        return rows.select(F.col(id_col).alias("id"), more.alias("more"), none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), F.lit(False).alias("kept")).select(*out)
    host = F.col(host_col)
    suffix = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z]+)$", 1) if suffix is None else F.coalesce(suffix, F.lit(""))
    said = F.lower(F.lit(None).cast("string") if declared is None else declared)
    first = rows.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), more.alias("more"), host.alias("host"), F.lower(suffix).alias("suffix"), F.substring(said, 1, 2).alias("declared"))
    read = first.mapInArrow(_Read(model), "id long, more long, host string, suffix string, declared string, n long, logs array<double>")
    names = F.array(*map(F.lit, model.languages))
    flat = F.array_repeat(F.lit(1.0 / size), size)
    beliefs = F.when(F.col("n") > 0, _softmax(F.transform("logs", lambda x: TEMPER * x))).otherwise(flat)
    believed = read.withColumn("belief", F.transform(beliefs, lambda x: F.floor(x * _ONE).cast("long")))
    believed = materialize(believed.withColumn("best", F.array_position("belief", F.array_max("belief")).cast("int") - 1), "langid-rows", TEXTS)
    certain = believed.where("n > 0")
    by_host = _sums(certain, ["host", "suffix"], size, "by_host")
    by_suffix = _sums(certain, ["suffix"], size, "by_suffix")
    known = F.array_contains(names, F.col("declared"))
    agrees = (F.get(names, F.col("best")) == F.col("declared")).cast("int")
    whole = certain.agg(*[F.sum(F.col("belief")[k]).alias(f"_{k}") for k in range(size)], F.sum(known.cast("int")).alias("n_said"), F.sum(F.when(known, agrees)).alias("agreed")).first()
    sums = [(whole[f"_{k}"] or 0) / _ONE for k in range(size)]
    base = [(x + 1) / (sum(sums) + size) for x in sums]
    trust = min(0.999, ((whole["agreed"] or 0) + 9) / ((whole["n_said"] or 0) + 10))
    hosts = by_host.join(by_suffix, "suffix").withColumn("up", _smoothed(F.col("by_suffix"), F.array(*map(F.lit, base)))).select(F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), "by_host", "up")
    joined = believed.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & (F.col("suffix") == F.col("_suffix")), "left")
    others = F.when(F.col("n") > 0, F.zip_with("by_host", "belief", lambda a, b: a - b / float(_ONE))).otherwise(F.col("by_host"))
    prior = F.coalesce(_smoothed(others, F.col("up")), F.array(*map(F.lit, base)))
    off = (1 - trust) / max(1, size - 1)
    heard = F.transform(names, lambda x: F.when(~F.coalesce(known, F.lit(False)), 0.0).when(x == F.col("declared"), math.log(trust)).otherwise(math.log(max(off, 1e-9))))
    parts = F.arrays_zip(F.transform("logs", lambda x: TEMPER * x).alias("t"), prior.alias("p"), heard.alias("d"))
    fused = joined.withColumn("posterior", _softmax(F.transform(parts, lambda x: x["t"] + F.log(x["p"]) + x["d"])))
    at = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    fused = fused.withColumn("at", at).withColumn("confidence", F.array_max("posterior"))
    kept = (F.col("n") > 0) & (F.col("confidence") >= ACCEPT) & (F.get("logs", F.col("at")) > FOREIGN * F.col("n"))
    told = lambda at: F.when(F.col("n") > 0, F.get(names, F.col(at)))
    return fused.select("id", "more", told("at").alias("lang"), "confidence", told("best").alias("text_lang"), kept.alias("kept")).select(*out)


#: The language that a document's markup declares, within the first tag html.
DECLARED = r"""(?i)[\s"']lang\s*=\s*["']?([a-z]{2})"""


def declared_in(text: str) -> Column:
    found = F.regexp_extract(F.regexp_extract(F.col(text), r"(?i)<html(?=[\s>/])[^>]*+", 0), DECLARED, 1)
    return F.when(found != "", found)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, host, suffix and declared of pages with page_id, url and html. What is never closed reaches to the page's end."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " "), r"<[/!?a-zA-Z][^>]*+", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", text.alias("text"), host.alias("host"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), declared_in("html").alias("declared"))


def keep(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they were.

    A verdict depends on a row's text and host alone and comes back to it by 128 bits of them, so that null and repeated ids don't matter.
    """
    refuse(docs, {"_row", "_more"})
    host = F.col(host_col)
    told = [F.coalesce(text_col, F.lit("")), host.isNull(), F.coalesce(host, F.lit(""))]
    row, more = F.xxhash64(*told), F.xxhash64(F.lit(1), *told)
    named = docs.select(row.alias("_row"), more.alias("_more"), F.col(text_col).alias("text"), host.alias("host"))
    rejected = classify(named, model, "_row", "text", "host", declared=declared_in("text"), more=F.col("_more")).where(~F.col("kept"))
    rejected = rejected.select(F.col("id").alias("_row"), F.col("more").alias("_more")).distinct()
    return docs.select("*", row.alias("_row"), more.alias("_more")).join(rejected, ["_row", "_more"], "left_anti").select(*docs.columns)
