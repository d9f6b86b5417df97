"""Quality rules with host verdicts, in DataFrame functions only.

Every document is measured once, and the documents that fail a rule are counted by host: the base rules, or more than MAX_SYMBOLS symbols to
100 words. Hosts' failure rates vary around a common beta prior, whose mean and strength are estimated from all hosts by the method of
moments (an empirical prior); each host's posterior is that prior with its own counts, its rate the posterior mean. Two verdicts come
from it. A host is suspect if its rate lies WORSE posterior deviations or more above the prior's mean, that is, if it is worse than the
common host with a probability of three quarters; on suspect hosts the symbol rule is applied too. A host is rejected with all
its documents if its rate lies BAD deviations above one half, that is, if nearly surely most of its documents fail. Verdicts are joined back to
the documents.

Aggregation by host is partial before its shuffle, so a host with a third of all rows sends one row a task. Hosts' verdicts are one row a
host; they return to the documents by an equi-join on the host, and only suspect and rejected hosts take part in it.

Defined results: a null text has no words; a very long text is measured whole; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives no rows. Columns of the input other than the text pass through; names of the results are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, materialize, refuse

#: The rules' limits: words, repeated words to 100, symbols to 100 words.
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS = 50, 50, 10
#: Posterior deviations above the prior's mean of a suspect host, and above one half of a rejected one.
WORSE, BAD = 0.67, 3.0
#: Most documents that the prior counts for, so that a host's own always come to count.
MOST_STRENGTH = 100.0
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(starts: Column) -> Column:
    """Words covered by windows at these starts, in ascending order: each covers three words, up to the next start."""
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["p"])).alias("n"), i.alias("p"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("p")), step)["n"]


def _starts_by_words(words: Column, n: Column) -> Column:
    """Starts of repeated windows, by sorting the windows themselves."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.slice(words, i + 1, F.lit(3)).alias("w"), i.alias("i"))))
    same = lambda w, k, j: F.coalesce(F.get(w, j)["w"] == F.get(w, k)["w"], F.lit(False))
    return _once(windows, lambda w: F.transform(F.filter(F.sequence(F.lit(0), n - 3), lambda k: same(w, k, k - 1) | same(w, k, k + 1)), lambda k: F.get(w, k)["i"]))


_PLACE = 20  # bits for a window's place


def _repeated(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, given an array of words.

    A window's hash and place are one long, so that sorting longs brings equal windows together. Neighbours with equal hashes are
    compared word by word; a text in which two of them differ, or one too long for its places, is done by sorting the windows themselves.
    """
    mask = (1 << _PLACE) - 1
    hashed = lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), _PLACE).bitwiseOR(i.cast("long"))
    n = F.size(words)
    packed = F.sort_array(F.slice(F.transform(words, hashed), F.lit(1), n - 2))

    def from_pairs(pairs: Column) -> Column:
        differ = lambda p: F.slice(words, p["a"] + 1, F.lit(3)) != F.slice(words, p["b"] + 1, F.lit(3))
        starts = F.when(F.exists(pairs, differ), _starts_by_words(words, n)).otherwise(F.concat(pairs["a"], pairs["b"]))
        return F.when(F.size(pairs) == 0, 0).otherwise(_covered(F.sort_array(F.array_distinct(starts))))

    def from_packed(s: Column) -> Column:
        met = F.filter(F.sequence(F.lit(1), n - 3), lambda k: F.shiftrightunsigned(F.get(s, k).bitwiseXOR(F.get(s, k - 1)), _PLACE) == 0)
        place = lambda k: F.get(s, k).bitwiseAND(F.lit(mask)).cast("int")
        return _once(F.transform(met, lambda k: F.struct(place(k - 1).alias("a"), place(k).alias("b"))), from_pairs)

    found = F.when(n <= mask, _once(packed, from_packed)).otherwise(_covered(F.sort_array(_starts_by_words(words, n))))
    return F.when(n >= 4, found).otherwise(0).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    refuse(docs, {*MEASURES, "_words"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACES}]"), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    split = docs.withColumn("_words", words)
    distinct = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    found = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": distinct.cast("long"),
            "n_repeat_words": _repeated(F.col("_words")),
        }
    ).drop("_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host_col: str = "source", failed_col: str = "base_failed") -> DataFrame:
    """For every host: n, failed, rate, its share of failing documents shrunk by the empirical beta prior, and the verdicts suspect and rejected.

    With m and v the mean and variance of hosts' shares and e the share of v that sampling alone explains, the prior's strength is
    m (1 - m) / (v - e) - 1, held between 1 and MOST_STRENGTH; where hosts differ no more than chance has them, it is the latter.
    The six sums that this takes go to the driver.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed_col).cast("long")).alias("failed"))
    share = F.col("failed") / F.col("n")
    totals = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(1 / F.col("n")).alias("inv"), F.sum(share).alias("s1"), F.sum(share * share).alias("s2"))
    t = totals.first()
    m, strength = 0.0, MOST_STRENGTH
    if t["t"]:
        m = t["f"] / t["t"]
        spread, chance = t["s2"] / t["k"] - 2 * m * t["s1"] / t["k"] + m * m, m * (1 - m) * t["inv"] / t["k"]
        if spread > chance:
            strength = max(1.0, min(MOST_STRENGTH, (m * (1 - m) - spread) / (spread - chance)))
    rated = hosts.withColumn("rate", (F.col("failed") + m * strength) / (F.col("n") + strength))
    off = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return rated.withColumn("suspect", F.col("rate") - m > WORSE * off).withColumn("rejected", F.col("rate") - 0.5 > BAD * off)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without the text, with the measures, host_suspect, host_rejected and kept.

    kept is false where the base rules failed, where the host is rejected, and where it is suspect and the symbol rule failed. The measures
    are written once, as both the hosts' counts and the documents' verdicts need them.
    """
    refuse(docs, {"host_suspect", "host_rejected", "kept", "_host", "_suspect", "_rejected", "_failed"})
    measured = materialize(measure(docs, text_col).drop(text_col), "host-measures")
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")
    rates = host_rates(measured.withColumn("_failed", F.col("base_failed") | symbols), host_col, "_failed").where("suspect OR rejected")
    verdicts = rates.select(F.col("host").alias("_host"), F.col("suspect").alias("_suspect"), F.col("rejected").alias("_rejected"))
    joined = measured.join(verdicts, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    no = F.lit(False)
    found = joined.withColumn("host_suspect", F.coalesce("_suspect", no)).withColumn("host_rejected", F.coalesce("_rejected", no))
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & ~(F.col("host_suspect") & symbols)
    return found.withColumn("kept", kept).drop("_host", "_suspect", "_rejected")
