import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cartolake.llm import host_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t\x0b", "a a a a", "a b", "x\n\nx\n x\n\x0cx", "# $ a|b <é>𝒳", "ab " * 30000]
    texts += ["".join(rng.choice(["a", "b", "cé", "*"]) + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, n))) for n in (5, 20, 60, 200) for _ in range(20)]
    rows = [(i, t, "h", "kept") for i, t in enumerate(texts)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    assert all(r.kind == "kept" for r in got)


def test_windows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "_PLACE", 60)  # four bits of hash are left, and places up to 2^60
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (4, 10, 40, 90) for _ in range(10)]
    got = host_rules.measure(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.n_repeat_words for r in got] == [brute(t)[4] for t in texts]
    monkeypatch.setattr(host_rules, "_PLACE", 5)
    got = host_rules.measure(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.n_repeat_words for r in got] == [brute(t)[4] for t in texts]


def test_bad_hosts_go_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too few words"
    rows = [(f"h{k}", bad if i % 10 == 0 else good) for k in range(20) for i in range(40)]
    rows += [("junk", bad if i % 50 else good) for i in range(200)] + [(None, bad), (None, good), ("once", bad)]
    got = host_rules.judge(spark.createDataFrame(rows, "source string, text string"))
    assert {r.source for r in got.where("host_rejected").select("source").distinct().collect()} == {"junk"}
    assert got.where("kept").count() == 20 * 36 + 1 and got.count() == len(rows)


def test_empty_and_clashing(spark):
    assert host_rules.judge(spark.createDataFrame([], "source string, text string")).count() == 0
    with pytest.raises(ValueError):
        host_rules.judge(spark.createDataFrame([], "source string, text string, N_words int"))
    for name in ("Host_Rejected", "kept", "_bad", "_host"):
        df = spark.createDataFrame([("h", "x", 1)], f"source string, text string, {name} int")
        if name == "_bad":
            assert host_rules.judge(df).first()["_bad"] == 1
        else:
            with pytest.raises(ValueError):
                host_rules.judge(df)


def test_symbols_count_on_suspect_hosts_only(spark):
    good, marked = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80))
    rows = [(f"h{k}", marked if i % (4 if k == 3 else 25) == 0 else good) for k in range(12) for i in range(100)]
    got = host_rules.judge(spark.createDataFrame(rows, "source string, text string"))
    assert {r.source for r in got.where("host_suspect").select("source").distinct().collect()} == {"h3"}
    assert got.where("kept").count() == len(rows) - 25 and got.where("base_failed OR host_rejected").count() == 0


def test_query_equals_its_sql_and_the_method_decides(spark):
    """On the driver's table: hosts on both sides, rows whose verdict the hosts turn, and DuckDB's answer."""
    from cartolake.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    names = ["doc_id", *host_rules.MEASURES, "kept"]
    got = sorted(tuple(r[n] for n in names) for r in queries()["op7_host_rules"](spark, sf).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert got == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op7_host_rules']})").fetchall())
    judged = host_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    hosts = judged.groupBy("source").agg(F.max("host_suspect").alias("s")).collect()
    assert {r.s for r in hosts} == {True, False}
    turned = judged.where("NOT base_failed AND NOT kept")
    assert 0 < turned.count() < judged.count() / 10 and turned.where("NOT host_suspect").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert turned.join(labels, "doc_id").where("quality = 1").count() == 0
