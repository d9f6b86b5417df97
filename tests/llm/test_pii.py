import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import pii

SCHEMA = "doc_id long, text string, kind string"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 1, "card": 12 <= len(d) <= 19 and luhn(m[0]), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(8)
    made = ["", None, "a@b.c%x@y.z", "a..b@c-d.e.f.g@h.i", "1.2.3.4.5 256.1.1.1 01.002.3.4 1.2.3.4.5.6.7.8", "+1 (017) 555-7713 +12 3 +1()2345678", "4111 1111 1111 1111 4111-1111-1111-1111-9", "é𝒳 x@y.zz 9.9.9.9", "9" * 50_000, "a" * 100_000, "1 " * 50_000, "a@" * 20_000, "+1" + " " * 50_000, "@.", "1.1.1", "5 4111111111111111"]
    for n in (10, 40, 200):
        made += ["".join(rng.choice(["1", "4", "22", "7", "0", "255", "256", ".", ".", ".", "-", " ", "+", "@", "a", "é", "(", "%"]) for _ in range(n)) for _ in range(3000)]
    for _ in range(200):
        d = [str(rng.randrange(10)) for _ in range(rng.choice([11, 12, 15, 16, 19, 20]))]
        made.append("x " + rng.choice(["", " ", "-"]).join(d) + rng.choice([" y", "", "-", "z"]))
    return made


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts())]
    got = pii.detect(spark.createDataFrame(rows, SCHEMA), scores={}).collect()
    for r in got:
        assert [tuple(s) for s in r.base_spans] == brute(r.text) == [tuple(s) for s in r.spans], r.text
        assert r.kind == "k"


def test_method_adds_and_redacts(spark):
    secret = 'token = "5d190bd7c06284de91015a36974748794293dd8a"'
    rows = [(i, f"words {w} and 4111111111111112 more{i} me@mail.com then +1 (017) 555-77{i % 90 + 10} é {secret} end", "k") for i, w in enumerate(["plain", "version 1.2.3.4", "contact joe [at] site [dot] com", "tel: 555-123-4567"] * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, r in got.items():
        assert [tuple(s) for s in r.base_spans] == brute(r.text)
        kinds = [r.text[s.start : s.end] for s in r.spans if s.kind == 4]
        assert kinds == [secret] and set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))
        assert not any(r.text[s.start : s.end] == "4111111111111112" for s in r.spans)
    clean = pii.redact(df).where("doc_id = 0").first().text
    assert clean.startswith("words plain and 4111111111111112 more0 <EMAIL> then <PHONE> é <SECRET> end")
    line = pii.detect(df).where("doc_id = 0").select(pii.listed("spans").alias("s"), pii.count("spans", "email").alias("n")).first()
    at = rows[0][1].index("me@mail.com")
    assert line.s.startswith(f"email:{at}:{at + 11},phone:") and line.n == 1


def test_reliabilities():
    number = lambda kind, votes, form: (sum((v + 1) * 3 ** (4 - i) for i, v in enumerate(votes)) + kind * 3**5) * 16 + form
    counts = {number(0, (1, 1, 1, 0, 1), 5): 900, number(0, (1, 1, 1, -1, 1), 5): 100, number(2, (0, -1, 1, 0, 1), 5): 500, number(2, (0, -1, -1, 0, 1), 5): 500}
    belief, right = pii.estimate(counts)
    assert belief[number(0, (1, 1, 1, 0, 1), 5)] > 0.95 > 0.3 > belief[number(2, (0, -1, -1, 0, 1), 5)]
    assert right[1] > right[3]


def test_empty(spark):
    assert pii.detect(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pii.redact(spark.createDataFrame([(1, None, None)], SCHEMA)).first().text is None
    with pytest.raises(ValueError):
        pii.detect(spark.createDataFrame([], "text string, Spans int"))


def test_addresses_with_zero_parts(spark):
    made = ["10.0.0.1", "x 127.0.0.1, 192.168.0.7", "0.0.0.0 00.0.000.1", "010.00.0255.9 256.0.0.1 0256.0.0.1", "1.0.0.1000 0.0.0", "0" * 4_000 + "1.0.0.1", "0.0.0." + "0" * 4_000]
    rng = random.Random(10)
    made += [" ".join(".".join(rng.choice(["0", "00", "000", "07", "0255", "256", "90", "1"]) for _ in range(4)) for _ in range(8)) for _ in range(100)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(made)], SCHEMA)
    for r in pii.detect(df, scores={}).collect():
        assert [tuple(s) for s in r.base_spans] == brute(r.text), r.text[:100]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "<IP>" and clean[1] == "x <IP>, <IP>"


def test_very_many_spans_in_one_text(spark):
    rng = random.Random(13)
    some = lambda i: rng.choice([f"u{i}@h.example.org", f"10.0.{i % 256}.{i % 255}", f"+4930{i:08d}", f"joe{i} [at] site [dot] com", f"tel 555-123-{i % 10_000:04d}", "é𝒳"])
    text = " ".join(some(i) for i in range(24_000))
    df = spark.createDataFrame([(1, text, "k"), (2, text[:3000], "k")], SCHEMA)
    began = time.time()
    scores = pii.fit(pii.tagged(df))
    got = {r.doc_id: r for r in pii.detect(df, scores=dict.fromkeys(scores, 1.0)).collect()}
    assert [tuple(s) for s in got[1].base_spans] == brute(text)
    spans = list(map(tuple, got[1].spans))
    added = sorted(set(spans) - set(brute(text)))
    assert len(spans) > 19_000 and len(added) > 3000 and spans == sorted(spans)
    taken = np.zeros(len(text), bool)
    for a, _, b in brute(text):
        taken[a:b] = True
    assert not any(taken[a:b].any() for a, _, b in added)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1].count("<EMAIL>") >= sum(k == 0 for _, k, _ in brute(text)) and not re.search(pii.BASE["email"], clean[1])
    assert time.time() - began < 40


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 10_000])
def test_running(spark, n):
    rng = random.Random(n)
    xs = [rng.randint(-5, 50) for _ in range(n)]
    got = spark.createDataFrame([(xs,)], "x array<int>").select(pii._sums(F.col("x")).alias("s"), pii._highest(F.col("x")).alias("h")).first()
    assert got.s == list(itertools.accumulate(xs)) and got.h == [max(-1, m) for m in itertools.accumulate(xs, max)]
