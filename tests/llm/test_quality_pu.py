import random
import zlib

import numpy as np
import pytest

from cartolake.llm import quality_pu as Q

SCHEMA = "doc_id long, text string, lang string, quality string"


def rows(n=1500):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([5, 60, 300]))]
        good = rng.random() < 0.8
        text = " ".join(w).capitalize() + "." if good else rng.choice([" ".join(x + "###" for x in w), " ".join([w[0]] * 80), " ".join(w).upper().replace(" ", "!! ") + "!!"])
        docs.append((i, text, "en", "x"))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows()
    extra = [(90001, None, None, None), (90002, "", None, None), (90003, "a " * 200_000, None, None), (None, "null id text", None, None), (3, docs[3][1], "en", "x")]
    df = spark.createDataFrame(docs + extra, SCHEMA)
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    scorer = Q.fit(df, lab)
    got = Q.score(df, scorer)
    assert got.columns == ["doc_id", "lang", "quality", "score"] and got.count() == len(docs) + len(extra)
    score = {r.doc_id: r.score for r in got.collect()}
    held = [(score[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum((s >= Q.THRESHOLD) == bool(q) for s, q in held) / len(held) > 0.93
    assert all(0 <= s <= 1 for s in score.values()) and score[90001] == score[90002]
    again = Q.fit(df.repartition(5), lab.repartition(3))
    assert np.allclose(again.w["W"], scorer.w["W"])


def test_held_out_labels_are_never_read(spark):
    docs, labels = rows(300)
    df = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (Q.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert all((a.w[k] == b.w[k]).all() for k in a.w) and a.prior == b.prior


def test_negative_risk_is_turned_back():
    """With few positives the plain risk would fall far below zero; the fitted one stays near it."""
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(1, 1, (10, Q.FIGURES)), rng.normal(0, 1, (2000, Q.FIGURES))
    s = Q.Scorer(0.6).fit(xp, xu)
    z = [np.clip((x - s.mean) / s.scale, -6, 6) for x in (xp, xu)]
    assert s.risk(*z)[1] > -0.2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    scorer = Q.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score(df, scorer).count() == 0 and abs(scorer.scores(np.zeros((1, Q.FIGURES)))[0] - 0.5) < 1e-9
    with pytest.raises(ValueError):
        Q.score(spark.createDataFrame([], "text string, SCORE double"), scorer)
