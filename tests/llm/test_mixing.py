import random
from collections import defaultdict

import pytest

from cartolake.llm import mixing

SCHEMA = "doc_id long, text string, source string, SIZE2 int"


def targets(sizes):
    """The contract's way: share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in share:
            goal[s] += share[s]
            if goal[s] > 3 * sizes[s]:
                left += goal[s] - 3 * sizes[s]
                goal[s] = 3.0 * sizes[s]
                free.discard(s)
    return goal


def test_targets_and_taken(spark):
    rng = random.Random(2)
    names = [None, "a", "é", "b", "z", "tiny", "none"]
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 30, 200])), "a" if i % 3 == 0 else rng.choice(names), 1) for i in range(3000)]
    rows += [(7, "same words here", "b", 1)] * 90 + [(None, "no id", "z", 2)] * 3 + [(9999, None, "none", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    sizes, biggest, took = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source, _ in rows:
        n = len((text or "").split())
        sizes[source] += n
        biggest[source] = max(biggest[source], n)
    want = targets(sizes)
    for r in got:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    for s in sizes:
        assert abs(took[s] - want[s]) <= biggest[s] + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(df.repartition(3)).collect()), key=str)
    mixed = defaultdict(int)
    for r in mixing.mix(df).collect():
        mixed[r.source] += len((r.text or "").split())
    assert mixed == {s: n for s, n in took.items() if n} | {s: 0 for s in mixed if not took[s]}


def test_each_document_keeps_its_expected_copies(spark):
    rows = [(i, "w " * (1 + i % 4), "a" if i % 5 else "b", 1) for i in range(4000)]
    got = mixing.taken(spark.createDataFrame(rows, SCHEMA)).collect()
    for size in (1, 2, 3, 4):
        own = [r for r in got if r.source == "a" and r.size == size]
        assert abs(sum(r.copies for r in own) / len(own) - own[0].target / own[0].source_size) < 0.06


def test_empty(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None)], SCHEMA)).count() == 0


def test_masses_of_alike_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, "same words in all of these rows", "a", 1)] * 500 + [(i, "w " * 9, "b", 2) for i in range(300)] + [(3, "w " * 9, "b", 2)] * 40 + [(None, "same words", "a", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, mixed = mixing.taken(df).collect(), mixing.mix(df).collect()
    assert len(got) == len(rows) and set(mixed) <= set(df.collect())
    for s in "ab":
        own = [r for r in got if r.source == s]
        took = sum(r.taken for r in own)
        assert abs(took - own[0].target) <= 9 and took == sum(len(r.text.split()) for r in mixed if r.source == s)
    assert max(r.copies for r in got if r.doc_id is None) - min(r.copies for r in got if r.doc_id is None and r.size == 7) <= 1
    clash = df.withColumnRenamed("SIZE2", "_n")
    assert mixing.mix(clash).columns == clash.columns
    for name in ("_ID", "_mark", "_copies"):
        with pytest.raises(ValueError):
            mixing.mix(df.withColumnRenamed("SIZE2", name))


@pytest.mark.parametrize("n,few", [(1, 10), (2, 0), (9, 0), (400, 1000), (400, 10)])
def test_targets_of_many_sources(spark, monkeypatch, n, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(n)
    sizes = {f"s{i}é" if i else None: rng.choice([0, 1, 7, 100, 5000, 10**6]) for i in range(n)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
