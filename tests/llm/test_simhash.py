import random
import re

import pytest
import xxhash

from cartolake.llm import simhash


def brute(rows):
    """The contract, step by step."""
    fps = {}
    for i, (_, text) in enumerate(rows):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                root[find(b)] = find(a)
    least = {}
    for i in fps:
        least[find(i)] = min(least.get(find(i), 10**9), rows[i][0])
    return sorted((rows[i][0], f"{fps[i]:016x}", least[find(i)]) for i in fps)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))]
        rows.append((3 * i, " ".join(base)))
        near = base[:]
        if near:
            near[rng.randrange(len(near))] = word()
        rows += [(3 * i + 1, "\t ".join(near).upper()), (3 * i + 2, " ".join(base))]
    rows += [(900, None), (901, " \n"), (900, None)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.id, r.fingerprint, r.component_id) for r in got.collect()) == brute(rows)


def test_large_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64) - (1 << 63)
    fps = {centre}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            b = rng.randrange(64)
            x ^= 1 << b if b < 63 else -(1 << 63)
        fps.add(x)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash, "COLD", 10**9)
    whole = {(r.u, r.v) for r in simhash.links(table).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    assert whole == {(a, b) for a in fps for b in fps if a > b and near(a, b)}
    want = {r.u: r.root for r in simhash.connected_components(simhash.links(table)).collect()}
    monkeypatch.setattr(simhash, "COLD", 4)
    assert {r.u: r.root for r in simhash.connected_components(simhash.links(table)).collect()} == want


def test_empty_nulls_and_one_of_each_group(spark):
    schema = "doc_id long, text string, id string, fp int"
    assert simhash.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "a b c d", "z", 3), (None, "a b c d", "u", 4), (None, "only null ids here", "v", 5), (None, "only null ids here", "w", 6), (7, None, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == [(0, "only null ids here"), (1, "a b c d")] and len(kept) == 3


def test_stage_removes_near_copies(spark):
    """The stage of the pipeline against all pairs of five-word similarity 0.8 or more, with keys of few and of many texts."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 60, 200, 400]))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 6):
            near = base[:]
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = f"n{rng.randrange(5000)}"
            rows.append((10 * i + k, " ".join(near).upper()))
    rows += [(900, None), (901, "")]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, contract = {i: grams(t) for i, t in rows}, {i: c for i, _, c in brute(rows)}
    root = dict(contract)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(root.values())) and len(got) < len(set(contract.values()))
    nameless = docs.selectExpr("cast(null as long) AS doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_dedup(spark, nameless, "").count() == len(got)


def test_repeated_ids_of_two_components_keep_both(spark):
    texts = {"A": "all of this is one text here", "B": "quite another text stands in these rows", "C": "and a third one"}
    rows = [(1, "A"), (5, "A"), (5, "B"), (7, "B"), (7, "C"), (7, "C"), (None, "C"), (None, "B")]
    docs = spark.createDataFrame([(i, texts[t], t) for i, t in rows], "doc_id long, text string, id string")
    assert sorted((r.doc_id, r.id) for r in simhash.keep_one(docs).collect()) == [(1, "A"), (5, "B"), (7, "C")]
    for clash in ("_id", "_NAMELESS", "_copy"):
        with pytest.raises(ValueError):
            simhash.keep_one(spark.createDataFrame([], f"doc_id long, text string, {clash} int"))
    assert simhash.components(docs.withColumnRenamed("id", "_copy")).count() == len(rows)


def test_large_similarity_keys(spark, monkeypatch):
    """Near copies under keys of more texts than are joined with themselves: chains in which no text is near all others."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(260)]
    texts = []
    for c in range(6):
        own = [rng.choice(words) for _ in range(120)]
        for _ in range(30):
            own = own[:]
            own[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for cold in (10**9, 8):
        monkeypatch.setattr(simhash, "COLD", cold)
        found[cold] = {r.id: r.component_id for r in simhash.components(docs, similar=0.8).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if simhash.similarity(texts[a], texts[b]) >= 0.8]
    assert len(near) > 300
    for label in found.values():
        assert sum(label[a] == label[b] for a, b in near) >= 0.995 * len(near)
    apart = {frozenset(i // 30 for i in found[10**9] if found[10**9][i] == c) for c in set(found[10**9].values())}
    assert all(len(x) == 1 for x in apart)


@pytest.mark.parametrize("block, room, columns", [(256, 1 << 16, 2048), (3, 300, 50)])
def test_large_similarity_keys_lose_no_pair(spark, monkeypatch, block, room, columns):
    """Many texts that share much with each other, few of them near: under keys of any size, what is 0.8 similar has to meet."""
    rng = random.Random(33)
    texts = []
    for _ in range(200):
        own = [f"w{k}" for k in range(100)]
        for _ in range(2):
            for at in rng.sample(range(100), 2):
                own[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("COLD", 4), ("BLOCK", block), ("ROOM", room), ("COLUMNS", columns)):
        monkeypatch.setattr(simhash, name, value)
    label = {r.id: r.component_id for r in simhash.components(docs, similar=0.8).collect()}
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert [(a, b) for a, b in near if label[a] != label[b]] == [] and len(near) > 200
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    close = [(a, b) for a in range(len(texts)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2]
    for a, b in near + close:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert [label[i] for i in range(len(texts))] == root and len(set(root)) > 20
