import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from cartolake.llm import pii

from .test_mixing import targets
from .test_simhash import brute

SF = "/root/testdata/sf0.001"


def one_of_each(rows):
    """The smallest id of each group: fingerprints of op1's contract, and five-word similarity of all pairs that share a shingle."""
    root = {i: c for i, _, c in brute(rows)}

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, having = {i: grams(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    met = {(a, b) for group in having.values() for a in group for b in group if a < b and root[a] != root[b]}
    for a, b in sorted(met):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_stages_hold_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "src1", 0), (90_003, "1 2 3", "en", None, 5), (None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = {r.doc_id: r for r in docs.where("doc_id is not null").collect()}
    steps = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        steps[name] = rows
        if name != "tokens":
            assert docs.columns == P.COLUMNS
        docs = spark.createDataFrame(rows, docs.schema)
    spoken = {r.doc_id for r in steps["language_id"]}
    assert {i for i, r in texts.items() if re.search(r"[a-z]{3}", (r.text or "").lower())} <= spoken and not {90_001, 90_002, 90_003} & spoken
    assert sorted(r.doc_id for r in steps["near_dedup"]) == one_of_each([(r.doc_id, r.text) for r in steps["language_id"]])
    assert [r.doc_id for r in sorted(steps["personal_data"])] == [r.doc_id for r in sorted(steps["near_dedup"])]
    for r in steps["personal_data"]:
        before = texts[r.doc_id].text
        assert not re.search(pii.BASE["email"], r.text) and not re.search(r"\+1 \(\d{3}\) 555-\d{4}", r.text) and r.n_chars == len(r.text)
        if not re.search(r"[0-9@]", before):
            assert r.text == before
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, took, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in steps["personal_data"]:
        sizes[r.source] += n(r.text)
        biggest[r.source] = max(biggest[r.source], n(r.text))
    for r in steps["mix_sources"]:
        took[r.source] += n(r.text)
    assert all(abs(took[s] - t) <= biggest[s] + 1e-6 for s, t in targets(sizes).items())
    clean = {r.doc_id: r.text for r in steps["personal_data"]}
    assert all(clean[r.doc_id] == r.text for r in steps["mix_sources"]) and max(Counter(r.doc_id for r in steps["mix_sources"]).values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps["tokens"]) == Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in steps["mix_sources"])


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.agg(F.min(F.size("ids") == F.col("n_tokens"))).first()[0]


def test_stages_take_any_rows(spark):
    """Nulls in every column, repeated rows and ids, very long texts, other columns with the operators' own names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    own = "_id _row _more _kept _nameless _copy _mark _copies _chunk _candidates spans base_spans ids decoded score fp copy".split()
    rows = [tuple(r) for r in plain] + [tuple(plain[5])] * 3 + [(plain[7].doc_id, plain[9].text, "en", "src1", 1)]
    rows += [(None, None, None, None, None), (None, plain[3].text, None, None, None), (-1, "", "en", None, 0), (-2, " \n", None, "src2", None), (-3, "the and of " * 200_000, "en", "src1", None)]
    for name, stage in P.STAGES:
        wide = spark.createDataFrame([r + ("x",) * len(own) for r in rows], schema + "".join(f", {c} string" for c in own))
        got = stage(spark, wide, SF)
        assert got.columns == (["doc_id", "source", "n_tokens", "ids"] if name == "tokens" else P.COLUMNS)
        found = Counter(r.doc_id for r in got.collect())
        if name == "language_id":
            assert found[None] == 1 and found[plain[5].doc_id] == 4 and found[-1] == found[-2] == 0 and found[-3] == 1
        if name == "near_dedup":
            assert found[plain[5].doc_id] <= 1 and found[None] == 0 and found[-1] + found[-2] == 1 and found[-3] == 1
        if name in ("personal_data", "tokens"):
            assert found == Counter(r[0] for r in rows)
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
