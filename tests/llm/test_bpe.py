import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartolake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", None, "İstanbul Σας ΣΑΣ ǅ", "a<|endoftext|>B <|startoftext|>", "x\x1cy \x85z​﻿q", "don't I'LL we'd 'S", "é 가", "12345 ½ ①", "ab" * 5000, "é" * 300, "!" * 1000, "𝒳🙂🙂 ok"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(spark, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdefghij  .,é'ß\n3") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, other string"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.other == "kept"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, text):
    assert bpe.load(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike():
    b, rng = bpe.Bpe(PATH), random.Random(4)
    for _ in range(200):
        parts = [b.inner[ord(rng.choice("aenrtsh"))] for _ in range(rng.randint(1, 60))]
        assert b.merge(parts[:]) == b.merge_long(parts[:])


def test_empty_table_and_clashing_names(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "text string"), PATH).columns == ["text", "ids", "decoded"]
    with pytest.raises(ValueError):
        bpe.encode_decode(spark.createDataFrame([], "text string, IDS int"), PATH)


def test_every_code_point(library):
    """First, inner and last in a word, and before a mark that may compose with it; of planes without letters every 97th."""
    from cartolake.llm import rans

    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0xE0000, 97), *range(0xE0000, 0xF0000), *range(0xF0000, 0x110000, 97)]
    own, other = bpe.load(PATH), rans.Tokens(PATH)
    for at in range(0, len(points), 4000):
        texts = [" ".join(f"{c}ab a{c}B Ab{c} {c}̇" for c in map(chr, points[k : k + 100])) for k in range(at, min(at + 4000, len(points)), 100)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        ids, ends = own.pieces.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want, hex(points[at])
        assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == want, hex(points[at])


def test_pieces_are_forgotten_and_made_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    made = []
    pieces = bpe.Pieces(lambda new: [made.append(p) or np.array([len(p)] * (len(p) % 3), np.int32).tobytes() for p in new])
    rng = random.Random(6)
    for _ in range(60):
        texts = [rng.choice([None, "", " ", "\n".join("x" * rng.randint(1, 200) for _ in range(rng.randint(0, 6)))]) for _ in range(4)]
        ids, ends = pieces.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[len(p) for p in (t or "").split() for _ in range(len(p) % 3)] for t in texts]
    assert len(pieces.new) <= 5 + 24 and len(made) > len(set(made))
    assert pieces.ids(pa.array([], pa.string()))[1].tolist() == [0]


def test_no_buffers_stay_after_a_task(monkeypatch):
    """A worker serves later stages too: what its last task's batches took goes back."""
    done = []

    class Pool:
        def release_unused(self):
            done.append(rows)

    batches = [pa.RecordBatch.from_arrays([pa.array(["a b", None])], ["text"])] * 2
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    rows = 0
    for part in bpe._Coded(PATH, ["text", "ids", "decoded"], 0)(iter(batches)):
        rows += part.num_rows
    assert done == [4]
