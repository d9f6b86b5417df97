import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartolake.llm import rans

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENS = rans.Tokens(PATH)
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 300_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    coder = rans.Coder(rans.frequencies(dict(zip(found.tolist(), counts.tolist()))))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    step = rans.CHECKPOINT * block["lanes"]
    for k in range(-(-n // step)):
        assert (coder.decode(block, k, k + 1) == ids[k * step : (k + 1) * step]).all()
    if n > 1000:
        block["states"] = bytes(255 - b for b in block["states"][:4096]) + block["states"][4096:]
        with pytest.raises(ValueError):
            coder.decode(block)


def test_frequencies():
    for counts in ({5: 1}, {1: 10**9, **{i: 1 for i in range(2, 5000)}}, {i: i + 1 for i in range(40_000)}, {}):
        table = rans.frequencies(counts)
        assert set(table) == set(counts) and all(table.values()) and sum(table.values()) == (1 << rans.PRECISION if counts else 0)
    with pytest.raises(ValueError):
        rans.frequencies({1: 1, 2: 1, 3: 1}, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in TOKENS.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aBs'.!9 \n\x1c\x00\x7f\x85\xa0²½ªßéÉŸſİıŁ×", "́", "Σ", "가", "'ll", "<|endoftext|>", "<|", "x" * 200]), max_size=12).map("".join), max_size=4))
def test_latin_text(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in TOKENS.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def _some_words(rng, n):
    return ["".join(rng.choice("aeinrsthéü") for _ in range(rng.randint(1, 12))) + rng.choice(["", ",", ".", "9"]) for _ in range(n)]


def test_work_is_per_step_not_per_word():
    """Python's calls for a step of new words don't grow with them (op10_rans: 465 CPU seconds a GB of 400 with some calls a word)."""
    tokens, rng, calls = rans.Tokens(PATH), random.Random(7), []
    tokens.encode(["some words"])
    for n in (2000, 8000):
        text, seen = " ".join(_some_words(rng, n)), []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
        try:
            found = tokens.encode([text])
        finally:
            sys.setprofile(None)
        calls.append(len(seen))
        assert np.frombuffer(found[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert max(calls) < 1000


@pytest.mark.parametrize("kept", [0, 40, 10_000])
def test_words_are_forgotten_and_asked_again(kept, monkeypatch):
    monkeypatch.setattr(rans, "KEPT", kept)
    tokens, rng = rans.Tokens(PATH), random.Random(8)
    common = _some_words(rng, 30)
    for _ in range(60):
        texts = [" ".join(rng.choices(common, k=10) + _some_words(rng, 15)), None, ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(tokens.words.slots) <= kept + 2 * 25 and len(tokens.words.slots) == len(tokens.words.asked) == len(tokens.words.ends) - 1


def test_words_whose_ends_are_not_told_by_ids():
    tokens, texts = rans.Tokens(PATH), ["Don't 12 ab, é²x", "<|endoftext|>"]
    tokens.words.last[:] = True
    got = tokens.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_large_and_sliced_strings():
    texts = ["first", "Don't 12 ab, é²x", None, "ab"]
    for array in (pa.array(texts, pa.large_string())[1:], pa.array(texts)[1:]):
        ids, ends = TOKENS.ids(array)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def test_another_pattern_is_split_one_by_one(monkeypatch):
    monkeypatch.setattr(rans, "PATTERN", "another")
    tokens, texts = rans.Tokens(PATH), ["Don't 12 ab, é²x ab"]
    assert not tokens.kind.any()
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 500)
    rng = random.Random(4)
    texts = [None, "", " ", "a<|endoftext|>b", "x\x1cy Σας", "z" * 3000, "don't I'LL"] + ["".join(rng.choice("abcde  .é'ß\n3") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)] + [(5, "twice", "y"), (5, "twice", "y"), (None, "no id", "z")]
    got = rans.index(rans.read(spark, rans.write(spark.createDataFrame(rows, "doc_id long, text string, part string"), PATH, 1)))
    library, want, start = Tokenizer.from_file(PATH), [], 0
    for d, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_empty(spark):
    assert rans.index(rans.read(spark, rans.write(spark.createDataFrame([], "doc_id long, text string"), PATH, 1))).count() == 0
