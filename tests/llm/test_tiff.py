import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from cartolake.llm import tiff

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("compression,predictor,order", itertools.product([1, 5, 8, 32773], [1, 2], "<>"))
def test_round_trip(compression, predictor, order):
    for tile, planar, kind in [(None, False, np.uint8), ((16, 32), False, np.uint16), ((32, 16), True, np.uint8), (None, True, np.uint32)]:
        made = [(RNG.integers(0, 200, (h, w, s)) // 40).astype(kind) for h, w, s in [(1, 1, 1), (50, 37, 3), (129, 20, 2)]]
        data = tiff.write_file(made, compression, predictor, 10, tile, order, planar)
        got = list(tiff.pages(data))
        assert [g["error"] for g in got] == [None] * 3
        assert all((g["pixels"] == m).all() and g["pixels"].shape == m.shape for g, m in zip(got, made))


def test_codecs():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 127, 128, 129, 5000, 60_000):
        for letters in (1, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert tiff.unpack_bits(tiff.pack_bits(data)) == data
            assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff.unpack_lzw(bytes.fromhex("800760a0c06030200402")[:0]) == b""
    assert tiff.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")  # the example in PackBits' description


def test_bad_files(spark):
    good = tiff.write_file([np.ones((4, 4, 1), np.uint8)])
    rows = [(1, good), (2, b"II*\0"), (3, b"nothing"), (4, good[:30]), (5, None), (6, b""), (7, good[:8] + b"\0" * 10 + good[18:])]
    got = tiff.explode_pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    found = {r.id: r for r in got}
    assert found[1].error is None and bytes(found[1].pixels) == b"\1" * 16 and found[1].width == 4
    assert all(found[k].error and found[k].pixels is None for k in (2, 3, 4, 6, 7)) and 5 not in found
    assert tiff.explode_pages(spark.createDataFrame([], "media binary")).count() == 0
    with pytest.raises(ValueError):
        tiff.explode_pages(spark.createDataFrame([], "media binary, Page int"))


def test_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "x" * 576), (5, "é" * 3_000_000), (6, "a"), (None, "b" * 577)]
    stored = tiff.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = tiff.read_back(stored).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = (dict(rows)[r.doc_id] or "").encode()
        assert r.n_bytes == len(payload)
        payload += b"\xff" * (-len(payload) % 576) if payload else b"\xff" * 576
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert f"sum={sum(payload)};" in r.feature and f"bytes={len(payload)}" in r.feature


def test_texts_are_stored_in_all_layouts(spark):
    rng = random.Random(5)
    rows = [(i % 50, "".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 1, 500, 1500]))), i) for i in range(900)]
    rows += [(60 + i, "some words " * (250_000 + i), 0) for i in range(4)]
    stored = tiff.store_texts(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3))
    found = tiff.explode_pages(stored).groupBy("compression").count().collect()
    assert {r.compression for r in found} == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW}
    layouts = [tiff._directory(x, *struct.unpack_from("<I", x, 4), "<")[0] for x in (tiff.store(t) for _, t, _ in rows)]
    assert {tiff._TILE_WIDTH in tags for tags in layouts} == {True, False}
    got = tiff.read_back(stored)
    assert got.columns == ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def want(text):
        payload = text.encode()
        payload += b"\xff" * (-len(payload) % 576 or (0 if payload else 576))
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, tiff.PIXELS, tiff.SAMPLES).astype(int)
        bands = ",".join(str(int(((pixels >= 16 * k) & (pixels < 16 * k + 16)).sum())) for k in range(16))
        feature = f"pages={-(-len(pixels) // tiff.PAGE_ROWS)};sum={pixels.sum()};squares={(pixels**2).sum()};slope={abs(np.diff(pixels, axis=1)).sum()};bands={bands};bytes={len(payload)}"
        media = tiff.store(text)
        return len(text.encode()), len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature

    assert sorted(map(tuple, got.collect())) == sorted((i, *want(t)) for i, t, _ in rows)
    assert tiff.read_back(tiff.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
