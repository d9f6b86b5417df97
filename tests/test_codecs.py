import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartolake.functions import codecs
from cartolake.plans.properties import Node


def test_compression_round_trips(spark):
    pytest.importorskip("zstandard")
    df = spark.createDataFrame([(b"",), (b"abc" * 1000,), (None,), (bytes(range(256)),)], "b binary")
    got = df.select("b", codecs.zlib_decompress(codecs.zlib_compress("b")).alias("z"), codecs.zstd_decompress(codecs.zstd_compress("b")).alias("s"), F.length(codecs.zlib_compress("b")).alias("n")).collect()
    assert all(r.b == r.z == r.s for r in got) and got[1].n < 100


def test_property_trees():
    root = Node("map", {"title": "é <&>", "dpi": 96, "scale": 0.1, "on": True, "blob": b"\0\xff", "nothing": None})
    root.add("layer", id=1).add("renderer", symbol="dot")
    root.add("layer", id=2)
    assert Node.from_xml(root.to_xml()) == root == Node.from_json(root.to_json())
    assert [n.get("id") for n in root.named("layer")] == [1, 2] and root.child("layer").child("renderer").get("symbol") == "dot" and root.get("none", 5) == 5
    root.remove("layer")
    assert root.child("layer") is None
    with pytest.raises(ValueError):
        Node("x", {"bad": [1]}).to_xml()


def test_short_values_are_coded_together(monkeypatch):
    """The same bytes as one by one, and the coder for one value isn't asked for short ones."""
    rng = random.Random(3)
    values = [None, *(bytes(rng.choice([0, 254, 255, rng.randrange(256)][:kinds]) for _ in range(size)) for kinds in (1, 3, 4) for size in (0, 1, 2, 18, 127, 128, 129, 300) for _ in range(5))]
    packed = [None if v is None else codecs.range_pack(v) for v in values]
    assert list(codecs.range_encode.func(pd.Series(values, dtype=object))) == packed and list(codecs.range_decode.func(pd.Series(packed, dtype=object))) == values
    assert list(codecs.range_encode.func(pd.Series([None], dtype=object))) == [None] and len(codecs.range_decode.func(pd.Series([], dtype=object))) == 0
    long, one, back = [], codecs.range_pack, codecs.range_unpack
    monkeypatch.setattr(codecs, "range_pack", lambda v: long.append(len(v)) or one(v))
    monkeypatch.setattr(codecs, "range_unpack", lambda v: long.append(len(back(v))) or back(v))
    codecs.range_decode.func(codecs.range_encode.func(pd.Series(values, dtype=object)))
    assert len(long) == 60 and min(long) > 128
