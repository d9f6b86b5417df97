"""Compression of binary columns, in Arrow batches. zstd needs the zstandard package where its functions run."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(s: pd.Series, f) -> pd.Series:  # noqa: ANN001
    return s.map(lambda b: None if b is None else f(bytes(b)))


@F.pandas_udf(T.BinaryType())
def zlib_compress(b: pd.Series) -> pd.Series:
    return _each(b, zlib.compress)


@F.pandas_udf(T.BinaryType())
def zlib_decompress(b: pd.Series) -> pd.Series:
    return _each(b, zlib.decompress)


@F.pandas_udf(T.BinaryType())
def zstd_compress(b: pd.Series) -> pd.Series:
    import zstandard

    return _each(b, zstandard.ZstdCompressor(level=1).compress)


@F.pandas_udf(T.BinaryType())
def zstd_decompress(b: pd.Series) -> pd.Series:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return _each(b, lambda x: d.decompressobj().decompress(x))


# A range coder with adaptive frequencies of bytes: carryless, 32 bits of state. For short values; large columns are better left to the above.

_TOP, _BOTTOM, _MOST = 1 << 24, 1 << 16, 1 << 13


class _Counts:
    """How often each byte has come so far, one more for all; halved before the total would outgrow the coder."""

    def __init__(self) -> None:
        self.counts, self.total = [1] * 256, 256

    def add(self, symbol: int) -> None:
        self.counts[symbol] += 32
        self.total += 32
        if self.total > _MOST:
            self.counts = [(c + 1) // 2 for c in self.counts]
            self.total = sum(self.counts)


def range_pack(data: bytes) -> bytes:
    """Length, then the coded bytes."""
    low, span, out, model = 0, 0xFFFFFFFF, bytearray(len(data).to_bytes(4, "little")), _Counts()
    for symbol in data:
        span //= model.total
        low = (low + sum(model.counts[:symbol]) * span) & 0xFFFFFFFF
        span *= model.counts[symbol]
        model.add(symbol)
        while True:
            if (low ^ (low + span)) >= _TOP:
                if span >= _BOTTOM:
                    break
                span = -low & (_BOTTOM - 1)
            out.append(low >> 24)
            low, span = (low << 8) & 0xFFFFFFFF, (span << 8) & 0xFFFFFFFF
    return bytes(out + low.to_bytes(4, "big"))


def range_unpack(data: bytes) -> bytes:
    n, low, span, at, model = int.from_bytes(data[:4], "little"), 0, 0xFFFFFFFF, 8, _Counts()
    code, out = int.from_bytes(data[4:8], "big"), bytearray()
    for _ in range(n):
        span //= model.total
        wanted, symbol, start = ((code - low) & 0xFFFFFFFF) // span, 0, 0
        while start + model.counts[symbol] <= wanted:
            start += model.counts[symbol]
            symbol += 1
        out.append(symbol)
        low = (low + start * span) & 0xFFFFFFFF
        span *= model.counts[symbol]
        model.add(symbol)
        while True:
            if (low ^ (low + span)) >= _TOP:
                if span >= _BOTTOM:
                    break
                span = -low & (_BOTTOM - 1)
            code = ((code << 8) | (data[at] if at < len(data) else 0)) & 0xFFFFFFFF
            at += 1
            low, span = (low << 8) & 0xFFFFFFFF, (span << 8) & 0xFFFFFFFF
    return bytes(out)


# Short values are packed many at once, one symbol of each in a step: while the model isn't halved, a count is one and 32 for each time that the
# symbol came before in the value, so it's had from the symbols so far.

_SHORT, _GROUP = 128, 8_192  # bytes of a value, values of a group


def _below(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The sum of the counts of lesser symbols, by value."""
    return symbol + 32 * (before < symbol[:, None]).sum(axis=1)


def _shift(low: np.ndarray, span: np.ndarray, live: np.ndarray, shifted: Callable[[np.ndarray], None]) -> None:
    """The coder's renormalizing of the live values, in place; shifted is told whose top byte goes, before it does."""
    rows = np.flatnonzero(live)
    while len(rows):
        lo, sp = low[rows], span[rows]
        apart = (lo ^ (lo + sp)) >= _TOP
        more = ~(apart & (sp >= _BOTTOM))
        sp = np.where(apart & more, -lo & (_BOTTOM - 1), sp)
        rows, lo, sp = rows[more], lo[more], sp[more]
        shifted(rows)
        low[rows], span[rows] = (lo << 8) & 0xFFFFFFFF, (sp << 8) & 0xFFFFFFFF


def _pack_group(values: list[bytes]) -> list[bytes]:
    sizes = np.array([len(v) for v in values])
    text = np.zeros((len(values), max(1, sizes.max())), np.int64)
    for i, v in enumerate(values):
        text[i, : len(v)] = np.frombuffer(v, np.uint8)
    low, span, out = np.zeros(len(values), np.int64), np.full(len(values), 0xFFFFFFFF, np.int64), [bytearray(len(v).to_bytes(4, "little")) for v in values]

    def shifted(rows: np.ndarray) -> None:
        for i, top in zip(rows.tolist(), (low[rows] >> 24).tolist()):
            out[i].append(top)

    for k in range(sizes.max()):
        live, symbol, before = sizes > k, text[:, k], text[:, :k]
        step = np.where(live, span // (256 + 32 * k), 0)
        low[:] = np.where(live, (low + _below(before, symbol) * step) & 0xFFFFFFFF, low)
        span[:] = np.where(live, step * (1 + 32 * (before == symbol[:, None]).sum(axis=1)), span)
        _shift(low, span, live, shifted)
    return [bytes(o + last.to_bytes(4, "big")) for o, last in zip(out, low.tolist())]


def _unpack_group(values: list[bytes]) -> list[bytes]:
    sizes = np.array([int.from_bytes(v[:4], "little") for v in values])
    ends = np.array([len(v) for v in values])
    coded = np.zeros((len(values), ends.max() + 1), np.int64)
    for i, v in enumerate(values):
        coded[i, : len(v)] = np.frombuffer(v, np.uint8)
    text = np.zeros((len(values), max(1, sizes.max())), np.int64)
    low, span, at = np.zeros(len(values), np.int64), np.full(len(values), 0xFFFFFFFF, np.int64), np.full(len(values), 8)
    code = coded[:, 4] << 24 | coded[:, 5] << 16 | coded[:, 6] << 8 | coded[:, 7]

    def shifted(rows: np.ndarray) -> None:
        code[rows] = ((code[rows] << 8) | coded[rows, np.minimum(at[rows], ends.max())]) & 0xFFFFFFFF
        at[rows] += 1

    for k in range(sizes.max()):
        live, before = sizes > k, text[:, :k]
        step = np.where(live, span // (256 + 32 * k), 1)
        wanted, symbol = ((code - low) & 0xFFFFFFFF) // step, np.zeros(len(values), np.int64)
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            symbol = np.where(_below(before, symbol + bit) <= wanted, symbol + bit, symbol)
        text[:, k] = np.where(live, symbol, 0)
        low[:] = np.where(live, (low + _below(before, symbol) * step) & 0xFFFFFFFF, low)
        span[:] = np.where(live, step * (1 + 32 * (before == symbol[:, None]).sum(axis=1)), span)
        _shift(low, span, live, shifted)
    return [t[:n].tobytes() for t, n in zip(text.astype(np.uint8), sizes.tolist())]


def _many(s: pd.Series, size: Callable[[bytes], int], group: Callable[[list[bytes]], list[bytes]], one: Callable[[bytes], bytes]) -> pd.Series:
    """Short values by groups, others one by one."""
    values = [None if b is None else bytes(b) for b in s]
    short = [i for i, b in enumerate(values) if b is not None and size(b) <= _SHORT]
    done = dict.fromkeys(short)
    for k in range(0, len(short), _GROUP):
        part = short[k : k + _GROUP]
        done.update(zip(part, group([values[i] for i in part])))
    return pd.Series([b if b is None else done[i] if i in done else one(b) for i, b in enumerate(values)], index=s.index, dtype=object)


@F.pandas_udf(T.BinaryType())
def range_encode(b: pd.Series) -> pd.Series:
    return _many(b, len, _pack_group, range_pack)


@F.pandas_udf(T.BinaryType())
def range_decode(b: pd.Series) -> pd.Series:
    return _many(b, lambda v: int.from_bytes(v[:4], "little") if 8 <= len(v) <= 4 * _SHORT else _SHORT + 1, _unpack_group, range_unpack)
