"""Media columns of TIFF files: walk the image directories, decode strips or tiles, undo predictors, one row per page.

Decoded: both byte orders; 1, 2, 4, 8, 16 and 32 bits a sample; chunky and planar samples; strips and tiles; no compression, PackBits, LZW and
deflate; horizontal differencing. A page comes back as rows of chunky samples in the machine's little-endian order, one byte a sample
below 8 bits. The writer makes such files too; its images hold any payload, which is how texts are stored here. Most are stored with deflate
in strips with the predictor; what a payload's hash chooses, one in TILED, PACKED or LZWED, is stored in tiles, with PackBits or with LZW, so that
equal texts have equal files and the stored corpus has all layouts. Stored files are read back through the same rows of pages as any others,
and consecutive pages are folded to one row a file.

Defined results: a null file has no pages; a file or page that can't be read is one row with its fault in error and no data; directories that
come again end the walk; repeated rows repeat their pages; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import refuse

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Fixed values of the format: bytes of each field type, and the tags that are read.
_TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
#: A stored row: pixels of three samples. Pages have PAGE_ROWS rows at most, strips STRIP_ROWS.
PIXELS, SAMPLES, PAGE_ROWS, STRIP_ROWS = 192, 3, 4096, 128
#: One in so many payloads is stored in tiles of TILE, with PackBits, or with LZW.
TILED, PACKED, LZWED, TILE = 8, 64, 128, (64, 64)
#: Bytes of pixels that are handed on at once.
BATCH = 1 << 22


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count below 128 copies so many bytes and one, one above repeats the next byte 257 - count times."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        else:
            if c > 128:
                out += data[i + 1 : i + 2] * (257 - c)
            i += 1 if c == 128 else 2
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out += bytes((i - start - 1,)) + data[start:i]
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, 256 clears, 257 ends, and codes widen one entry early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, before, out = first[:], 9, b"", []
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = first[:], 9, b""
            continue
        if code < len(table):
            piece = table[code]
        elif code == len(table) and before:
            piece = before + before[:1]
        else:
            raise ValueError("an LZW code without an entry")
        out.append(piece)
        if before:
            table.append(before + piece[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        before = piece
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    table = {bytes((i,)): i for i in range(256)}
    size, before = 258, b""
    for byte in data:
        piece = before + bytes((byte,))
        if piece in table:
            before = piece
            continue
        put(table[before])
        table[piece] = size
        size += 1
        if size + 1 > 1 << width:
            if width < 12:
                width += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        before = bytes((byte,))
    if before:
        put(table[before])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_PACK = {NONE: lambda d: d, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits}
_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, 32946: zlib.decompress, PACKBITS: unpack_bits}


def write_file(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<", planar: bool = False) -> bytes:
    """A TIFF file of pages, arrays of height x width x samples of unsigned integers; tile is (height, width), multiples of 16."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0"
    link = 4
    for page in pages:
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        planes = [page[:, :, k : k + 1] for k in range(samples)] if planar else [page]
        th, tw = tile or (min(rows, height), width)
        chunks = []
        for plane in planes:
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    part = plane[y : y + th, x : x + tw]
                    if tile:
                        part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                    chunks.append(_PACK[compression](part.astype(part.dtype.newbyteorder(order)).tobytes()))
        places = []
        for c in chunks:
            places.append(len(out))
            out += c
        tags = [(_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [bits] * samples), (_COMPRESSION, 3, [compression]), (_PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (_SAMPLES, 3, [samples]), (_PLANAR, 3, [2 if planar else 1]), (_PREDICTOR, 3, [predictor])]
        tags += [(_TILE_WIDTH, 4, [tw]), (_TILE_HEIGHT, 4, [th]), (_TILE_OFFSETS, 4, places), (_TILE_COUNTS, 4, [len(c) for c in chunks])] if tile else [(_OFFSETS, 4, places), (_ROWS, 4, [th]), (_COUNTS, 4, [len(c) for c in chunks])]
        entries = b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                at, data = len(out), out.extend(data) or b""
                data = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries) // 12) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The integer fields of the directory at a place, and the place of the next."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if not letter:
            continue
        place = at + 10 + 12 * k
        if count * _TYPE_SIZES[kind] > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1), one(_BITS, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(_BITS, [1]))) > 1:
        raise ValueError(f"{bits} bits a sample")
    if (compression := one(_COMPRESSION, 1)) not in _UNPACK:
        raise ValueError(f"compression {compression}")
    planar, predictor = one(_PLANAR, 1) == 2 and samples > 1, one(_PREDICTOR, 1)
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"predictor {predictor} at {bits} bits")
    tiled = _TILE_OFFSETS in tags
    th, tw = (one(_TILE_HEIGHT, 0), one(_TILE_WIDTH, 0)) if tiled else (min(one(_ROWS, height), height), width)
    places, sizes = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    if not (width and height and th and tw):
        raise ValueError("a page without pixels")
    per, kind = 1 if planar else samples, np.dtype(f"{order}u{max(1, bits // 8)}")
    page = np.zeros((height, width, samples), kind.newbyteorder("<"))
    down, across = -(-height // th), -(-width // tw)
    if len(places) < down * across * (samples if planar else 1) or len(sizes) != len(places):
        raise ValueError("strips or tiles are missing")
    for k in range(down * across * (samples if planar else 1)):
        plane, cell = divmod(k, down * across)
        y, x = cell // across * th, cell % across * tw
        rows = th if tiled else min(th, height - y)
        raw = _UNPACK[compression](data[places[k] : places[k] + sizes[k]])
        if bits < 8:
            line = -(-tw * per * bits // 8)
            if len(raw) < rows * line:
                raise ValueError("a strip or tile ends early")
            spread = np.unpackbits(np.frombuffer(raw[: rows * line], np.uint8).reshape(rows, line), axis=1).reshape(rows, -1, bits)
            part = (spread @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : tw * per].reshape(rows, tw, per)
        else:
            need = rows * tw * per * kind.itemsize
            if len(raw) < need:
                raise ValueError("a strip or tile ends early")
            part = np.frombuffer(raw[:need], kind).reshape(rows, tw, per).astype(page.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=page.dtype)
        part = part[: height - y, : width - x]
        page[y : y + part.shape[0], x : x + part.shape[1], plane if planar else slice(None)] = part[:, :, 0] if planar else part
    return page


def pages(data: bytes | None) -> Iterator[dict]:
    """A file's pages in order: page, width, height, samples, bits, compression, pixels (an array), error."""
    if data is None:
        return
    empty = {"page": 0, "width": 0, "height": 0, "samples": 0, "bits": 0, "compression": 0, "pixels": None}
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if not order:
        yield empty | {"error": "not a TIFF file"}
        return
    seen: set[int] = set()
    number = 0
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(data, at, order)
            one = lambda tag, default: tags.get(tag, [default])[0]  # noqa: E731, B023
            row = empty | {"page": number, "width": one(_WIDTH, 0), "height": one(_HEIGHT, 0), "samples": one(_SAMPLES, 1), "bits": one(_BITS, 1), "compression": one(_COMPRESSION, 1)}
            try:
                yield row | {"pixels": _page(data, tags, order), "error": None}
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                yield row | {"error": str(e) or type(e).__name__}
            number += 1
    except struct.error as e:
        yield empty | {"page": number, "error": str(e)}


def store(text: str | None) -> bytes:
    """A text's UTF-8, filled up with bytes 255 to whole rows, as a file of RGB pages."""
    row = PIXELS * SAMPLES
    payload = (text or "").encode("utf-8", "replace")
    payload += b"\xff" * (-len(payload) % row or (0 if payload else row))
    image = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, SAMPLES)
    parts = [image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]
    chosen = zlib.crc32(payload)
    if chosen % LZWED == 0:
        return write_file(parts, LZW)
    if chosen % PACKED == 1:
        return write_file(parts, PACKBITS, 1)
    return write_file(parts, tile=TILE) if chosen % TILED == 2 else write_file(parts)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array([store(t.as_py()) for t in part.column(1)], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, and media, the text's file, for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_PAGE = "page int, width long, height long, samples int, bits int, compression int, pixels binary, error string"


class _Pages:
    """Rows of files to rows of pages, BATCH bytes of pixels at a time."""

    def __init__(self, names: list[str], at: int) -> None:
        self.names, self.at = names, at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        rest = [n for k, n in enumerate(self.names[: -len(kinds)])]
        for batch in batches:
            columns = [c for k, c in enumerate(batch.columns) if k != self.at]
            rows: list[int] = []
            found: list[tuple] = []
            size = 0

            def made() -> pa.RecordBatch:
                taken = [c.take(pa.array(rows, pa.int64())) for c in columns]  # noqa: B023
                return pa.RecordBatch.from_arrays([*taken, *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], [*rest, *self.names[-len(kinds) :]])  # noqa: B023

            for i in range(batch.num_rows):
                for page in pages(batch.column(self.at)[i].as_py()):
                    page["pixels"] = None if page["pixels"] is None else page["pixels"].tobytes()
                    rows.append(i)
                    found.append(tuple(page.values()))
                    size += len(page["pixels"] or b"")
                    if size >= BATCH:
                        yield made()
                        rows, found, size = [], [], 0
            if rows:
                yield made()


def explode_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """files without the media column, one row for each page: page, width, height, samples, bits, compression, pixels, error.

    A file's pages come in order, one after the other, in the partition that the file was in.
    """
    own = T.StructType.fromDDL(_PAGE)
    refuse(files, own.names)
    schema = T.StructType([*[f for f in files.schema.fields if f.name != media_col], *own.fields])
    return files.mapInArrow(_Pages(schema.names, files.columns.index(media_col)), schema)


class _Folded:
    """Rows of pages, in the order of explode_pages(), to one row for each file. A page 0 begins another file."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        rest = len(self.names) - len(kinds)
        squared, steps = np.arange(256) ** 2, np.arange(256)
        first: list = []  # of the file that is read: the columns that go with it
        done: list[tuple] = []

        def start() -> None:
            nonlocal total, slope, n, count, sha, tail
            total, slope, n, count, sha, tail = np.zeros(256, np.int64), 0, 0, 0, hashlib.sha256(), b""

        def end() -> None:
            bands = ",".join(str(int(x)) for x in total.reshape(16, 16).sum(axis=1))
            feature = f"pages={count};sum={int((total * steps).sum())};squares={int((total * squared).sum())};slope={slope};bands={bands};bytes={n}"
            done.append((*first, n, sha.hexdigest(), zlib.crc32(tail), feature))

        def made(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in done], kind) for k, kind in enumerate([*schema.types[:rest], *kinds])]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, self.names)

        total = slope = n = count = sha = tail = None
        start()
        schema = None
        for batch in batches:
            schema = batch.schema
            place = {name: batch.column(name) for name in ("page", "width", "samples", "pixels", "error")}
            for i in range(batch.num_rows):
                if place["error"][i].is_valid:
                    raise ValueError(f"a stored file can't be read: {place['error'][i].as_py()}")
                if place["page"][i].as_py() == 0:
                    if first:
                        end()
                    start()
                    first = [batch.column(k)[i].as_py() for k in range(rest)]
                raw = place["pixels"][i].as_buffer()
                levels = np.frombuffer(raw, np.uint8).reshape(-1, place["width"][i].as_py(), place["samples"][i].as_py())
                total += np.bincount(levels.reshape(-1), minlength=256)
                slope += int(np.abs(np.diff(levels.astype(np.int16), axis=1)).sum())
                n, count = n + len(raw), count + 1
                sha.update(raw)
                tail = (tail + raw.to_pybytes()[-32:])[-32:]
            yield made(schema)
        if first:
            end()
            yield made(schema)


def read_back(stored: DataFrame) -> DataFrame:
    """stored without the media, with media_bytes, media_sha256, and payload_bytes, payload_sha256, tail_crc32 and feature from its pages' rows."""
    known = [c for c in stored.columns if c != "media"]
    files = stored.select(*known, F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    own = T.StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    schema = T.StructType([*files.drop("media").schema.fields, *own.fields])
    return explode_pages(files).mapInArrow(_Folded(schema.names), schema)
