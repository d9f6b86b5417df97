"""BPE encoding and decoding with a published vocabulary, by the contiguous rank array.

A word is held as three contiguous arrays: the boundaries of its parts, the parts' ids and the ranks of adjacent pairs. The smallest rank
is found by a scan, one boundary is deleted, and the two neighbouring ranks are looked up anew. Words beyond SHORT symbols take a heap
instead of the scan, with the same result, so that one very long word doesn't cost the square of its length.

The operator reads a tokenizers file whose normalizer is made of NFC, whitespace replacement and lower-casing, whose pre-tokenizer splits by
a pattern that never crosses white space, and whose model is BPE over the byte alphabet. It refuses other files. White-space separated
pieces therefore encode independently of their neighbours: a step's texts are cut and their distinct pieces found by Arrow's kernels, each
distinct piece is encoded once, and the ids are gathered by numpy. Each Python worker keeps the pieces it has seen last, CACHE to twice as
many. Characters beyond ASCII are normalised by the library's own normalizer, whose Unicode tables are not Python's.

Defined results: a null or empty text has no ids and decodes to an empty text; very long texts are steps by themselves; repeated rows repeat
their result; an empty table gives no rows; all other columns pass through as they are, except that columns named as the operator's own
outputs are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .shared import refuse

SHORT, CACHE, NONE = 128, 200_000, 1 << 60
#: Most text handled at once, in bytes; a longer text is a step by itself.
STEP = 6_000_000


def char_class(name: str) -> str:
    """The ranges of characters that the library's pattern engine has in a class such as \\p{L}; Python's tables are of other versions."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    runs = Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str("".join(map(chr, points)))
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" if points[b - 1] - points[a] == b - 1 - a else f"\\U{points[a]:08x}-\\ud7ff\\ue000-\\U{points[b - 1]:08x}" for _, (a, b) in runs)


class Pieces:
    """Ids of texts by the pieces that ASCII white space separates, for coders that never cross it.

    make gets distinct pieces and gives each one's ids as 32-bit integers in a row. What it gave is kept by generations: when CACHE newer
    pieces have come, those that haven't been asked for since are forgotten.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.make = make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _found(self, distinct: list[str]) -> list[bytes]:
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        names = [distinct[i] for i in missing]
        known = list(map(self.old.get, names)) if self.old else [None] * len(names)
        made = iter(self.make([n for n, x in zip(names, known) if x is None]))
        for i, n, x in zip(missing, names, known):
            found[i] = x = next(made) if x is None else x
            if len(n) <= SHORT:
                self.new[n] = x
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin, with the end; a null has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        found = self._found(pc.binary_join(whole, "\n")[0].as_py().split("\n"))  # no piece has a line's end
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int32, len(found)) // 4, out=ends[1:])
        taken = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32))).take(coded.indices)
        return taken.values.to_numpy(), taken.offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """One vocabulary file's encoder and decoder."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or (split.get("type"), split.get("behavior"), split.get("invert")) != ("Split", "Removed", True) or level.get("type") != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"]] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: a file of another make")
        classes = {name: char_class(name) for name in (r"\s", r"\p{L}", r"\p{N}")}
        pattern = split["pattern"]["Regex"]
        for name, ranges in classes.items():
            pattern = pattern.replace(name, ranges)
        self.word = re.compile(pattern)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.end) for c in alphabet]
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.pieces = Pieces(lambda new: list(map(self._piece, new)))

    def merge(self, parts: list[int]) -> list[int]:
        """The ids that a short word's symbols merge into, by the rank array."""
        get, made = self.ranks.get, self.made
        bounds = list(range(len(parts) + 1))
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del bounds[i + 1], parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """As merge(), for long words: a heap of (rank, place) over a linked list."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p >= 0]

    def _plain(self, piece: str) -> list[int]:
        """The ids of a piece without special tokens."""
        ids: list[int] = []
        for word in self.word.findall(piece.lower() if piece.isascii() else self.normal(piece)):
            data = word.encode("utf-8", "replace")
            parts = [p for p in [*(self.inner[b] for b in data[:-1]), self.last[data[-1]]] if p is not None]
            ids += self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts)
        return ids

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece without ASCII white space, as 32-bit integers in a row; special tokens in it are found before it is normalised."""
        if self.cut and self.cut.search(piece):
            ids = [i for t in self.cut.split(piece) for i in ([self.special[t]] if t in self.special else self._plain(t))]
        else:
            ids = self._plain(piece)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, without added special tokens."""
        return self.pieces.ids(pa.array([text], pa.string()))[0]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by a space, as for any file that names no decoder; ids outside the vocabulary have no text."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, read once in a process. The file has to be at this path on every executor."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def steps(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most about STEP bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > STEP:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


class _Coded:
    def __init__(self, path: str, names: list[str], text_at: int) -> None:
        self.path, self.names, self.text_at = path, names, text_at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(self.path)
        for batch in batches:
            for part in steps(batch, self.text_at):
                ids, ends = bpe.pieces.ids(part.column(self.text_at))
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                texts = pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, column, texts], self.names)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task, of any stage, keeps no buffers


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>, the whole text's ids, and decoded string, the text that those ids decode to."""
    refuse(docs, {"ids", "decoded"})
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(_Coded(path, schema.names, docs.columns.index(text_col)), schema)
