"""Token ids in binary form: static range asymmetric numeral system (rANS) with interleaved lanes.

Files hold ids in ascending document order. One frequency table, counted over all documents, is shared by every block. A block is a run of
whole documents with BLOCK ids or a few more, and decodes by itself: its ids are dealt over LANES coders in turn, so that one numpy operation
moves all of them. At every CHECKPOINT steps the coders' states and the place in the word stream are recorded, from where decoding can start
as well. Each block carries a CRC-32 of its ids, which decoding verifies.

Format. A folder with two Parquet tables, so that any store Spark writes to can hold it and a lost task's part is written again whole:
  freq    id, frequency; frequencies add up to 2^PRECISION and every id that occurs has one
  blocks  part, row, doc_ids, lengths, n, lanes, crc, states, marks, words
Parts are ranges of doc_id; row is the number of documents of the part before the block. Within a block, documents ascend.

Ids are tokenised and counted once, written as 16-bit integers if the vocabulary fits them, and dealt into ranges once. What goes to the driver is the ids' counts,
at most one for each id of the vocabulary. The ids of documents reach no place but a task that holds a block of them.

Defined results: a null or empty text is the end id alone; a text of more than BLOCK ids is a block by itself, whole; documents with a null
doc_id come first; repeated rows are stored as often as they occur; an empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .bpe import byte_alphabet, load, steps
from .shared import TEXTS, discard, materialize, new_path

PRECISION, LANES, BLOCK, CHECKPOINT = 20, 1024, 1 << 18, 128
PART = 1 << 24  # ids in a part, about, where the session's number of partitions would make them larger
KEPT, LONG = 400_000, 256  # distinct words that a worker keeps, about; characters of a piece at most that is split here
PLAIN = 0x180  # code points below, of at most two bytes, are lower-cased and split as bytes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63); words are 32 bits


def frequencies(counts: dict[int, int], precision: int = PRECISION) -> dict[int, int]:
    """Counts scaled to a total of 2^precision, at least 1 for each id that occurs; ties go by id, so the same counts give the same table."""
    total, room = sum(counts.values()), 1 << precision
    if len(counts) > room:
        raise ValueError("more ids than the precision has room for")
    if not total:
        return {}
    scaled = {i: max(1, n * room // total) for i, n in sorted(counts.items())}
    left = room - sum(scaled.values())
    order = sorted(scaled, key=lambda i: (-counts[i], i))
    scaled[order[0]] += max(0, left)
    while left < 0:
        for i in order:
            cut = min(-left, scaled[i] // 2)
            scaled[i] -= cut
            left += cut
    return scaled


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, table: dict[int, int], precision: int = PRECISION) -> None:
        self.precision = precision
        ids = np.array(sorted(table), np.int64)
        self.freq = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.uint64)
        self.freq[ids] = [table[i] for i in ids]
        self.start = np.zeros_like(self.freq)
        self.start[1:] = np.cumsum(self.freq)[:-1]
        self.symbol = np.repeat(ids, self.freq[ids].astype(np.int64)).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> dict:
        """One block. Lane k codes the ids k, k + lanes, ...; the last step may have fewer lanes than the others."""
        n = len(ids)
        lanes = max(1, min(LANES, n))
        rows = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[bytes] = []
        size, shift, up = 0, np.uint64(32), np.uint64(63 - self.precision)
        scale = np.uint64(self.precision)
        for r in range(rows - 1, -1, -1):
            part = ids[r * lanes : (r + 1) * lanes]
            k = len(part)
            f, c = self.freq[part], self.start[part]
            x = state[:k]
            full = x >= (f << up)
            if full.any():
                words = x[full].astype(np.uint32)
                out.append(words[::-1])
                size += len(words)
                x = np.where(full, x >> shift, x)
            q = x // f
            state[:k] = (q << scale) + (x - q * f) + c
            if r and r % CHECKPOINT == 0:
                marks.append(np.uint32(r).tobytes() + np.uint32(size).tobytes() + state.tobytes())
        stream = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
        return {"n": n, "lanes": lanes, "crc": zlib.crc32(ids.astype("<u4").tobytes()), "states": state.astype("<u8").tobytes(), "marks": b"".join(marks), "words": stream.astype("<u4").tobytes()}

    def decode(self, block: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """The block's ids, or those of the steps from checkpoint number first up to checkpoint number last. A whole block's CRC is verified."""
        n, lanes = block["n"], block["lanes"]
        rows = -(-n // lanes)
        words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
        state, at, row = np.frombuffer(block["states"], "<u8").astype(np.uint64), 0, 0
        if first:
            width = 8 + 8 * lanes
            marks = len(block["marks"]) // width
            mark = block["marks"][(marks - first) * width : (marks - first + 1) * width]
            row, size = (int(v) for v in np.frombuffer(mark[:8], np.uint32))
            state, at = np.frombuffer(mark[8:], np.uint64).copy(), len(words) - size
        end = min(rows, last * CHECKPOINT) if last else rows
        out = np.empty((end - row, lanes), np.uint32)
        mask, scale, shift = np.uint64((1 << self.precision) - 1), np.uint64(self.precision), np.uint64(32)
        for r in range(row, end):
            k = min(lanes, n - r * lanes)
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            out[r - row, :k] = s
            x = self.freq[s] * (x >> scale) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << shift) | words[at : at + len(low)]
                at += len(low)
            state[:k] = x
        ids = out.reshape(-1)[: min(n, end * lanes) - row * lanes]
        if not first and not last and zlib.crc32(ids.astype("<u4").tobytes()) != block["crc"]:
            raise ValueError("a block's checksum doesn't match")
        return ids


class Words:
    """Ids of distinct words, asked from the library's model for many words at once.

    A worker keeps a word's ids by slot. When KEPT words are there, those that a single step has asked for are forgotten, and of the others,
    if they are more than half, those that the fewest steps have asked for; counts of steps are halved then.
    """

    def __init__(self, library: Tokenizer) -> None:
        self.model = library.model
        self.alone = Tokenizer(self.model)
        self.alone.pre_tokenizer = CharDelimiterSplit("\n")
        shown, vocab, suffix = byte_alphabet(), library.get_vocab(with_added_tokens=False), self.model.end_of_word_suffix or ""
        self.shown = np.array([ord(c) for c in shown], "<u2")
        self.shown[ord("\n")] = ord("\n")  # no word has one
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.closed = bool(suffix) and all(c + suffix in vocab for c in shown)  # each word's last id, whatever the word, is one of these
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        if keep is None or not len(keep):
            self.slots: dict[str, int] = {}
            self.asked, self.ends, self.ids = np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int32)
            return
        words = list(self.slots)
        kept = self.lists().take(pa.array(keep))
        self.slots = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.asked, self.ends, self.ids = self.asked[keep] // 2, kept.offsets.to_numpy(), kept.values.to_numpy()

    def lists(self) -> pa.ListArray:
        """The ids of each slot."""
        return pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.ids))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        data = self.shown[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        if self.closed:
            ids = np.array(self.alone.encode_batch_fast([data], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in self.model.tokenize(w)] for w in data.split("\n")]
        return np.array([i for x in each for i in x], np.int32), np.array(list(map(len, each)))

    def at(self, words: list[str]) -> np.ndarray:
        """Slots of distinct words, good until the next call."""
        if len(self.slots) > KEPT:
            often = np.flatnonzero(self.asked > 1)
            self._forget(often if 2 * len(often) <= KEPT else np.sort(np.argsort(-self.asked, kind="stable")[: KEPT // 2]))
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            ids, sizes = self._ids(missing)
            slots[new] = np.arange(len(self.slots), len(self.slots) + len(missing))
            self.slots.update(zip(missing, slots[new].tolist()))
            self.asked = np.concatenate([self.asked, np.zeros(len(missing), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)])
            self.ids = np.concatenate([self.ids, ids])
        self.asked[slots] += 1
        return slots


class Tokens:
    """Texts' ids as the tokenizers library gives them.

    Distinct pieces that white space separates are split into words, distinct words looked up by Words, and ids gathered by Arrow. Pieces of
    letters, digits and signs below U+0180 are lower-cased and split as bytes, all at once, where the library's normalizer takes such
    characters one by one and the file's pattern is PATTERN. Other pieces go through the library's normalizer, if they aren't ASCII, and the
    file's pattern one at a time. That the words' ids are the text's holds for the files that bpe.Bpe takes. Pieces with special tokens or of
    more than LONG characters go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.normal, self.word = self.library.normalizer.normalize_str, load(path).word
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.words = Words(self.library)
        # by code point: 0 for one that isn't split as bytes, 1 for letters, 2 for numbers, 3 for others
        self.kind, self.lower = np.zeros(PLAIN, np.uint8), np.arange(PLAIN, dtype=np.uint16)
        if json.loads(self.library.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"] == {"Regex": PATTERN}:
            for c in map(chr, range(PLAIN)):
                low = self.normal(c)
                if c != "'" and low == c.lower() and len(low) == 1 and len(low.encode()) == len(c.encode()) and self.word.findall(low):
                    self.kind[ord(c)] = 2 if len(self.word.findall(low + low)) == 2 else 1 if len(self.word.findall("a" + low)) == 1 else 3
                    self.lower[ord(c)] = ord(low)

    def _bytes(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces' places, their bytes in lower case, the bytes' kinds, and which bytes follow another in a character."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        kinds, lowered = np.append(self.kind[:128], np.zeros(128, np.uint8))[data], np.append(self.lower[:128], np.zeros(128)).astype(np.uint8)[data]
        follows = np.zeros(len(data), bool)
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + PLAIN // 64))
        lead = lead[lead + 1 < len(data)]
        lead = lead[data[lead + 1] & 0xC0 == 0x80]
        points = (data[lead] & 0x1F).astype(np.uint16) << 6 | data[lead + 1] & 0x3F
        kinds[lead] = kinds[lead + 1] = self.kind[points]
        low = self.lower[points]
        lowered[lead], lowered[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
        follows[lead + 1] = True
        return ends - ends[0], lowered, kinds, follows

    def _split(self, pieces: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """All words of the pieces that can be split as bytes, how many each of these has, and which pieces these are."""
        ends, lowered, kinds, follows = self._bytes(pieces)
        sizes = np.diff(ends)
        plain = sizes <= LONG
        plain[np.searchsorted(ends, np.flatnonzero(kinds == 0), "right") - 1] = False
        for s in self.specials:
            plain &= ~pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        if not plain.all():
            taken = np.repeat(plain, sizes)
            lowered, kinds, follows, ends = lowered[taken], kinds[taken], follows[taken], np.append(0, np.cumsum(sizes[plain]))
        begins = np.ones(len(lowered) + 1, bool)
        begins[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2) & ~follows[1:]
        begins[ends] = True
        starts = np.flatnonzero(begins).astype(np.int32)  # and the end
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(lowered))
        return words, np.diff(np.searchsorted(starts, ends)), plain

    def _pieces(self, pieces: pa.StringArray) -> pa.ListArray:
        """The ids of distinct pieces."""
        words, sizes, plain = self._split(pieces)
        other = pieces.filter(pa.array(~plain)).to_pylist()
        whole = [len(p) > LONG or bool(self.special.search(p)) for p in other]
        split = [() if w else self.word.findall(p.lower() if p.isascii() else self.normal(p)) for p, w in zip(other, whole)]
        words = pa.concat_arrays([words, pa.array([w for x in split for w in x], pa.string())]).dictionary_encode()
        ends = np.append(0, np.cumsum(np.concatenate([sizes, np.array(list(map(len, split)), np.int64)])))
        found = self.words.lists().slice(0, 0)
        if len(words):
            slots = self.words.at(_strings(words.dictionary))
            found = self.words.lists().take(pa.array(slots[words.indices.to_numpy()]))
        made = pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[ends].astype(np.int32)), found.values)
        places = np.empty(len(pieces), np.int64)
        places[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(pieces))
        if any(whole):
            at = np.flatnonzero(~plain)[np.array(whole)]
            places[at] = len(made) + np.arange(len(at))
            asked = [self.library.encode(p, add_special_tokens=False).ids for p, w in zip(other, whole) if w]
            made = pa.concat_arrays([made, pa.array(asked, made.type)])
        return made.take(pa.array(places))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin, with the end; a null has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        taken = self._pieces(coded.dictionary).take(coded.indices)
        return taken.values.to_numpy(), taken.offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, ends = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def _strings(words: pa.StringArray) -> list[str]:
    """Words, none of which has a line's end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


_loaded: dict[str, Tokens] = {}


class _Tokenised:
    """doc_id and ids of each text; and from each task one more row, the counts of all ids it has seen, in the order of the ids."""

    names = ["doc_id", "ids", "counts"]

    def __init__(self, path: str, end: int, kind: str) -> None:
        self.path, self.end, self.kind = path, end, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if self.path not in _loaded:
            _loaded[self.path] = Tokens(self.path)
        tokens = _loaded[self.path]
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in steps(batch, 1):
                ids, ends = tokens.ids(part.column(1))
                ids = np.insert(ids, ends[1:], self.end).astype(self.kind)
                ends = ends + np.arange(len(ends))
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                places = (ends * np.dtype(self.kind).itemsize).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(places), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), made, pa.nulls(part.num_rows, pa.list_(pa.int64()))], self.names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))], self.names)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task, of any stage, keeps no buffers


_BLOCKS = "part int, row long, doc_ids array<long>, lengths array<long>, n long, lanes int, crc long, states binary, marks binary, words binary"


class _Blocks:
    """Sorted documents of a part to blocks; holds one block's ids at a time."""

    def __init__(self, table: dict[int, int], kind: str) -> None:
        self.table, self.kind = table, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(self.table)
        names, held, docs, size, row = [f.split()[0] for f in _BLOCKS.split(", ")], [], [], 0, 0
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        part = None

        def block() -> pa.RecordBatch:
            made = {"part": part, "row": row, "doc_ids": docs, "lengths": [len(x) for x in held]} | coder.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([made[n]], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for p, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = p
                docs.append(doc)
                held.append(np.frombuffer(x.as_buffer(), self.kind))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    row, held, docs, size = row + len(docs), [], [], 0
        if held:
            yield block()


class _Read:
    def __init__(self, table: dict[int, int]) -> None:
        self.table = table

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(self.table)
        for batch in batches:
            for at in range(batch.num_rows):
                b = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids, ends = coder.decode(b), np.cumsum(b["lengths"])
                each = [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]
                n = len(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["part"]] * n, pa.int32()), pa.array(range(b["row"], b["row"] + n), pa.int64()), pa.array(b["doc_ids"], pa.int64()), pa.array(each, pa.binary())],
                    ["part", "row", "doc_id", "ids"],
                )


def write(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Tokenise docs, append the id end to each, and write the tables; returns their folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "rans")
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_Tokenised(tokenizer, end, kind), "doc_id long, ids binary, counts array<long>")
    staged = materialize(found, "rans-ids", 2 * TEXTS)
    counted = staged.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in counted.collect()}
    table = frequencies(counts)
    spark.createDataFrame(sorted(table.items()), "id long, frequency long").coalesce(1).write.parquet(f"{path}/freq")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // PART))
    order = ["doc_id", "tie"]
    ranged = staged.where("counts IS NULL").withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(_Blocks(table, kind), _BLOCKS).write.parquet(f"{path}/blocks")
    discard(staged)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: part, row, doc_id, and ids, little-endian 32-bit integers. Blocks decode in parallel; checksums are verified."""
    table = {r["id"]: r["frequency"] for r in spark.read.schema("id long, frequency long").parquet(f"{path}/freq").collect()}
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(_Read(table), "part int, row long, doc_id long, ids binary")


def index(documents: DataFrame) -> DataFrame:
    """documents of read() without their ids, with n_tokens, ids_crc32, and start, the ids of all documents before each.

    Windows are over the documents of a part, and over one row a part.
    """
    own = materialize(documents.select("part", "row", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "rans-index")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(ahead(Window.orderBy("part"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n_tokens").over(ahead(Window.partitionBy("part").orderBy("row"))), F.lit(0))
    return own.withColumn("_within", within).join(parts, "part").select("doc_id", (F.col("_before") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32")
