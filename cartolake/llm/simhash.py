"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut in BLOCKS parts. Two fingerprints that differ in at most DISTANCE bits agree on BLOCKS - DISTANCE whole parts, so
each fingerprint is dealt out under every choice of so many parts, fingerprints meet by an equi-join on those, and the Hamming distance is
verified. All of this runs on distinct fingerprints, whatever the number of copies.

A key with more than COLD fingerprints isn't joined with itself. There, each fingerprint also goes out under every value that one flipped
bit outside the key gives. Two fingerprints meet under some value exactly if they differ in at most two bits, and a value has at
most one fingerprint for each bit, so this stays linear in the fingerprints and loses no link.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; a very long text is read in
pieces of bounded memory; repeated rows all come back; a null id never is a component's id unless the component has none but null ids; an
empty table gives no rows. Other columns of the input are not read by components(); keep_one() passes all through and refuses its own names.

keep_one() can also link texts by their word shingles' Jaccard similarity. Distinct texts meet under BANDS keys of ROWS smallest hashes each,
which misses a pair of similarity 0.8 with a chance of 3 in 100,000, and every pair that meets is verified by the whole sets of shingles.
A key of more than COLD texts isn't joined with itself. There, each text is first held against one of the key's texts, another for each key. Of
what that leaves apart, every pair is held against each other that shares such a key, and whose sizes allow the similarity: large keys that a
text ties together are one group, its texts are dealt out in blocks, and each pair of blocks is multiplied out as matrices of shingles. Only
texts that are in one component already aren't compared, so no link is lost; near copies of a group soon are, and then the work is in proportion.
Texts under large keys that stay apart cost a comparison for each pair of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import TEXTS, connected_components, discard, materialize, refuse

SEED, SHINGLE, DISTANCE, BLOCKS, COLD = 42, 3, 2, 4, 64
_CHUNK = 1 << 15
#: Of the similarity of texts: shingle, keys of a text and smallest hashes in each; texts in a block under large keys on average, and about how many
#: shingles if texts are long; columns of a matrix at once.
NEAR_SHINGLE, BANDS, ROWS, BLOCK, ROOM, COLUMNS = 5, 20, 4, 256, 1 << 16, 2048
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES = _TIMES << np.uint64(1) | np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text, in bounded memory however long it is."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits at 20 and 09-0D
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, count, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        grams = map(join, zip(*(part[k:] for k in range(shingle)))) if count > 1 or len(words) == shingle else [join(words)]
        hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


class _Signed:
    """id, copy and text to id, copy, fp and, if near, the text's bands."""

    def __init__(self, near: bool) -> None:
        self.near = near

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest = ["id", "copy", "fp", "bands"], pa.list_(pa.int64())
        for batch in batches:
            texts = batch.column(2)
            fps = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            own = [pa.array([bands(t.as_py()) for t in texts], rest)] if self.near else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fps, *own], names[: 3 + self.near])


def copy_of(text_col: str) -> Column:
    """What tells texts apart: 128 bits of them. A null is an empty text."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = False, copies: bool = True) -> DataFrame:
    """(id, copy, fp) for every row, and bands if near; copy is null unless copies."""
    copy = copy_of(text_col) if copies else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), copy.alias("copy"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_Signed(near), "id long, copy string, fp long" + ", bands array<long>" * near)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's runs of NEAR_SHINGLE words, of all its words if there are fewer; they may repeat."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(NEAR_SHINGLE, len(words))
    count = len(words) - size + 1 if words else 0
    out = np.full(count, len(words) if size < NEAR_SHINGLE else NEAR_SHINGLE, np.uint64)
    for k in range(size):
        out = _mix(out + hashes[k : k + count])
    return out


def bands(text: str | None) -> list[int] | None:
    """BANDS keys of a text; null if it has no words."""
    found = shingles(text)
    if not len(found):
        return None
    least = np.full((BANDS * ROWS, 1), (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (_TIMES * found[at : at + 1024] + _PLUS).min(axis=1, keepdims=True), out=least)
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key + column)
    return key.astype(np.int64).tolist()


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of two texts' sets of shingles."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, True))
    return both / max(1, len(x) + len(y) - both)


class _Similar:
    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array([similarity(x.as_py(), y.as_py()) >= self.least for x, y in zip(b.column(2), b.column(3))], pa.bool_()))


class _Sets:
    """copy and text to copy and the set of the text's shingles."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t.as_py())).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["copy", "grams"])


def _flat(sets: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which set and which of the sorted words, for every member of the sets that is one of the words; by words."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.minimum(np.searchsorted(words, values), len(words) - 1)
    there = np.nonzero(words[at] == values)[0]
    there = there[np.argsort(at[there], kind="stable")]
    return owner[there], at[there]


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b."""
    both = np.zeros((len(a), len(b)), np.float32)  # exact below 2^24
    words = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), True)
    if not len(words):
        return both.astype(np.int64)
    flat, total = [_flat(x, words) for x in (a, b)], both.astype(np.int64)
    for start in range(0, len(words), COLUMNS):
        matrices = []
        for sets, (owner, at) in zip((a, b), flat):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            matrix = np.zeros((len(sets), COLUMNS), np.float32)
            matrix[owner[lo:hi], at[lo:hi] - start] = 1
            matrices.append(matrix)
        total += np.matmul(matrices[0], matrices[1].T, out=both).astype(np.int64)
    return total


class _Meet:
    """Rows (p, side, root, grams), in order, to a link of two roots for those that similar texts of the two sides of a p have; a p of one side meets itself."""

    def __init__(self, least: float) -> None:
        self.least = least

    def _links(self, sides: dict[int, list[tuple[int, np.ndarray]]]) -> np.ndarray:
        if not sides:
            return np.zeros((0, 2), np.int64)
        a, b = sides[min(sides)], sides[max(sides)]
        both = shared_counts([x for _, x in a], [x for _, x in b])
        sizes = np.array([len(x) for _, x in a])[:, None] + np.array([len(x) for _, x in b])
        u, v = np.array([r for r, _ in a], np.int64), np.array([r for r, _ in b], np.int64)
        i, j = np.nonzero((both / np.maximum(1, sizes - both) >= self.least) & (u[:, None] != v))
        return np.unique(np.stack([np.maximum(u[i], v[j]), np.minimum(u[i], v[j])], 1), axis=0)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, {}
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["u", "v"])
        for batch in batches:
            for p, side, root, grams in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if p != now:
                    yield out(self._links(sides))
                    now, sides = p, {}
                sides.setdefault(side, []).append((root, grams.values.to_numpy()))
        yield out(self._links(sides))


def _rest(members: DataFrame, texts: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between roots, for all pairs of texts that share a key of members, are similar and have different roots.

    members (t, key, copy, fp), texts (copy, text), roots (u, root): the components so far, by fingerprint. No two texts of one component are
    compared if it fills a block; small components share blocks.
    """
    held = members.select("copy", "fp", F.xxhash64("t", "key").alias("k")).groupBy("copy", "fp").agg(F.collect_set("k").alias("keys"))  # BANDS at most
    held = materialize(held.withColumn("some", F.array_min("keys")), "similar-large")
    tied = connected_components(held.select(F.explode("keys").alias("u"), F.col("some").alias("v")), "similar-groups")
    sets = materialize(texts.join(held.select("copy"), "copy", "left_semi").select("copy", "text").mapInArrow(_Sets(), "copy string, grams array<long>"), "similar-sets", TEXTS)
    width = max(-math.log(max(least, 1e-9)), 1e-3) * (1 + 1e-9)  # of a class of sizes: similar texts are in the same or the next one
    placed = held.join(tied.select(F.col("u").alias("some"), F.col("root").alias("tie")), "some", "left").join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    placed = placed.join(sets.select("copy", F.floor(F.log(F.size("grams")) / width).cast("long").alias("class")), "copy")
    placed = placed.select("copy", F.coalesce("tie", "some").alias("grp"), F.coalesce("root", "fp").alias("root"), "class")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(ROOM / F.exp(width * (F.col("class") + 1))))).cast("long")
    whole = ["grp", "class", "root"]
    alone = placed.groupBy(whole).agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= room, F.col("root")))  # null where components share
    placed = materialize(placed.join(alone.select(*whole, "own"), whole), "similar-placed")
    parts = alone.groupBy("grp", "class", "own").agg(F.ceil(F.sum("n") / F.first(room)).alias("blocks"))
    parts = materialize(parts.withColumn("part", F.monotonically_increasing_id()), "similar-parts")
    dealt = parts.select("grp", "class", "own", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).withColumn("at", F.struct("part", "block"))
    a, b = dealt.alias("a"), dealt.alias("b")
    later = (F.col("b.class") == F.col("a.class") + 1) | (F.col("b.class") == F.col("a.class")) & (F.col("a.at") <= F.col("b.at"))
    apart = F.coalesce(F.col("a.own") != F.col("b.own"), F.lit(True))
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & later & apart).select(F.col("a.at").alias("x"), F.col("b.at").alias("y"))
    pairs = materialize(pairs.withColumn("p", F.monotonically_increasing_id()), "similar-blocks")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))
    asked = pairs.select("p", F.explode(sides).alias("s")).select("p", "s.side", F.col("s.at.part").alias("part"), F.col("s.at.block").alias("block"))
    same = (F.col("l.grp") == F.col("r.grp")) & (F.col("l.class") == F.col("r.class")) & F.col("l.own").eqNullSafe(F.col("r.own"))
    rows = placed.alias("l").join(parts.alias("r"), same).select("l.copy", "l.root", "r.part", F.pmod(F.xxhash64("l.copy"), F.col("r.blocks")).alias("block"))
    rows = rows.join(asked, ["part", "block"]).join(sets, "copy").select("p", "side", "root", "grams")
    found = rows.repartition("p").sortWithinPartitions("p", "side").mapInArrow(_Meet(least), "u long, v long")
    found = materialize(found, "similar-rest", BLOCK)
    discard(held, sets, placed, parts, pairs)
    return found


def similar_links(rows: DataFrame, docs: DataFrame, least: float, text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between fingerprints, enough of them to connect all texts whose similarity is least or more, and those of known, links (u, v).

    rows are signed(docs, near=True), written.
    """
    distinct = rows.where("bands IS NOT NULL").groupBy("copy", "fp").agg(F.first("bands").alias("bands"))
    keyed = distinct.select("copy", "fp", F.posexplode("bands").alias("t", "key"))
    own = F.struct("copy", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min_by(own, F.xxhash64("copy", "t")).alias("centre")).where("n > 1")
    members = materialize(keyed.join(shared, ["t", "key"]), "similar-members")
    cold = members.where(F.col("n") <= COLD).select("t", "key", "copy", "fp")
    other = cold.select("t", "key", F.col("copy").alias("y"), F.col("fp").alias("v"))
    pairs = cold.join(other, ["t", "key"]).where("copy > y AND fp <> v").select(F.col("copy").alias("x"), F.col("fp").alias("u"), "y", "v")
    large = members.where(F.col("n") > COLD)
    stars = large.select(F.col("copy").alias("x"), F.col("fp").alias("u"), F.col("centre.copy").alias("y"), F.col("centre.fp").alias("v")).where("u <> v")
    turned = lambda a, b: F.when(F.col("x") > F.col("y"), F.col(a)).otherwise(F.col(b))
    stars = stars.select(turned("x", "y").alias("x"), turned("u", "v").alias("u"), turned("y", "x").alias("y"), turned("v", "u").alias("v"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "similar-pairs")
    needed = pairs.select(F.explode(F.array("x", "y")).alias("copy")).unionByName(large.select("copy")).distinct()
    texts = docs.where(F.col(text_col).isNotNull()).select(copy_of(text_col).alias("copy"), F.col(text_col).alias("text")).dropDuplicates(["copy"])
    texts = materialize(texts.join(needed, "copy", "left_semi"), "similar-texts")
    x, y = (texts.select(F.col("copy").alias(n), F.col("text").alias(t)) for n, t in (("x", "a"), ("y", "b")))
    found = materialize(pairs.join(x, "x").join(y, "y").select("u", "v", "a", "b").mapInArrow(_Similar(least), "u long, v long"), "similar-links", TEXTS)
    if known is not None:
        found = found.unionByName(known)
    if large.head(1):
        roots = connected_components(found, "similar-round")
        found = roots.select("u", F.col("root").alias("v")).unionByName(_rest(large, texts, roots, least))
    discard(members, pairs, texts)
    return found


def _part(fp: Column, block: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fp, 64 - width * (block + 1)).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v), u > v, between the distinct fingerprints fp of a table, enough of them to connect all that differ in 2 bits or fewer.

    Under keys of at most COLD fingerprints every close pair is a link; under the others every fingerprint is linked with the smallest
    one under each shared value.
    """
    if DISTANCE != 2:
        raise ValueError("the flipped-bit way of large keys is for two differing bits")
    width = 64 // BLOCKS
    tables = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    fp = F.col("fp")
    key = [F.struct(F.lit(t).alias("t"), F.shiftleft(_part(fp, a), width).bitwiseOR(_part(fp, b)).alias("key")) for t, (a, b) in enumerate(tables)]
    keyed = distinct.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, ["t", "key"]), "simhash-members")
    cold = members.where(F.col("n") <= COLD)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE
    pairs = cold.alias("a").join(cold.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    signed = lambda bit: 1 << bit if bit < 63 else -(1 << 63)
    masks = [F.array(*[F.lit(0).cast("long")], *[F.lit(signed(63 - width * b - k)).cast("long") for b in range(BLOCKS) if b not in own for k in range(width)]) for own in tables]
    flips = F.array(*masks)[F.col("t")]
    hot = members.where(F.col("n") > COLD).select("t", "fp", F.explode(flips).alias("mask")).select("t", "fp", fp.bitwiseXOR(F.col("mask")).alias("value"))
    met = hot.groupBy("t", "value").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # at most 33 in each
    met = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
    return pairs.unionByName(met.select("u", "v"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, similar: float | None, copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of signed(), and fp, first (the smallest id of its rows, or null) and root, the smallest fingerprint of its component."""
    rows = materialize(signed(docs, id_col, text_col, similar is not None, copies), "simhash-rows", TEXTS)
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = links(distinct.select("fp"))
    if similar is not None:
        edges = similar_links(rows, docs, similar, text_col, materialize(edges, "simhash-links"))
    roots = connected_components(edges, "simhash-round").withColumnRenamed("u", "fp")
    return rows, distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """For every row: id, fp (long), fingerprint (16 hex digits), component_id, the smallest id in reach over links, and root, its fp.

    With similar, texts of that similarity or more are linked too.
    """
    rows, rooted = _labelled(docs, id_col, text_col, similar, similar is not None)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "simhash-labels")
    joined = rows.join(labels, "fp")
    return joined.select("id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float | None = None) -> DataFrame:
    """The rows of docs, one for each component, as components() finds them: one of its smallest id.

    Rows with a null id stand in for their component only if it has no other rows. Of rows with the same id in one component, that of the
    smallest digest of the text stays; rows alike in id and text are one. The same id in two components gives a row in each. Texts are dealt
    out once, by id and digest, after rows alike in both have been merged; the verdict meets them there.
    """
    refuse(docs, ["_nameless", "_id", "_copy"])
    name = lambda i: [i.isNull().alias("_nameless"), F.coalesce(i, F.lit(0).cast("long")).alias("_id")]
    rows, rooted = _labelled(docs, id_col, text_col, similar)
    first = rows.groupBy("fp").agg(F.min(F.struct(*name(F.col("id")), F.col("copy").alias("_copy"))).alias("row"))
    chosen = materialize(first.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*"), "simhash-chosen")
    keyed = docs.select("*", *name(F.col(id_col).cast("long")), copy_of(text_col).alias("_copy"))
    keys = ["_nameless", "_id", "_copy"]
    return keyed.dropDuplicates(keys).join(chosen, keys, "left_semi").drop(*keys)
