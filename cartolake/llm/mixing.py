"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents all get the same expected number of copies, target / size, of which the whole part is fixed and the fraction is
rounded: two documents' fractions meet, and mass moves from one to the other, in a random direction and so far that one of them
becomes 0 or 1. What moves is measured in words, so a pair's expected words stay as they are at every step and each document's
expected copies stay what they were. What is left of a block of documents is one fractional document, and the blocks' residuals are
combined in a tree, BLOCK at a time, until one document a source is left, which is drawn by its fraction. The words taken of a source
so differ from its target by less than one document.

Blocks are dealt by a hash within each source, so a source with a third of all rows is as many more blocks; no task holds more than a
block's ids and sizes at once. Rows alike in all columns are one unit with a count before anything is shuffled, and a unit's
rows or copies are made CHUNK at a time, so that a mass of identical rows is spread over tasks again. Sources' sizes, weights and targets are a
table of one row a source, which is ranked and filled by ranges of rows and sums over ranges where it is large.

Defined results: a null text has size 0; a very long text counts whole; a null source is a source and comes last; rows with a null id are mixed
like others; repeated rows each get their own share; a document of size 0 takes no words, and is drawn by itself; a table without words has
targets 0; an empty table gives no rows. mix() passes all columns through and refuses its own names; columns with maps don't tell rows
apart. Reruns agree: draws are hashes of SEED and the units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, n_words, refuse

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 64, 20240501
CHUNK, FEW = 4096, 100_000  # rows that one row is turned into at once; sources that one task ranks


def uniform(*cols: Column) -> Column:
    """A draw in [0, 1), fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / F.lit(float(1 << 53))


def _ahead(rows: DataFrame, n: int, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows, n of them, with, for each of sums, its sum over the rows that come before in this order, which has no ties.

    More than FEW rows are dealt into ranges; only the ranges' totals, one row each, then meet in one task.
    """
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(past(w)), F.lit(0))
    if n <= FEW:
        return rows.select("*", *[over(c, Window.orderBy(*order)).alias(name) for name, c in sums.items()])
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = totals.select("_range", *[over(F.col(f"_t_{name}"), Window.orderBy("_range")).alias(f"_b_{name}") for name in sums])
    found = ranged.select("*", *[over(c, Window.partitionBy("_range").orderBy(*order)).alias(f"_o_{name}") for name, c in sums.items()]).join(before, "_range")
    return found.select(*rows.columns, *[(F.col(f"_o_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table of source and size.

    Weights go round the sources in code-point order. Sources are filled in the order of limit to weight: one stops at its limit if its
    share of what the earlier ones leave is above it; the others share the rest by weight. What goes to the driver is four sums.
    """
    by_source = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    whole = by_source.agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).first()
    n, size, most = whole["n"], float(whole["size"] or 0), float(most)
    weight = float(n // len(weights) * sum(weights) + sum(weights[: n % len(weights)]))
    name = F.col("source").asc_nulls_last()
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighted = _ahead(by_source, n, [name], {"place": F.lit(1)}).select("source", "source_size", turn.alias("weight"))
    filled = _ahead(weighted.withColumn("fill", F.col("source_size") / F.col("weight")), n, [F.col("fill").asc(), name], {"sizes_ahead": F.col("source_size"), "weights_ahead": F.col("weight")})
    limit = most * F.col("source_size")
    capped = filled.withColumn("capped", limit < F.col("weight") * (size - most * F.col("sizes_ahead")) / (weight - F.col("weights_ahead")))
    held = capped.where("capped").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, free = size - most * float(held["size"] or 0), weight - float(held["weight"] or 0)
    shared = F.col("weight") * F.lit(rest / free if free else 0.0)
    return capped.select("source", "source_size", F.when(F.col("capped"), limit).otherwise(shared).alias("target"))


def _numbered(rows: DataFrame, count: str, number: str, large: bool) -> DataFrame:
    """Each row as often as count says, numbered from 1; CHUNK at a time and dealt out between if any count is large."""
    if not large:
        return rows.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))
    chunks = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK).cast("long"))))
    spread = chunks.repartition(*[c for c, kind in chunks.dtypes if kind in ("bigint", "string")])
    return spread.withColumn(number, F.explode(F.sequence(F.col("_chunk") * CHUNK + 1, F.least(F.col(count), (F.col("_chunk") + 1) * CHUNK)))).drop("_chunk")


def _pivot(kept: Column, new: Column) -> Column:
    """One step: kept and new units with fraction p and size meet; the decided one gets its extra copy or not, the other goes on."""
    p1, p2, ratio = kept["p"], new["p"], new["size"] / kept["size"]
    moves = F.struct(
        F.least(1 - p1, p2 * ratio).alias("up"), F.least(p1, (1 - p2) * ratio).alias("down"),
        (1 - p1 <= p2 * ratio).alias("up1"), (p1 <= (1 - p2) * ratio).alias("down1"), uniform(kept["key"], new["key"]).alias("u"),
    )

    def chosen(m: Column) -> Column:
        up = m["u"] * (m["up"] + m["down"]) < m["down"]
        first = F.when(up, m["up1"]).otherwise(m["down1"])  # the kept unit is the decided one
        extra = F.when(first, up).otherwise(~up)
        q = F.when(first, F.when(up, p2 - m["up"] / ratio).otherwise(p2 + m["down"] / ratio)).otherwise(F.when(up, p1 + m["up"]).otherwise(p1 - m["down"]))
        on = lambda f: F.when(first, new[f]).otherwise(kept[f]).alias(f)
        off = lambda f: F.when(first, kept[f]).otherwise(new[f]).alias(f)
        names = ("key", "doc_id", "size", "mark", "m", "whole")
        return F.struct(
            F.struct(*map(on, names), F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)).alias("p")).alias("kept"),
            F.struct(*map(off, names), extra.cast("long").alias("extra")).alias("decided"),
        )

    return F.transform(F.array(moves), chosen)[0]


_DECIDED = "array<struct<key:bigint,doc_id:bigint,size:bigint,mark:bigint,m:bigint,whole:bigint,extra:bigint>>"


def _reduce(units: DataFrame) -> DataFrame:
    """(source, block, units) to one row a block: what is decided, and the unit that is left."""
    listed = units.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))

    def step(a: Column, x: Column) -> Column:
        return F.transform(F.array(_pivot(a["kept"], x)), lambda r: F.struct(r["kept"].alias("kept"), F.concat(a["decided"], F.array(r["decided"])).alias("decided")))[0]

    start = F.struct(F.col("units")[0].alias("kept"), F.array().cast(_DECIDED).alias("decided"))
    return listed.select("source", "block", F.aggregate(F.slice("units", 2, F.size("units")), start, step).alias("r")).select("source", "block", "r.kept", "r.decided")


def _mark(docs: DataFrame) -> Column:
    """What tells rows of the same id apart: a hash of all columns, maps left out."""
    return F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Units of docs' rows alike in doc_id, source, size and mark: m, their number; copies, what they get together; each, what each gets at
    least; source_size and target. Of a unit's rows the first copies - m * each get one more than the others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _mark(docs).alias("mark"))
    units = materialize(rows.groupBy("source", "doc_id", "size", "mark").agg(F.count("*").alias("m")), "mix-units")
    goal = targets(units.select("source", (F.col("size") * F.col("m")).alias("size")))
    number = units.groupBy("source").agg(F.count("*").alias("units"))
    goal = materialize(goal.join(number, goal["source"].eqNullSafe(number["source"])).select(goal["*"], "units"), "mix-targets")
    most = goal.agg(F.max("units")).first()[0] or 0
    g = goal.withColumnRenamed("source", "_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = units.join(g, F.col("source").eqNullSafe(F.col("_source"))).withColumn("each", F.floor(expected))
    known = known.withColumn("more", (expected - F.col("each")) * F.col("m")).withColumn("key", F.xxhash64(F.lit(SEED), "source", "doc_id", "size", "mark"))
    known = known.withColumn("whole", F.floor("more")).withColumn("p", F.col("more") - F.floor("more"))
    fraction = (F.col("p") > 0) & (F.col("size") > 0)
    names = ["source", "doc_id", "size", "mark", "m"]
    alone = known.where(~fraction).select(*names, (F.col("whole") + (uniform(F.col("key")) < F.col("p")).cast("long")).alias("more"))
    unit = F.struct("key", "doc_id", "size", "mark", "m", "whole", "p").alias("unit")
    blocks = lambda level: F.ceil(F.col("units") / float(BLOCK**level)).cast("long")
    deal = lambda key, level: F.pmod(F.xxhash64(F.lit(level), key), blocks(level))
    level, at = 1, known.where(fraction).select("source", "units", unit).withColumn("block", deal(F.col("unit.key"), 1))
    decided = alone
    while True:
        done = materialize(_reduce(at), f"mix-level{level}")
        part = done.select("source", F.explode("decided").alias("d"))
        decided = decided.unionByName(part.select("source", "d.doc_id", "d.size", "d.mark", "d.m", (F.col("d.whole") + F.col("d.extra")).alias("more")))
        if most <= BLOCK**level:
            break
        level += 1
        at = done.select("source", "kept").join(g.select("_source", "units"), F.col("source").eqNullSafe(F.col("_source"))).select("source", F.col("kept").alias("unit"), deal(F.col("kept.key"), level).alias("block"))
    last = done.select("source", "kept.*").withColumn("more", F.col("whole") + (uniform(F.lit("last"), F.col("key")) < F.col("p")).cast("long"))
    decided = decided.unionByName(last.select(*names, "more"))
    found = decided.join(g, F.col("source").eqNullSafe(F.col("_source")))
    return found.select(*names, F.floor(expected).alias("each"), (F.floor(expected) * F.col("m") + F.col("more")).alias("copies"), "source_size", "target")


def taken(docs: DataFrame, **names: str) -> DataFrame:
    """For every row of docs: doc_id, source, size, source_size, target, copies, and taken, the words that the mix takes of it."""
    units = materialize(copies(docs, **names), "mix-taken")
    large = (units.agg(F.max("m")).first()[0] or 0) > CHUNK
    own = F.col("each") + F.floor((F.col("copies") - F.col("each") * F.col("m") + F.col("m") - F.col("_row")) / F.col("m"))
    return _numbered(units, "m", "_row", large).withColumn("copies", own).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed table: each row of docs as often as the mix takes it, all columns as they were.

    A unit's rows are alike in every column, so one of them stands for all of its copies.
    """
    keys = ["_mark", "_id", "_nameless"]
    refuse(docs, {*keys, "_copies", "_copy", "_chunk"})
    number = F.col(id_col).cast("long")
    made = copies(docs, id_col, source_col, text_col).select(F.col("mark").alias("_mark"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("doc_id").isNull().alias("_nameless"), "m", F.col("copies").alias("_copies"))
    units = materialize(made, "mix-copies")
    most = units.agg(F.max("m").alias("m"), F.max("_copies").alias("c")).first()
    keyed = docs.select("*", _mark(docs).alias("_mark"), F.coalesce(number, F.lit(0).cast("long")).alias("_id"), number.isNull().alias("_nameless"))
    keyed = keyed.dropDuplicates(keys) if (most["m"] or 0) > 1 else keyed
    joined = keyed.join(units.where("_copies > 0").drop("m"), keys)
    return _numbered(joined, "_copies", "_copy", (most["c"] or 0) > CHUNK).select(*[F.col(c) for c in docs.columns])
