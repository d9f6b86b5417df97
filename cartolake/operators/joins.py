"""Joins that SQL's equi-joins don't express by themselves: by order, and by ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def semi(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys are in b."""
    return a.join(b, keys, "left_semi")


def anti(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_anti")


def as_of(a: DataFrame, b: DataFrame, by: list[str], at: str, values: list[str], prefix: str = "b_") -> DataFrame:
    """Each row of a with values of b's last row of the same key that isn't later than it; of b's rows at one time the greatest values.

    Both tables are put in one order by key and time, and the last row of b is carried on by a window, so nothing is multiplied. by has to
    part the rows finely enough for a task; rows with null times get nothing.
    """
    held = F.struct(*values)
    names = [c for c in a.columns if c not in (*by, at)]
    left = a.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row") if names else F.struct(F.lit(1).alias("_none")).alias("_row"), F.lit(None).cast(b.select(held.alias("v")).schema["v"].dataType).alias("_held"))
    right = b.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = left.unionByName(right).withColumn("_last", F.last("_held", ignorenulls=True).over(order)).where("_side = 1")
    return joined.select(*by, F.col("_at").alias(at), *[F.col(f"_row.{n}") for n in names], *[F.col(f"_last.{v}").alias(f"{prefix}{v}") for v in values])


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df in partitions of about so many rows, by keys that tell rows apart: for work that is dear by the row, where a small file would be one task.

    It counts df first. Spark doesn't put the partitions together again.
    """
    tasks = math.ceil(df.count() / rows)
    return df if tasks <= 1 else df.repartition(min(tasks, 20_000), *keys)


#: Pairs that a task may look at, and rows that it may hold, before there are more tasks.
WORK, ROWS = 100_000_000, 1_000_000


def even(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join made ready for tasks of one size, and its keys.

    A key whose rows make more than WORK pairs is cut into blocks: its rows on the left are dealt into i parts, those on the right into j, and
    each part comes to every block that it belongs to, with numbers of parts that copy the fewest rows. Parts are chosen by a hash of the plain
    columns, so rows that are alike in all of them stay together. Partitions are as many as the pairs and rows need, and Spark doesn't put them together again.
    The keys' counts are one more pass; to the driver come the keys over WORK, each of which has at least twice WORK's root of rows.
    """
    one, none = F.count("*"), F.lit(0).cast("long")
    sides = left.groupBy(*keys).agg(one.alias("_a")).withColumn("_b", none).unionByName(right.groupBy(*keys).agg(one.alias("_b")).withColumn("_a", none))
    pairs = F.col("_a").cast("double") * F.col("_b")
    found = sides.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).agg(
        F.sum(pairs).alias("pairs"), F.sum(F.col("_a") + F.col("_b")).alias("rows"), F.collect_list(F.when(pairs > WORK, F.struct(*keys, "_a", "_b"))).alias("crowded")
    ).first()
    tasks = math.ceil((found["pairs"] or 0) / WORK + (found["rows"] or 0) / ROWS)
    if tasks <= 1:
        return left, right, keys
    if found["crowded"]:
        parts = left.sparkSession.createDataFrame([(*[r[k] for k in keys], *_parts(r["_a"], r["_b"])) for r in found["crowded"]], left.select(*keys, F.lit(1).alias("_is"), F.lit(1).alias("_js")).schema)
        left, right = (_blocks(df, parts, keys, *names) for df, names in ((left, ("_i", "_is", "_j", "_js")), (right, ("_j", "_js", "_i", "_is"))))
        keys = [*keys, "_i", "_j"]
    tasks = min(tasks, 20_000)
    return left.repartition(tasks, *keys), right.repartition(tasks, *keys), keys


def _parts(a: int, b: int) -> tuple[int, int]:
    """Parts of a key's rows on either side, for blocks of about WORK pairs."""
    blocks = math.ceil(a * b / WORK)
    right = min(blocks, max(1, round(math.sqrt(blocks * b / a))))
    return math.ceil(blocks / right), right


def _blocks(df: DataFrame, parts: DataFrame, keys: list[str], own: str, owns: str, other: str, others: str) -> DataFrame:
    """Rows with a part of their own, for each part of the other side."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    dealt = df.join(F.broadcast(parts), keys, "left").withColumn(own, F.pmod(F.xxhash64(*plain), F.coalesce(owns, F.lit(1))).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop(owns, others)


def ranges(a: DataFrame, point: str, b: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows of a with each row of b whose closed range holds the point.

    Ranges are dealt over buckets of the width, which should be of the ranges' order; a range of more than MOST buckets goes to a level of
    wider ones. Points go to one bucket of each level that occurs, of which there are LEVELS at most. Crowded buckets are cut (even).
    """
    size = F.greatest(F.lit(1.0), (F.col(high) - F.col(low)) / width)
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(size) / F.log(F.lit(float(MOST))) - 1e-9) - 1)).cast("int")
    ranged = b.where((F.col(low) <= F.col(high))).withColumn("_level", level)
    used = sorted(r["_level"] for r in ranged.select("_level").distinct().collect())  # LEVELS numbers at most
    step = lambda lv: F.lit(float(width)) * F.pow(F.lit(float(MOST)), lv)
    slot = lambda value, lv: F.when(lv == LEVELS - 1, F.lit(0).cast("long")).otherwise(F.floor(value / step(lv)))
    held = ranged.withColumn("_slot", F.explode(F.sequence(slot(F.col(low), F.col("_level")), slot(F.col(high), F.col("_level")))))
    asked = a.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(u) for u in used]).cast("array<int>"))).withColumn("_slot", slot(F.col(point), F.col("_level")))
    asked, held, keys = even(asked, held, ["_level", "_slot"])
    return asked.join(held, keys).where(_between(F.col(point), F.col(low), F.col(high))).drop(*keys)


MOST, LEVELS = 16, 12


def _between(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)
