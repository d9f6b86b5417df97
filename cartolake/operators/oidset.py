"""Sets of object ids as one-column DataFrames, and what rows they choose."""

from __future__ import annotations

from pyspark.sql import DataFrame


def of(df: DataFrame, column: str = "oid") -> DataFrame:
    return df.select(df[column].alias("oid")).where("oid is not null").distinct()


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("oid").unionByName(b.select("oid")).distinct()


def remove(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("oid").join(b.select("oid").distinct(), "oid", "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("oid").intersect(b.select("oid"))


def rows_in(table: DataFrame, oids: DataFrame, column: str = "oid") -> DataFrame:
    o = oids.select(oids["oid"].alias("_oid"))
    return table.join(o, table[column] == o["_oid"], "left_semi")


def rows_not_in(table: DataFrame, oids: DataFrame, column: str = "oid") -> DataFrame:
    """Rows whose id isn't in the set; rows without an id stay."""
    o = oids.select(oids["oid"].alias("_oid"))
    return table.join(o, table[column] == o["_oid"], "left_anti")
