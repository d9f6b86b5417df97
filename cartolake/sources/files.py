"""Other sources: CSV look-ups, files in archives, and tables of other databases."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; compressed ones are read as they are."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_lookup(df: DataFrame, key: str, value: str, field: str, ignore_case: bool = True) -> str | None:
    """A field of the first row whose key has a value."""
    match = (F.lower(F.col(key)) == value.lower()) if ignore_case else (F.col(key) == value)
    row = df.where(match).select(field).first()
    return row[0] if row else None


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and content of all files in zip, tar and compressed tar archives at a path; one archive is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                data = io.BytesIO(content)
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield pd.DataFrame({"archive": [name], "member": [m.filename], "content": [z.read(m)]})
                    continue
                data.seek(0)
                with tarfile.open(fileobj=data) as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [t.extractfile(m).read()]})

    return files.mapInPandas(members, "archive string, member string, content binary")


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database that a JDBC driver on the classpath knows."""
    return spark.read.jdbc(url, table, properties=options)
