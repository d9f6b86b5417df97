"""String, conversion, hash and path functions."""

from __future__ import annotations

import shlex
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left(s: Column, n: int) -> Column:
    """The first n characters; empty if there are fewer."""
    return F.when(F.length(s) < n, "").otherwise(F.substring(s, 1, n))


def suffix(s: Column, pos: int) -> Column:
    """What follows the first pos characters; empty if there are fewer."""
    return F.when(F.length(s) < pos, "").otherwise(F.substring(s, F.lit(pos + 1), F.length(s)))


def mid(s: Column, first: int, count: int) -> Column:
    return F.substring(s, first + 1, count)


def lower_ascii(s: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compare(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """-1, 0 or 1; the empty string is smallest."""
    a, b = (F.upper(a), F.upper(b)) if ignore_case else (a, b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def to_base64(b: Column) -> Column:
    return F.base64(b)


def from_base64(s: Column) -> Column:
    return F.unbase64(s)


def fix_utf8(b: Column) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(b.cast("string"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_args(s: pd.Series) -> pd.Series:
    """Arguments of a command line; quotes hold them together. An open quote goes to the end of the line."""

    def split(x: str | None) -> list[str] | None:
        if x is None:
            return None
        for closing in ("", '"', "'"):
            try:
                return shlex.split(x + closing)
            except ValueError:
                continue
        return [x]

    return s.map(split)


def format_positional(pattern: Column | str, *args: Column) -> Column:
    """{n} replaced by argument n; others stay. What follows a brace that isn't closed is dropped."""
    text = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.split(F.regexp_replace(text, r"(\{)([^}]*)$", "$1"), r"(?<=\})|(?=\{)", -1)
    known = F.create_map(*[x for i, a in enumerate(args) for x in (F.lit(f"{{{i}}}"), F.coalesce(a.cast("string"), F.lit("")))]) if args else F.create_map()
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)) if args else parts, "")


def number_text(n: Column, width: int = 0) -> Column:
    """A number's text, filled up with zeros to a width."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")) if width else s


def to_integer(s: Column, bits: int = 64) -> Column:
    """The longest integer at a text's start; an error where there is none."""
    return _number(s, r"^\s*([+-]?[0-9]+)", {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits])


def to_double(s: Column) -> Column:
    return _number(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", "double")


def _number(s: Column, pattern: str, kind: str) -> Column:
    found = F.regexp_extract(s, pattern, 1)
    return F.when(s.isNotNull() & (found == ""), F.raise_error(F.concat(F.lit("no number in: "), s)).cast(kind)).otherwise(F.when(found != "", found).cast(kind))


def to_bool(s: Column) -> Column:
    """true and 1, false and 0, in any case; NULL for all else."""
    v = F.lower(F.trim(s))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def encode(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


def decode(b: Column, charset: str = "UTF-8") -> Column:
    return F.decode(b, charset)


def default_value(text: str | None, kind: str) -> Column:
    """A default's text as a value of its column's type; quotes around a text default are taken off."""
    if text is None:
        return F.lit(None).cast(kind)
    if kind == "string" and len(text) > 1 and text[0] == text[-1] == "'":
        text = text[1:-1].replace("''", "'")
    return F.lit(text).cast(kind)


def crc32(b: Column) -> Column:
    return F.crc32(b)


NULL_GUID = "00000000-0000-0000-0000-000000000000"


def new_guid() -> str:
    return str(uuid.uuid4())


def parse_guid(s: Column) -> Column:
    """A GUID in lower case without braces; the null GUID where the text isn't one."""
    found = F.lower(F.regexp_extract(s, r"(?i)^\s*\{?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\}?\s*$", 1))
    return F.when(s.isNull(), F.lit(None)).when(found == "", NULL_GUID).otherwise(found)


def format_guid(s: Column, braces: bool = True) -> Column:
    return F.concat(F.lit("{"), F.lower(s), F.lit("}")) if braces else F.lower(s)


def variant_text(value: Column, kind: str) -> Column:
    """A value as text; blobs and shapes are empty."""
    return F.lit("") if kind in ("binary", "geometry") else F.coalesce(value.cast("string"), F.lit(""))


#: How values of different kinds are ordered: by kind, then by value. Fixed order of kinds.
VARIANT_KINDS = ["null", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "guid", "string", "geometry", "binary"]


def variant_order(kind: Column, *values: Column) -> Column:
    """A sort key over columns of which one holds the value: the kind's rank, then the values."""
    rank = F.array_position(F.array(*map(F.lit, VARIANT_KINDS)), kind)
    return F.struct(rank.alias("rank"), *[v.alias(f"v{i}") for i, v in enumerate(values)])


def encrypt(b: Column, key: str, mode: str = "GCM") -> Column:
    return F.aes_encrypt(b, F.lit(key), F.lit(mode))


def decrypt(b: Column, key: str, mode: str = "GCM") -> Column:
    return F.aes_decrypt(b, F.lit(key), F.lit(mode))


# Paths; either slash separates.


def file_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def bare_name(p: Column) -> Column:
    return F.regexp_replace(file_name(p), r"\.[^.]*$", "")


def extension(p: Column) -> Column:
    return F.regexp_extract(file_name(p), r"\.([^.]*)$", 1)


def directory(p: Column) -> Column:
    return F.regexp_replace(p, r"[/\\]?[^/\\]*$", "")


def merge_path(a: Column, b: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(a, r"[/\\]+$", ""), F.regexp_replace(b, r"^[/\\]+", ""))
