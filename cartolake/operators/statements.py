"""Statements that change stored tables, as text: INSERT, UPDATE, DELETE, CREATE TABLE, DROP TABLE. Each is a transaction of its own."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import condition
from ..plans.model import DataType, Field

if TYPE_CHECKING:
    from .workspace import Workspace

_NAME = r"[`\"\[]?(\w+)[`\"\]]?"
_FORMS = [
    ("insert", re.compile(rf"insert\s+into\s+{_NAME}\s*(?:\(([^()]*)\)\s*)?((?:(?:values|select|with)\b|\().*)", re.I | re.S)),
    ("update", re.compile(rf"update\s+{_NAME}\s+set\s+(.*)", re.I | re.S)),
    ("delete", re.compile(rf"delete\s+from\s+{_NAME}(?:\s+where\s+(.*))?", re.I | re.S)),
    ("create", re.compile(rf"create\s+table\s+{_NAME}\s*\((.*)\)", re.I | re.S)),
    ("drop", re.compile(rf"drop\s+table\s+{_NAME}", re.I | re.S)),
]
#: Kinds of columns by the words that a declared type may contain; the first that fits.
_KINDS = [("int8", DataType.INT8), ("tinyint", DataType.INT8), ("smallint", DataType.INT16), ("bigint", DataType.INT64), ("int", DataType.INT64), ("char", DataType.STRING), ("text", DataType.STRING), ("string", DataType.STRING), ("clob", DataType.STRING), ("blob", DataType.BLOB), ("real", DataType.DOUBLE), ("double", DataType.DOUBLE), ("float", DataType.FLOAT), ("date", DataType.DATE)]


def split_top(text: str, sign: str = ",") -> list[str]:
    """A text's pieces between signs that stand outside quotes and brackets."""
    pieces, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == sign and not depth:
            pieces.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*pieces, text[start:]]]


def _where_at(text: str) -> int | None:
    """Where a WHERE stands outside quotes and brackets."""
    masked = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", lambda m: "x" * len(m[0]), text)
    for m in re.finditer(r"\bwhere\b", masked, re.I):
        if masked.count("(", 0, m.start()) == masked.count(")", 0, m.start()):
            return m.start()
    return None


def _field(text: str) -> Field:
    name, kind, rest = re.match(rf"{_NAME}\s*(\w*)(.*)", text, re.S).groups()
    default = re.search(r"\bdefault\s+('(?:[^']|'')*'|\S+)", rest, re.I)
    found = next((d for word, d in _KINDS if word in kind.lower()), DataType.STRING)
    key = bool(re.search(r"\bprimary\s+key\b", rest, re.I))
    return Field(name, found, primary_key=key, nullable=not (key or re.search(r"\bnot\s+null\b", rest, re.I)), default=default and default[1])


def run(w: Workspace, sql: str) -> DataFrame | int:
    text = sql.strip().rstrip(";").strip()
    for form, pattern in _FORMS:
        m = pattern.fullmatch(text)
        if m and (form == "create" or m[1] in w._parts):
            return globals()[f"_{form}"](w, *m.groups())
    return w.select(sql)


def _insert(w: Workspace, name: str, columns: str | None, source: str) -> int:
    rows = w.select(source)
    names = [c.strip().strip('`"[]') for c in columns.split(",")] if columns else [f.name for f in w.tables[name].meta.fields][: len(rows.columns)]
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(names)} columns")
    with w.transaction() as t:
        return t.insert(name, rows.toDF(*names))


def _update(w: Workspace, name: str, rest: str) -> int:
    at = _where_at(rest)
    changes, where = (rest, None) if at is None else (rest[:at], rest[at + len("where") :])
    pairs = [p.partition("=") for p in split_top(changes)]
    table = w.tables[name]
    rows = table.df if where is None else table.df.where(F.expr(condition(where)))
    new = rows.select(table.meta.oid, *[F.expr(value).alias(column.strip().strip('`"[]')) for column, _, value in pairs])
    n = new.count()
    with w.transaction() as t:
        t.update(name, new)
    return n


def _delete(w: Workspace, name: str, where: str | None) -> int:
    table = w.tables[name]
    rows = (table.df if where is None else table.df.where(F.expr(condition(where)))).select(table.meta.oid)
    n = rows.count()
    with w.transaction() as t:
        t.delete(name, rows)
    return n


def _create(w: Workspace, name: str, columns: str) -> int:
    w.create_table(name, [_field(c) for c in split_top(columns)])
    return 0


def _drop(w: Workspace, name: str) -> int:
    w.remove(name)
    return 0
