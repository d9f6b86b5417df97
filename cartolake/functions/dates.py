"""Dates as integers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime letters and what Spark has for them.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "%": "%"}
LONGEST = 25


def pattern(strftime: str) -> str:
    """A strftime pattern in Spark's letters; letters that it can't express are refused."""
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            if strftime[i] not in _LETTERS:
                raise ValueError(f"%{strftime[i]}")
            out += _LETTERS[strftime[i]]
        else:
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        i += 1
    return out


def date_key(ts: Column) -> Column:
    """A time as an integer of year, day, month, hour, minute and second, the day before the month."""
    return F.date_format(ts, "yyyyddMMHHmmss").cast("long")


def now_key() -> Column:
    return date_key(F.current_timestamp())


def format_epoch(seconds: Column, strftime: str) -> Column:
    """Seconds since 1970 as text in the session's zone, cut to 25 characters."""
    return F.substring(F.date_format(F.timestamp_seconds(seconds), pattern(strftime)), 1, LONGEST)


def parse_epoch(s: Column, strftime: str = "%Y%m%d%H%M%S") -> Column:
    """Text as seconds since 1970; an error where it isn't of the pattern."""
    return F.unix_timestamp(s, pattern(strftime))
