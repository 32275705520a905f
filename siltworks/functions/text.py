"""Texts as Columns: lines, line statistics, fingerprints, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text, which LF, CRLF and CR end; a last line break begins no further line, '' has none."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\n|\r"))


def looks_minified(text: Column) -> Column:
    """Whether lines mean nothing in a text: some very long line, or few and long ones. False for null and ''."""
    sizes = F.transform(lines(F.coalesce(text, F.lit(""))), F.length)
    n, most = F.size(sizes), F.coalesce(F.array_max(sizes), F.lit(0))
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    share = most / F.greatest(F.length(text), F.lit(1))
    rules = (most >= 3000) | ((most >= 1500) & (mean >= 400)) | ((n <= 5) & (mean >= 500)) | ((n <= 12) & (mean >= 350) & (share >= 0.6)) | ((share >= 0.85) & (most >= 1200))
    return F.coalesce((n > 0) & rules, F.lit(False))


def fingerprint(text: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", ""), r"\s+", " ")


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """At most `most` characters, the last of which is a mark if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def clip_middle(text: Column, most: int, mark: str = " … ") -> Column:
    """At most `most` characters: seven tenths from the front, the rest from the end."""
    room = most - len(mark)
    head = room * 7 // 10
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(room - head)))).otherwise(text)
