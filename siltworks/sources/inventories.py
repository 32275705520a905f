"""Dependencies that lock files and package listings name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import lines


def lock_entries(files: DataFrame, key: str, text: str, pattern: str = r"^  ([A-Za-z][\w./-]*)@([0-9][\w.+-]*):$") -> DataFrame:
    """(key, name, version) of every line of a lock file that names a package."""
    rows = files.where(F.col(text).contains("@")).select(key, F.explode(lines(F.col(text))).alias("l")).where(F.col("l").rlike(pattern))
    return rows.select(key, F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"))


def npm_tree(reports: DataFrame, body: str = "body") -> DataFrame:
    """(report_id, name, version, depth) of every node of nested package trees; broken reports give no rows."""

    @F.pandas_udf("array<struct<name string, version string, depth int>>")
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_nodes(t) for t in s], dtype=object)

    return reports.select("report_id", F.explode(nodes(body)).alias("n")).select("report_id", "n.*")


def _nodes(text: str | None) -> list[dict]:
    try:
        left = [(json.loads(text or ""), 0)]
    except ValueError:
        return []
    out = []
    while left:
        node, depth = left.pop()
        below = node.get("dependencies") if isinstance(node, dict) else None
        for name, child in (below or {}).items() if isinstance(below, dict) else ():
            version = child.get("version") if isinstance(child, dict) else None
            out.append({"name": name, "version": None if version is None else str(version), "depth": depth + 1})
            left.append((child, depth + 1))
    return out
