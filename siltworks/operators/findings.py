"""One relation of findings from many tools: scope, summaries, focus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.paths import plain, segments

#: The rank of each severity word, and directories outside the scope of findings.
SEVERITY_RANKS = {"critical": 5, "error": 4, "high": 4, "warning": 3, "medium": 3, "low": 2, "info": 1, "note": 1}
OUT_OF_SCOPE = (
    ".cache", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".venv", ".yarn", "__pycache__", "bower_components", "build", "coverage", "dist", "jspm_packages",
    "node_modules", "target", "vendor", "venv",
)


def severity_word(severity: Column) -> Column:
    """Lower case without blanks; null and empty are unknown."""
    word = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return F.when(word == "", "unknown").otherwise(word)


def severity_rank(severity: Column) -> Column:
    word = severity_word(severity)
    rank = F.lit(0)
    for name, r in SEVERITY_RANKS.items():
        rank = F.when(word == name, r).otherwise(rank)
    return rank


def in_scope(findings: DataFrame) -> DataFrame:
    """Findings with `path` in plain form, without those under a directory that is out of scope (case matters)."""
    rows = findings.withColumn("path", plain(F.col("file")))
    return rows.where(~F.arrays_overlap(segments(F.col("path")), F.array(*[F.lit(d) for d in OUT_OF_SCOPE])))


def summarize(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: findings in all and by severity word, files and rules touched, highest rank."""
    word = severity_word(F.col("severity"))
    return findings.groupBy(*keys).agg(
        F.count("*").alias("findings"),
        *[F.count_if(word == s).alias(s) for s in ("critical", "error", "high", "warning", "medium", "low", "info", "note")],
        F.count_if(severity_rank(F.col("severity")) == 0).alias("unranked"),
        F.count_distinct("path").alias("files"), F.count_distinct("rule_id").alias("rules"), F.max(severity_rank(F.col("severity"))).alias("worst"),
    )


def top_values(findings: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Per key the k most frequent values, by count descending and value ascending; null values are left out.

    Values are counted before they are ranked, so the window holds one row per distinct value.
    """
    counted = findings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value)))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether a text holds one of the needles, in any case; a null text holds none, no needles match all."""
    if not needles:
        return F.lit(True)
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n.lower())
    return out


def focus(findings: DataFrame, rules: Sequence[str] = (), messages: Sequence[str] = (), severities: Sequence[str] = (), endings: Sequence[str] = ()) -> DataFrame:
    """Findings that pass every clause given: rule or message holds a needle, severity listed, file ending listed.

    A clause without entries passes all; a file without an ending passes the last clause.
    """
    out = findings.where(contains_any(F.col("rule_id"), rules) & contains_any(F.col("message"), messages))
    if severities:
        out = out.where(severity_word(F.col("severity")).isin(*[s.lower() for s in severities]))
    if endings:
        ending = F.regexp_extract(F.lower(F.coalesce("path", F.lit(""))), r"[^/.](\.[^./]+)$", 1)
        out = out.where((ending == "") | ending.isin(*endings))
    return out
