"""Queries on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.operators import findings as O
from siltworks.session import table

FOCUS = {"rules": ["token", "retry", "vector"], "messages": ["near", "before"], "severities": ["critical", "high", "error"], "endings": [".py", ".go", ".ts", ".js"]}


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.in_scope(table(spark, sf_dir, "findings").select("finding_id", "repo", "tool", "evidence_class", "severity", "rule_id", "file", "line", "message"))


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.summarize(_scoped(spark, sf_dir), ["repo", "tool"])


def finding_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_values(_scoped(spark, sf_dir), ["repo", "tool"], "rule_id", 5)


def finding_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_values(_scoped(spark, sf_dir).where("path <> ''"), ["repo"], "path", 10)


def finding_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 worst findings of each tool over all repositories."""
    rank = O.severity_rank(F.col("severity")).alias("severity_rank")
    rows = _scoped(spark, sf_dir).select("tool", rank, "path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("rule_id", F.lit("")).alias("rule_id"), "finding_id")
    order = Window.partitionBy("tool").orderBy(F.desc("severity_rank"), "path", "line", "rule_id", "finding_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 25")


def sast_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.focus(_scoped(spark, sf_dir), FOCUS["rules"], FOCUS["messages"], FOCUS["severities"], FOCUS["endings"])
    return rows.groupBy("tool", F.upper(O.severity_word(F.col("severity"))).alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class and severity word with subtotals, in one pass."""
    rows = _scoped(spark, sf_dir).select("evidence_class", O.severity_word(F.col("severity")).alias("severity"))
    return rows.rollup("evidence_class", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


_WORD = "CASE WHEN lower(trim(coalesce(severity, ''))) = '' THEN 'unknown' ELSE lower(trim(severity)) END"
_RANK = f"CASE {_WORD} WHEN 'critical' THEN 5 WHEN 'error' THEN 4 WHEN 'high' THEN 4 WHEN 'warning' THEN 3 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 WHEN 'note' THEN 1 ELSE 0 END"
_SCOPED = f"""WITH f0 AS (SELECT *, coalesce(ltrim(replace(file, '\\', '/'), './'), '') AS path, {_WORD} AS word, {_RANK} AS rk FROM findings),
f AS (SELECT * FROM f0 WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(f"'{d}'" for d in O.OUT_OF_SCOPE)}]))
"""


def queries() -> dict:
    return {q.__name__: q for q in (finding_summary, finding_top_rules, finding_top_files, finding_sample, sast_focus, severity_totals)}


def oracle_sql() -> dict:
    words = ", ".join(f"count(*) FILTER (word = '{s}') AS \"{s}\"" for s in ("critical", "error", "high", "warning", "medium", "low", "info", "note"))
    top = lambda keys, v, k, w="": f"{_SCOPED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {v}) AS rank FROM (SELECT {keys}, {v}, count(*) AS n FROM f WHERE {v} IS NOT NULL {w} GROUP BY ALL)) WHERE rank <= {k}"
    like = lambda c, ws: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in ws) + ")"
    ending = r"regexp_extract(lower(path), '[^/.](\.[^./]+)$', 1)"
    return {
        "finding_summary": f"{_SCOPED} SELECT repo, tool, count(*) AS findings, {words}, count(*) FILTER (rk = 0) AS unranked, count(DISTINCT path) AS files, count(DISTINCT rule_id) AS rules, max(rk) AS worst FROM f GROUP BY repo, tool",
        "finding_top_rules": top("repo, tool", "rule_id", 5),
        "finding_top_files": top("repo", "path", 10, "AND path <> ''"),
        "finding_sample": f"""{_SCOPED} SELECT * FROM (SELECT tool, rk AS severity_rank, path, coalesce(line, 0) AS line, coalesce(rule_id, '') AS rule_id, finding_id,
            row_number() OVER (PARTITION BY tool ORDER BY rk DESC, path, coalesce(line, 0), coalesce(rule_id, ''), finding_id) AS n FROM f) WHERE n <= 25""",
        "sast_focus": f"""{_SCOPED} SELECT tool, upper(word) AS severity, count(*) AS n, count(DISTINCT path) AS files FROM f WHERE {like('rule_id', FOCUS['rules'])} AND {like('message', FOCUS['messages'])}
            AND word IN ({', '.join(f"'{s}'" for s in FOCUS['severities'])}) AND ({ending} = '' OR {ending} IN ({', '.join(f"'{s}'" for s in FOCUS['endings'])})) GROUP BY 1, 2""",
        "severity_totals": f"{_SCOPED} SELECT evidence_class, word AS severity, count(*) AS n, grouping_id(evidence_class, word) AS level FROM f GROUP BY ROLLUP (evidence_class, word)",
    }
