"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.streaming.findings import drain, read_stream, window_counts


def stream_daily_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per day, class and severity word, by a stream over the table's files."""
    return drain(window_counts(read_stream(spark, f"{sf_dir}/findings.parquet")))


def queries() -> dict:
    return {"stream_daily_findings": stream_daily_findings}


def oracle_sql() -> dict:
    return {
        "stream_daily_findings": """SELECT date_trunc('day', scanned_at)::TIMESTAMP AS begins, evidence_class, CASE WHEN lower(trim(coalesce(severity, ''))) = '' THEN 'unknown' ELSE lower(trim(severity)) END AS severity,
            count(*) AS findings FROM findings WHERE scanned_at IS NOT NULL GROUP BY 1, 2, 3"""
    }
