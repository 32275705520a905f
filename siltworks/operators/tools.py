"""Tool runs: status by exit code, the run that counts, cached results, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_status(exit_code: Column, artifacts: Column, declared: Column, findings_by_exit: Column, result_by_exit: Column) -> Column:
    """STRUCT<status, reason> of a finished run.

    A null exit code is invalid; 127 and 126 mean that the tool wasn't there or can't run; below 0 it was ended by
    a signal. Any other code but 0 is a success for tools whose code is their result, and, for tools whose code
    says that there are findings, if they left an artifact or declared none.
    """
    left = F.coalesce(F.size(F.filter(F.map_values(artifacts), lambda v: F.coalesce(v, F.lit("")) != "")) > 0, F.lit(False))
    none_due = F.coalesce(F.size(F.filter(declared, lambda v: F.coalesce(v, F.lit("")) != "")) <= 0, F.lit(True))
    by = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))
    ok, failed = by("completed", F.lit(None)), lambda reason: by("tool_failed", reason)
    return (
        F.when(exit_code.isNull(), failed(F.lit("invalid_exit_code")))
        .when(exit_code == 0, ok)
        .when(exit_code == 127, failed(F.lit("tool_not_found_or_not_executable")))
        .when(exit_code == 126, failed(F.lit("tool_not_executable")))
        .when(exit_code < 0, failed(F.concat(F.lit("terminated_by_signal:"), -exit_code)))
        .when(result_by_exit, ok)
        .when(findings_by_exit & (left | none_due), ok)
        .when(findings_by_exit, failed(F.lit("nonzero_exit_and_no_artifacts")))
        .otherwise(failed(F.concat(F.lit("nonzero_exit_code:"), exit_code)))
    )


def counting_run(runs: DataFrame, keys: Sequence[str], completed: Column, order: Sequence[Column]) -> DataFrame:
    """Per key the run that counts: the first completed one in ascending order (nulls first), or the last if none completed.

    One aggregation, combined on the map side, however many runs a key has.
    """
    row, at = F.struct(*runs.columns), F.struct(*order)
    first_ok = F.min_by(row, F.when(F.coalesce(completed, F.lit(False)), at))
    return runs.groupBy(*keys).agg(first_ok.alias("__ok"), F.max_by(row, at).alias("__last")).select(F.coalesce("__ok", "__last").alias("r")).select("r.*")


def split_by_cache(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, and those still to run."""
    keys = cache.select(key).where(F.col(key).isNotNull()).distinct()
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")


def missing_artifacts(runs: DataFrame) -> DataFrame:
    """Declared outputs that a run's artifacts lack: run_id, output. Null or empty names are left out."""
    due = runs.select("run_id", "artifacts", F.explode("declared_outputs").alias("output")).where(F.coalesce("output", F.lit("")) != "")
    return due.where(~F.coalesce(F.map_contains_key("artifacts", F.col("output")), F.lit(False))).select("run_id", "output")


def ledger(runs: DataFrame, stage: str) -> DataFrame:
    """Runs, cached runs and seconds per stage, and in all (null stage, level 1)."""
    return runs.rollup(stage).agg(
        F.count("*").alias("runs"), F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cached"), F.sum(F.coalesce("duration_sec", F.lit(0.0))).alias("seconds"), F.grouping_id().alias("level")
    )
