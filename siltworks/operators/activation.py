"""Which groups of a rubric apply to which repository, with defaults on three levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_plan(groups: DataFrame, modules: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Rubric groups (module_id, group_id) for every activated module (keys, module_id, enabled, confidence).

    A group's own override (keys, module_id, group_id, enabled, confidence) comes first, then its module's state,
    then enabled at 0.5. The rubric is joined by module, so rows are those of the plan and no more.
    """
    m = modules.select(*keys, "module_id", F.col("enabled").alias("module_enabled"), F.col("confidence").alias("module_confidence"))
    o = overrides.select(*keys, "module_id", "group_id", F.col("enabled").alias("own_enabled"), F.col("confidence").alias("own_confidence"))
    return m.join(groups, "module_id").join(o, [*keys, "module_id", "group_id"], "left").select(
        *keys, "module_id", "group_id", F.coalesce("own_enabled", "module_enabled", F.lit(True)).alias("enabled"),
        F.coalesce("own_confidence", "module_confidence", F.lit(0.5)).alias("confidence"), F.col("own_enabled").isNotNull().alias("overridden"),
    )
