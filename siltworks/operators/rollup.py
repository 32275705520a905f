"""Weighted roll-up of leaf scores to groups, modules and a final score, with gaps and confidence made explicit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How gaps count. `missing` is exclude, penalize_neutral or penalize_low; `empty` is none or neutral."""

    missing: str = "exclude"
    empty: str = "none"
    least: float = 0.0
    most: float = 5.0
    neutral: float = 2.5
    low: float = 1.5
    stand_in_confidence: float = 0.25
    default_confidence: float = 0.5
    review_factor: float = 0.15
    floor: float = 0.05
    coverage_penalty: bool = True
    evidence_penalty: float = 0.0
    epsilon: float = 1e-9


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null, which least() and greatest() alone would turn into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def weighted_mean(value: Column, weight: Column, epsilon: float = 1e-9) -> Column:
    """Aggregate: the mean over rows with a value and a positive weight; null if those weigh nothing."""
    w = F.when(value.isNotNull() & (weight > 0), weight)
    return F.when(F.sum(w) > epsilon, F.sum(value * w) / F.sum(w))


def latest_leaves(definitions: DataFrame, keys: Sequence[str] = ("repo", "module_id", "group_id", "leaf_id")) -> DataFrame:
    """One definition per leaf: the latest by updated_at, of equals the one with the greatest leaf_key."""
    last = Window.partitionBy(*keys).orderBy(F.col("updated_at").desc_nulls_last(), F.col("leaf_key").desc())
    return definitions.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def normalized_weights(leaves: DataFrame, group: Sequence[str], weight: str = "weight") -> DataFrame:
    """Adds `w`: the weights of a group's leaves made to sum to 1.

    Null and NaN count 0 unless the whole group has none, negative counts 0; a group without weight gets equal ones.
    """
    over = Window.partitionBy(*group)
    raw = F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(weight), F.lit(None).cast("double")), F.lit(0.0)))
    total = F.sum(raw).over(over)
    return leaves.withColumn("w", F.when(total > 0, raw / total).otherwise(F.lit(1.0) / F.count("*").over(over)))


def last_leaf_scores(results: DataFrame) -> DataFrame:
    """The leaf results of each result row, one per leaf: the last in the array wins. Null elements are passed over."""
    each = results.select("result_id", F.posexplode("leaf_results").alias("pos", "r")).where(F.col("r").isNotNull())
    return each.groupBy("result_id", F.col("r.leaf_id").alias("leaf_id")).agg(
        *[F.max_by(F.col(f"r.{c}"), "pos").alias(c) for c in ("status", "score", "confidence", "needs_human_review")]
    )


def scored_leaves(results: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every defined leaf of every result with its weight and score.

    The base rubric (no repo) defines the leaves; a repository's fork replaces the weights of those it holds. A
    leaf without a result counts as insufficient evidence that a person must look at.
    """
    base = latest_leaves(definitions.where("repo IS NULL")).select("module_id", "group_id", "leaf_id", F.col("weight").alias("base_weight"))
    fork = latest_leaves(definitions.where("repo IS NOT NULL")).select("repo", "module_id", "group_id", "leaf_id", F.col("weight").alias("fork_weight"), F.lit(True).alias("forked"))
    leaves = results.select("result_id", "repo", "module_id", "group_id", "enabled").join(base, ["module_id", "group_id"]).join(fork, ["repo", "module_id", "group_id", "leaf_id"], "left")
    leaves = leaves.withColumn("weight", F.when(F.col("forked"), F.col("fork_weight")).otherwise(F.col("base_weight")))
    got = leaves.join(last_leaf_scores(results).withColumn("__got", F.lit(True)), ["result_id", "leaf_id"], "left")
    missing = F.col("__got").isNull()
    return normalized_weights(
        got.select(
            "result_id", "repo", "module_id", "group_id", "enabled", "leaf_id", "weight",
            F.when(missing, "insufficient_evidence").otherwise(F.col("status")).alias("status"), "score",
            F.when(missing, 0.0).otherwise(F.col("confidence")).alias("confidence"),
            F.when(missing, True).otherwise(F.coalesce("needs_human_review", F.lit(False))).alias("review"),
        ),
        ["result_id"],
    )


def group_scores(leaves: DataFrame, keys: Sequence[str], policy: Policy = Policy()) -> DataFrame:
    """Leaves (status, score, confidence, review, w, enabled) to one row per group."""
    p = policy
    scored = (F.col("status") == "scored") & F.col("score").isNotNull()
    gap = F.col("status").isin("insufficient_evidence", "tool_failed")
    stand_in = {"exclude": None, "penalize_neutral": p.neutral, "penalize_low": p.low}[p.missing]
    value = F.when(scored, clamp(F.col("score"), p.least, p.most))
    confidence = F.when(scored, clamp(F.coalesce("confidence", F.lit(p.default_confidence)), 0.0, 1.0))
    if stand_in is not None:
        value, confidence = value.when(gap, F.lit(stand_in)), confidence.when(gap, F.lit(p.stand_in_confidence))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = leaves.groupBy(*keys).agg(
        F.first("enabled").alias("enabled"),
        weighted_mean(value, F.col("w"), p.epsilon).alias("raw_score"),
        weighted_mean(confidence, F.col("w"), p.epsilon).alias("raw_confidence"),
        F.count("*").alias("leaves"), n(F.col("status") == "scored").alias("scored"), n(F.col("status") == "na").alias("na"),
        n(F.col("status") == "insufficient_evidence").alias("insufficient"), n(F.col("status") == "tool_failed").alias("failed"), n(F.col("review")).alias("reviews"),
    )
    applicable = F.col("leaves") - F.col("na")
    coverage = F.when(applicable > 0, F.col("scored") / applicable).otherwise(0.0)
    sufficiency = F.col("scored") / F.col("leaves")
    score, conf = F.col("raw_score"), F.coalesce("raw_confidence", F.lit(0.0))
    if p.empty == "neutral":
        conf = F.when(score.isNull(), F.least(conf, F.lit(0.2))).otherwise(conf)
        score = F.coalesce(score, F.lit(p.neutral))
    if p.coverage_penalty:
        conf = conf * F.when(applicable > 0, 0.5 + 0.5 * coverage).otherwise(0.3)
    conf = conf * F.greatest(F.lit(0.0), 1.0 - p.review_factor * F.col("reviews") / F.col("leaves"))
    if p.evidence_penalty:
        score = clamp(score - (1.0 - sufficiency) * p.evidence_penalty, p.least, p.most)
    on = F.coalesce("enabled", F.lit(True))
    return g.select(
        *keys, on.alias("enabled"), F.when(on, score).alias("score"), F.when(on, clamp(conf, p.floor, 1.0)).otherwise(0.0).alias("confidence"),
        coverage.alias("coverage"), sufficiency.alias("sufficiency"), "leaves", "scored", "na", "insufficient", "failed", "reviews",
    )


def module_scores(groups: DataFrame, keys: Sequence[str], weight: str, policy: Policy = Policy()) -> DataFrame:
    """Groups to one row per module: means over the scored groups, coverage and sufficiency over all enabled ones."""
    on = groups.where("enabled")
    w = F.greatest(F.lit(0.0), F.col(weight))
    m = on.groupBy(*keys).agg(
        weighted_mean(F.col("score"), w).alias("score"), F.coalesce(weighted_mean(F.when(F.col("score").isNotNull(), F.col("confidence")), w), F.lit(0.0)).alias("raw"),
        F.coalesce(weighted_mean(F.col("coverage"), w), F.lit(0.0)).alias("coverage"), F.coalesce(weighted_mean(F.col("sufficiency"), w), F.lit(0.0)).alias("sufficiency"),
        F.count("*").alias("groups"), F.sum("scored").alias("scored_leaves"), F.sum(w).alias("module_weight"),
    )
    conf = F.col("raw") * (0.5 + 0.5 * F.col("coverage")) if policy.coverage_penalty else F.col("raw")
    return m.withColumn("confidence", clamp(conf, policy.floor, 1.0)).drop("raw")


def gate_modules(modules: DataFrame, gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Modules named in `gates` lose their score and confidence but keep their counts; adds `gated`."""
    marked = modules.join(gates.select(*keys).distinct().withColumn("gated", F.lit(True)), list(keys), "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    return marked.withColumn("score", F.when(~F.col("gated"), F.col("score"))).withColumn("confidence", F.when(F.col("gated"), 0.0).otherwise(F.col("confidence")))


def final_scores(modules: DataFrame, keys: Sequence[str], policy: Policy = Policy()) -> DataFrame:
    """Modules (score, confidence, module_weight) to one row per repository."""
    w, has = F.greatest(F.lit(0.0), F.col("module_weight")), F.col("score").isNotNull()
    f = modules.groupBy(*keys).agg(
        weighted_mean(F.col("score"), w).alias("score"), F.coalesce(weighted_mean(F.when(has, F.col("confidence")), w), F.lit(0.0)).alias("raw"),
        F.count("*").alias("modules"), F.count_if(has).alias("scored_modules"), F.sum("groups").alias("groups"), F.sum("scored_leaves").alias("scored_leaves"),
        F.when(F.sum(w) > policy.epsilon, F.sum(F.when(has, w).otherwise(0.0)) / F.sum(w)).otherwise(0.0).alias("module_coverage"),
    )
    return f.withColumn("confidence", F.when(F.col("score").isNotNull(), clamp(F.col("raw"), policy.floor, 1.0)).otherwise(0.0)).drop("raw")
