"""Queries on rubric roll-ups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import rollup as R
from siltworks.session import table

POLICIES = {"exclude": R.Policy(), "neutral": R.Policy(missing="penalize_neutral", empty="neutral"), "low": R.Policy(missing="penalize_low", evidence_penalty=0.5)}
_RUN = ["result_id", "repo", "module_id", "group_id"]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To six places; the tiny addend keeps ties of equal sums in other orders on one side."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in columns})


def leaf_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_leaves(table(spark, sf_dir, "leaf_definitions")).select("leaf_key", "repo", "leaf_id", "weight")


def leaf_weight_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = R.latest_leaves(table(spark, sf_dir, "leaf_definitions"))
    return _rounded(R.normalized_weights(leaves, ["repo", "module_id", "group_id"]).select("leaf_key", "w"), "w")


def _groups(spark: SparkSession, sf_dir: str, policy: R.Policy) -> DataFrame:
    return _group_scores(spark, sf_dir, table(spark, sf_dir, "group_results"), policy)


def _group_scores(spark: SparkSession, sf_dir: str, runs: DataFrame, policy: R.Policy) -> DataFrame:
    return R.group_scores(R.scored_leaves(runs, table(spark, sf_dir, "leaf_definitions")), _RUN, policy)


def rollup_group(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    g = _groups(spark, sf_dir, POLICIES[policy])
    return _rounded(g, "score", "confidence", "coverage", "sufficiency")


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module scores per repository, from the latest result of each group; a group weighs as many leaves as it has."""
    runs = table(spark, sf_dir, "group_results")
    latest = runs.groupBy("repo", "module_id", "group_id").agg(F.max_by("result_id", F.struct("finished_at", "result_id")).alias("result_id"))
    groups = _group_scores(spark, sf_dir, runs.join(latest.select("result_id"), "result_id", "left_semi"), POLICIES["exclude"])
    return R.module_scores(groups.withColumn("weight", F.col("leaves").cast("double")), ["repo", "module_id"], "weight")


def rollup_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_modules(spark, sf_dir), "score", "confidence", "coverage", "sufficiency")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories without continuous integration have module J gated, those without authentication module H."""
    s = table(spark, sf_dir, "repo_signals")
    off = lambda c, m: s.where(~F.coalesce(F.col(c), F.lit(False))).select("repo", F.lit(m).alias("module_id"))
    return off("has_ci", "J").unionByName(off("has_auth", "H"))


def rollup_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = R.gate_modules(_modules(spark, sf_dir), _gates(spark, sf_dir), ["repo", "module_id"])
    return _rounded(gated.select("repo", "module_id", "gated", "score", "confidence", "groups"), "score", "confidence")


def rollup_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.final_scores(_modules(spark, sf_dir), ["repo"])
    return _rounded(f, "score", "confidence", "module_coverage")


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, module_id, group_id, leaf_id ORDER BY updated_at DESC NULLS LAST, leaf_key DESC) AS n FROM leaf_definitions) WHERE n = 1"
_WEIGHT = "greatest(0.0, CASE WHEN weight IS NULL OR isnan(weight) THEN 0.0 ELSE weight END)"
_LEAVES = f"""
ld AS ({_LATEST}), rs AS (
  SELECT result_id, r.leaf_id AS leaf_id, arg_max(struct_pack(status := r.status, score := r.score, confidence := r.confidence, review := r.needs_human_review), pos) AS v
  FROM (SELECT result_id, leaf_results[i] AS r, i AS pos FROM (SELECT result_id, leaf_results, unnest(range(1, len(leaf_results) + 1)) AS i FROM group_results)) WHERE r IS NOT NULL GROUP BY 1, 2
), d AS (
  SELECT g.result_id, g.repo, g.module_id, g.group_id, coalesce(g.enabled, true) AS enabled, b.leaf_id, CASE WHEN f.leaf_key IS NOT NULL THEN f.weight ELSE b.weight END AS weight
  FROM group_results g JOIN ld b ON b.repo IS NULL AND b.module_id = g.module_id AND b.group_id = g.group_id
  LEFT JOIN ld f ON f.repo = g.repo AND f.module_id = g.module_id AND f.group_id = g.group_id AND f.leaf_id = b.leaf_id
), l0 AS (
  SELECT d.*, rs.v IS NULL AS gone, rs.v.status AS st, rs.v.score AS sc, rs.v.confidence AS cf, rs.v.review AS rv, {_WEIGHT} AS raw FROM d LEFT JOIN rs ON rs.result_id = d.result_id AND rs.leaf_id IS NOT DISTINCT FROM d.leaf_id
), l AS (
  SELECT result_id, repo, module_id, group_id, enabled, CASE WHEN gone THEN 'insufficient_evidence' ELSE st END AS status, sc AS score, CASE WHEN gone THEN 0.0 ELSE cf END AS confidence,
    CASE WHEN gone THEN true ELSE coalesce(rv, false) END AS review,
    CASE WHEN sum(raw) OVER (PARTITION BY result_id) > 0 THEN raw / sum(raw) OVER (PARTITION BY result_id) ELSE 1.0 / count(*) OVER (PARTITION BY result_id) END AS w FROM l0
)"""


def _group_sql(policy: R.Policy) -> str:
    gap = {"exclude": "NULL", "penalize_neutral": str(policy.neutral), "penalize_low": str(policy.low)}[policy.missing]
    gap_conf = "NULL" if policy.missing == "exclude" else str(policy.stand_in_confidence)
    score = "raw_score" if policy.empty == "none" else f"coalesce(raw_score, {policy.neutral})"
    conf = "coalesce(raw_conf, 0.0)" if policy.empty == "none" else "CASE WHEN raw_score IS NULL THEN least(coalesce(raw_conf, 0.0), 0.2) ELSE coalesce(raw_conf, 0.0) END"
    if policy.evidence_penalty:
        score = f"CASE WHEN raw_score IS NOT NULL THEN greatest(0.0, least(5.0, raw_score - (1.0 - scored / leaves) * {policy.evidence_penalty})) END"
    return f"""{_LEAVES}, t AS (
  SELECT *, CASE WHEN status = 'scored' AND score IS NOT NULL THEN greatest(0.0, least(5.0, score)) WHEN status IN ('insufficient_evidence', 'tool_failed') THEN {gap} END AS v,
    CASE WHEN status = 'scored' AND score IS NOT NULL THEN greatest(0.0, least(1.0, coalesce(confidence, 0.5))) WHEN status IN ('insufficient_evidence', 'tool_failed') THEN {gap_conf} END AS c FROM l
), g0 AS (
  SELECT result_id, repo, module_id, group_id, any_value(enabled) AS enabled,
    CASE WHEN sum(w) FILTER (v IS NOT NULL AND w > 0) > 1e-9 THEN sum(v * w) FILTER (w > 0) / sum(w) FILTER (v IS NOT NULL AND w > 0) END AS raw_score,
    CASE WHEN sum(w) FILTER (c IS NOT NULL AND w > 0) > 1e-9 THEN sum(c * w) FILTER (w > 0) / sum(w) FILTER (c IS NOT NULL AND w > 0) END AS raw_conf,
    count(*) AS leaves, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'na') AS na, count(*) FILTER (status = 'insufficient_evidence') AS insufficient,
    count(*) FILTER (status = 'tool_failed') AS failed, count(*) FILTER (review) AS reviews
  FROM t GROUP BY 1, 2, 3, 4
), g AS (
  SELECT result_id, repo, module_id, group_id, enabled, CASE WHEN enabled THEN {score} END AS score,
    CASE WHEN enabled THEN greatest(0.05, least(1.0, ({conf}) * CASE WHEN leaves > na THEN 0.5 + 0.5 * (scored / (leaves - na)) ELSE 0.3 END * greatest(0.0, 1.0 - 0.15 * reviews / leaves))) ELSE 0.0 END AS confidence,
    CASE WHEN leaves > na THEN scored / (leaves - na) ELSE 0.0 END AS coverage, scored / leaves AS sufficiency, leaves, scored, na, insufficient, failed, reviews FROM g0
)"""


_MODULE_SQL = f"""WITH {_group_sql(POLICIES['exclude'])}, latest AS (
  SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY repo, module_id, group_id ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS n FROM group_results) WHERE n = 1
), m0 AS (
  SELECT repo, module_id, CASE WHEN sum(leaves) FILTER (score IS NOT NULL) > 1e-9 THEN sum(score * leaves) / sum(leaves) FILTER (score IS NOT NULL) END AS score,
    coalesce(CASE WHEN sum(leaves) FILTER (score IS NOT NULL) > 1e-9 THEN sum(confidence * leaves) FILTER (score IS NOT NULL) / sum(leaves) FILTER (score IS NOT NULL) END, 0.0) AS raw,
    coalesce(sum(coverage * leaves) / sum(leaves), 0.0) AS coverage, coalesce(sum(sufficiency * leaves) / sum(leaves), 0.0) AS sufficiency,
    count(*) AS groups, sum(scored)::BIGINT AS scored_leaves, sum(leaves)::DOUBLE AS module_weight
  FROM g WHERE enabled AND result_id IN (SELECT result_id FROM latest) GROUP BY 1, 2
), m AS (SELECT repo, module_id, score, greatest(0.05, least(1.0, raw * (0.5 + 0.5 * coverage))) AS confidence, coverage, sufficiency, groups, scored_leaves, module_weight FROM m0)
"""


def queries() -> dict:
    return {
        "leaf_current": leaf_current, "leaf_weight_norm": leaf_weight_norm, **{f"rollup_group_{p}": partial(rollup_group, policy=p) for p in POLICIES},
        "rollup_module": rollup_module, "rollup_gated": rollup_gated, "rollup_final": rollup_final,
    }


def oracle_sql() -> dict:
    r = lambda c: f"round({c} + 1e-10, 6) AS {c}"
    group = lambda p: f"WITH {_group_sql(POLICIES[p])} SELECT result_id, repo, module_id, group_id, enabled, {r('score')}, {r('confidence')}, {r('coverage')}, {r('sufficiency')}, leaves, scored, na, insufficient, failed, reviews FROM g"
    gates = "SELECT repo, 'J' AS module_id FROM repo_signals WHERE NOT coalesce(has_ci, false) UNION SELECT repo, 'H' FROM repo_signals WHERE NOT coalesce(has_auth, false)"
    return {
        "leaf_current": f"SELECT leaf_key, repo, leaf_id, weight FROM ({_LATEST})",
        "leaf_weight_norm": f"""WITH ld AS ({_LATEST}), r AS (SELECT *, {_WEIGHT} AS raw FROM ld)
            SELECT leaf_key, round(CASE WHEN sum(raw) OVER g > 0 THEN raw / sum(raw) OVER g ELSE 1.0 / count(*) OVER g END + 1e-10, 6) AS w FROM r WINDOW g AS (PARTITION BY repo, module_id, group_id)""",
        **{f"rollup_group_{p}": group(p) for p in POLICIES},
        "rollup_module": _MODULE_SQL + f"SELECT repo, module_id, {r('score')}, {r('confidence')}, {r('coverage')}, {r('sufficiency')}, groups, scored_leaves, module_weight FROM m",
        "rollup_gated": _MODULE_SQL + f""", ga AS ({gates}) SELECT m.repo, m.module_id, ga.repo IS NOT NULL AS gated, round(CASE WHEN ga.repo IS NULL THEN score END + 1e-10, 6) AS score,
            round(CASE WHEN ga.repo IS NULL THEN confidence ELSE 0.0 END + 1e-10, 6) AS confidence, groups FROM m LEFT JOIN ga ON ga.repo = m.repo AND ga.module_id = m.module_id""",
        "rollup_final": _MODULE_SQL + """SELECT repo, round(score + 1e-10, 6) AS score, modules, scored_modules, groups, scored_leaves, round(cov + 1e-10, 6) AS module_coverage,
            round(CASE WHEN score IS NOT NULL THEN greatest(0.05, least(1.0, raw)) ELSE 0.0 END + 1e-10, 6) AS confidence FROM (
            SELECT repo, CASE WHEN sum(module_weight) FILTER (score IS NOT NULL) > 1e-9 THEN sum(score * module_weight) / sum(module_weight) FILTER (score IS NOT NULL) END AS score,
              coalesce(sum(confidence * module_weight) FILTER (score IS NOT NULL) / sum(module_weight) FILTER (score IS NOT NULL), 0.0) AS raw, count(*) AS modules, count(score) AS scored_modules,
              sum(groups)::BIGINT AS groups, sum(scored_leaves)::BIGINT AS scored_leaves, coalesce(sum(module_weight) FILTER (score IS NOT NULL), 0.0) / sum(module_weight) AS cov FROM m GROUP BY repo)""",
    }
