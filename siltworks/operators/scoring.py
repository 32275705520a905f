"""Scores from rules and payloads: keyword rules, payload clean-up, re-scored verdicts of a judge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ranking import with_place
from siltworks.operators.rollup import clamp

#: What each subscore and each counted fault weighs, and the verdict from each score up.
SUBSCORES = {
    "final_score_correctness_score": 15, "structural_score_correctness_score": 25, "issue_correctness_score": 15, "issue_coverage_score": 15,
    "confidence_calibration_score": 10, "interpretability_grounding_score": 10, "activation_scope_correctness_score": 10,
}
FAULTS = {
    "major_score_mismatches": 6, "minor_score_mismatches": 2, "missing_relevant_groups": 7, "irrelevant_groups_included": 3, "status_misclassification_errors": 2, "major_missed_issues": 6,
    "minor_missed_issues": 2, "false_or_overstated_issues": 4, "major_confidence_errors": 4, "minor_confidence_errors": 1, "unsupported_strong_claims": 3,
}
VERDICTS = ((90, "excellent"), (75, "good"), (55, "fair"), (30, "poor"), (0, "unusable"))
#: Fixed values: (fault, from this count on, subscore, at most).
CAPS = (
    ("missing_relevant_groups", 1, "activation_scope_correctness_score", 4), ("missing_relevant_groups", 1, "issue_coverage_score", 4),
    ("missing_relevant_groups", 2, "activation_scope_correctness_score", 2), ("missing_relevant_groups", 2, "issue_coverage_score", 2),
    ("major_score_mismatches", 1, "structural_score_correctness_score", 4), ("major_score_mismatches", 2, "structural_score_correctness_score", 2),
    ("false_or_overstated_issues", 1, "issue_correctness_score", 4), ("major_confidence_errors", 1, "confidence_calibration_score", 3),
    ("unsupported_strong_claims", 1, "interpretability_grounding_score", 4),
)


def verdict(score: Column) -> Column:
    out = F.lit(VERDICTS[-1][1])
    for least, name in reversed(VERDICTS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rescore(payloads: DataFrame) -> DataFrame:
    """Adds capped subscores (same names), base, penalty, overall and verdict to rows with a column per subscore and fault.

    Null subscores and counts are 0; subscores are held to 0..5, counts to 0 and above.
    """
    count = {f: F.greatest(F.lit(0), F.coalesce(F.col(f), F.lit(0))) for f in FAULTS}
    score: dict[str, Column] = {s: clamp(F.coalesce(F.col(s), F.lit(0)), 0, 5).cast("int") for s in SUBSCORES}
    for fault, least, s, most in CAPS:
        score[s] = F.when(count[fault] >= least, F.least(score[s], F.lit(most))).otherwise(score[s])
    base = sum((score[s] * w for s, w in SUBSCORES.items()), F.lit(0)) / 5
    penalty = sum((count[f] * w for f, w in FAULTS.items()), F.lit(0))
    out = payloads.withColumns({**score, "base": F.round(base).cast("int"), "penalty": penalty.cast("int")})
    out = out.withColumn("overall", clamp(F.col("base") - F.col("penalty"), 0, 100).cast("int"))
    return out.withColumn("verdict", verdict(F.col("overall")))


def clean_leaf_score(status: Column, score: Column, confidence: Column, review: Column) -> Column:
    """STRUCT<status, score, confidence, review> of a raw leaf score, whose parts come as text.

    Unknown statuses, and scored leaves without a number, lack evidence. Scores are held to 0..5, confidences to
    0..1; a leaf that isn't scored needs a person's look unless it says otherwise.
    """
    number = score.try_cast("double")
    number = F.when(F.isnan(number), F.lit(None)).otherwise(number)
    known = F.lower(F.trim(status))
    st = F.when((known == "scored") & number.isNull(), "insufficient_evidence").when(known.isin("scored", "na", "insufficient_evidence", "tool_failed"), known).otherwise("insufficient_evidence")
    flag = F.lower(F.trim(review))
    return F.struct(
        st.alias("status"), F.when(st == "scored", clamp(number, 0.0, 5.0)).alias("score"), clamp(confidence.try_cast("double"), 0.0, 1.0).alias("confidence"),
        F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False).otherwise(st != "scored").alias("review"),
    )


def rule_scores(leaves: DataFrame, question: str, key: str, rules: Sequence[Mapping]) -> DataFrame:
    """Scores by the first rule whose keyword the question holds: rules have keyword, status, score, confidence.

    Rules are tried in order; a leaf that none fits lacks evidence. One projection, no join: the rules are few.
    """
    low = F.lower(F.coalesce(F.col(question), F.lit("")))
    row = lambda n, r: F.struct(F.lit(n).alias("rule"), F.lit(r["status"]).alias("status"), F.lit(r["score"]).cast("double").alias("score"), F.lit(r["confidence"]).cast("double").alias("confidence"))
    out = row(0, {"status": "insufficient_evidence", "score": None, "confidence": 0.3})
    for n, r in reversed(list(enumerate(rules, 1))):
        out = F.when(low.contains(r["keyword"].lower()), row(n, r)).otherwise(out)
    return leaves.select(key, out.alias("r")).select(key, "r.*")


def clean_hints(hints: DataFrame, keys: Sequence[str], kind: str, value: str, priority: str) -> DataFrame:
    """Evidence hints of the four kinds with a value, once per key, kind and value, with their place by priority.

    Kinds are trimmed and lower-cased, priorities held to 1..10, null ones 5; of repeated hints the one of highest
    priority counts. Places follow priority downwards, then kind and value.
    """
    h = hints.select(*keys, F.lower(F.trim(kind)).alias("kind"), F.trim(value).alias("value"), F.coalesce(clamp(F.col(priority), 1, 10), F.lit(5)).cast("int").alias("priority"))
    h = h.where(F.col("kind").isin("path", "glob", "component", "keyword") & (F.col("value") != "")).groupBy(*keys, "kind", "value").agg(F.max("priority").alias("priority"))
    return with_place(h, keys, [F.desc("priority"), F.col("kind"), F.col("value")])
