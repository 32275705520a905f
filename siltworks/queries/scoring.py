"""Queries on activation, tool runs, score payloads, judge scores, citations and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import citation_kind
from siltworks.operators import scoring as S
from siltworks.operators import tools as T
from siltworks.plans.predicate import activate
from siltworks.session import table

#: The modules of the rubric tables and when they apply.
MODULE_RULES = {
    "A": "always", "B": "true", "C": "uses_api", "D": "uses_database or uses_ml", "E": "uses_web_ui and has_ci", "F": "uses_containers || uses_k8s && uses_iac",
    "G": "repo_kind == \"library\" OR repo_kind == 'cli'", "H": "has_auth and (uses_api or uses_web_ui)", "I": "uses_async == true", "J": "uses_mobile_sdk == none",
}
KEYWORD_RULES = (
    {"keyword": "limit", "status": "scored", "score": 4.0, "confidence": 0.7},
    {"keyword": "maintainer", "status": "scored", "score": 3.0, "confidence": 0.6},
    {"keyword": "without help", "status": "na", "score": None, "confidence": 0.8},
    {"keyword": "reviewer", "status": "scored", "score": 2.5, "confidence": 0.5},
    {"keyword": "announced", "status": "tool_failed", "score": None, "confidence": 0.1},
)


def applies_if_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activate(table(spark, sf_dir, "repo_signals"), MODULE_RULES)


def repo_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository kinds in one spelling, with how many signals are known and set."""
    s = table(spark, sf_dir, "repo_signals")
    flags = [c for c, t in s.dtypes if t == "boolean"]
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce("repo_kind", F.lit("")))), r"[\s-]+", "_")
    known = sum((F.col(c).isNotNull().cast("int") for c in flags), F.lit(0))
    held = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags), F.lit(0))
    return s.groupBy(F.when(kind == "", "unknown").otherwise(kind).alias("kind")).agg(F.count("*").alias("repos"), F.sum(known).alias("known"), F.sum(held).alias("held"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "tool_results")
    by_findings, by_result = F.col("evidence_class").isin("sast", "lint", "secrets_scanner", "dep_audit"), F.col("evidence_class") == "tests"
    return runs.withColumn("v", T.run_status(F.col("exit_code"), F.col("artifacts"), F.col("declared_outputs"), by_findings, by_result))


def tool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("run_id", F.col("v.status").alias("status"), F.col("v.reason").alias("reason"))


def tool_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and class the first completed run by time, or the last failed one."""
    runs = _classified(spark, sf_dir)
    return T.counting_run(runs, ["repo", "evidence_class"], F.col("v.status") == "completed", [F.col("started_at").isNull(), F.col("started_at"), F.col("run_id")]).select("repo", "evidence_class", "run_id", F.col("v.status").alias("status"))


def tool_missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.missing_artifacts(table(spark, sf_dir, "tool_results"))


def tool_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ledger(table(spark, sf_dir, "tool_results"), "evidence_class").withColumn("seconds", F.round("seconds", 3))


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the later half of each day that earlier runs' cache answers, and those that it doesn't."""
    runs = table(spark, sf_dir, "tool_results").withColumn("late", F.hour("started_at") >= 12)
    hits, misses = T.split_by_cache(runs.where("late"), runs.where("NOT late AND status = 'completed'"))
    return hits.select("run_id", F.lit("hit").alias("cache")).unionByName(misses.select("run_id", F.lit("miss").alias("cache")))


def finding_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per state of the run that delivered them; findings without a run, or of an unknown one, have none."""
    runs = table(spark, sf_dir, "tool_results").select("run_id", F.col("status").alias("run_status"))
    rows = table(spark, sf_dir, "findings").select("run_id").groupBy("run_id").agg(F.count("*").alias("n"))
    return rows.join(runs, "run_id", "left").groupBy(F.coalesce("run_status", F.lit("no_run")).alias("run_status")).agg(F.sum("n").alias("findings"), F.count("run_id").alias("runs"))


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rule_scores(table(spark, sf_dir, "leaf_definitions"), "question", "leaf_key", KEYWORD_RULES)


def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf scores through a JSON payload and back: every leaf is written with its dirt, parsed, and cleaned."""
    e = table(spark, sf_dir, "group_results").select("result_id", F.posexplode("leaf_results").alias("pos", "r")).where("r IS NOT NULL")
    k = F.pmod(F.col("result_id") + F.col("pos"), F.lit(7))
    score = F.when(k == 0, "high").when(k == 1, F.concat(F.lit("-"), F.coalesce(F.col("r.score").cast("string"), F.lit("1")))).when(k == 2, "99").otherwise(F.col("r.score").cast("string"))
    payload = F.to_json(F.struct(F.when(k == 3, F.upper("r.status")).otherwise(F.col("r.status")).alias("status"), score.alias("score"), F.col("r.confidence").cast("string").alias("confidence"), F.when(k == 4, F.lit(None)).otherwise(F.col("r.needs_human_review").cast("string")).alias("review")))
    got = F.from_json(payload, "status string, score string, confidence string, review string")
    rows = e.select("result_id", "pos", got.alias("g"))
    clean = S.clean_leaf_score(F.col("g.status"), F.col("g.score"), F.col("g.confidence"), F.col("g.review"))
    return rows.select("result_id", "pos", clean.alias("c")).select("result_id", "pos", "c.*")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's payload for each group result, derived from its counts."""
    g = table(spark, sf_dir, "group_results")
    n = F.coalesce(F.col("scored_leaf_count"), F.lit(0)) + 2 * F.coalesce(F.col("na_leaf_count"), F.lit(0))
    part = lambda i, m: F.pmod(F.col("result_id") * (2 * i + 3) + n * (i + 1), F.lit(m)).cast("int")
    return g.select("result_id", *[(part(i, 8) - 1).alias(s) for i, s in enumerate(S.SUBSCORES)], *[F.greatest(part(i, 11) - 8, F.lit(-1)).alias(f) for i, f in enumerate(S.FAULTS)])


def judge_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rescore(_judged(spark, sf_dir)).select("result_id", *S.SUBSCORES, "base", "penalty", "overall", "verdict")


def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by kind per repository."""
    leaves = table(spark, sf_dir, "group_results").select("repo", F.explode("leaf_results").alias("r")).where("r IS NOT NULL")
    c = leaves.select("repo", F.explode("r.citations").alias("citation")).select("repo", citation_kind(F.col("citation")).alias("kind"))
    return c.groupBy("repo").agg(F.count("*").alias("citations"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("empty", "retrieval", "activation_hint", "simal", "tool", "repo_line", "other")])


def hint_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean_hints(table(spark, sf_dir, "loaded_files"), ["repo"], "hint_type", "hint_value", "hint_priority")


def _predicates_sql() -> str:
    b = lambda c: f"coalesce({c}, false)"
    t = lambda c: f"lower(coalesce({c}::VARCHAR, 'none'))"
    sql = {
        "A": "true", "B": "true", "C": b("uses_api"), "D": f"{b('uses_database')} OR {b('uses_ml')}", "E": f"{b('uses_web_ui')} AND {b('has_ci')}",
        "F": f"{b('uses_containers')} OR ({b('uses_k8s')} AND {b('uses_iac')})", "G": f"{t('repo_kind')} = 'library' OR {t('repo_kind')} = 'cli'",
        "H": f"{b('has_auth')} AND ({b('uses_api')} OR {b('uses_web_ui')})", "I": f"{t('uses_async')} = 'true'", "J": f"{t('uses_mobile_sdk')} = 'none'",
    }
    return " UNION ALL ".join(f"SELECT repo, '{m}' AS module_id, ({e}) AS enabled, {0.9 if m in 'AB' else 0.65}::DOUBLE AS confidence FROM repo_signals" for m, e in sql.items())


_STATUS = """WITH r AS (SELECT *, len(list_filter(map_values(artifacts), lambda v: coalesce(v, '') <> '')) > 0 AS has, len(list_filter(declared_outputs, lambda v: coalesce(v, '') <> '')) > 0 AS due,
  evidence_class IN ('sast', 'lint', 'secrets_scanner', 'dep_audit') AS bf, evidence_class = 'tests' AS br FROM tool_results),
v AS (SELECT *, CASE WHEN exit_code IS NULL THEN 'invalid_exit_code' WHEN exit_code = 0 THEN NULL WHEN exit_code = 127 THEN 'tool_not_found_or_not_executable' WHEN exit_code = 126 THEN 'tool_not_executable'
  WHEN exit_code < 0 THEN 'terminated_by_signal:' || (-exit_code) WHEN br THEN NULL WHEN bf AND (coalesce(has, false) OR NOT coalesce(due, false)) THEN NULL WHEN bf THEN 'nonzero_exit_and_no_artifacts' ELSE 'nonzero_exit_code:' || exit_code END AS why FROM r),
s AS (SELECT *, CASE WHEN why IS NULL THEN 'completed' ELSE 'tool_failed' END AS st FROM v)
"""


def _judge_sql() -> str:
    n = "(coalesce(scored_leaf_count, 0) + 2 * coalesce(na_leaf_count, 0))"
    part = lambda i, m: f"((result_id * {2 * i + 3} + {n} * {i + 1}) % {m})"
    sub = ", ".join(f"greatest(0, least(5, {part(i, 8)} - 1)) AS {s}" for i, s in enumerate(S.SUBSCORES))
    flt = ", ".join(f"greatest(0, greatest({part(i, 11)} - 8, -1)) AS {f}" for i, f in enumerate(S.FAULTS))
    capped = dict.fromkeys(S.SUBSCORES, "")
    for s in capped:
        capped[s] = s
        for fault, least, name, most in S.CAPS:
            if name == s:
                capped[s] = f"CASE WHEN {fault} >= {least} THEN least({capped[s]}, {most}) ELSE {capped[s]} END"
    cols = ", ".join(f"({e})::INT AS {s}" for s, e in capped.items())
    base = " + ".join(f"{s} * {w}" for s, w in S.SUBSCORES.items())
    pen = " + ".join(f"{f} * {w}" for f, w in S.FAULTS.items())
    return f"""WITH p AS (SELECT result_id, {sub}, {flt} FROM group_results), c AS (SELECT result_id, {cols}, ({pen})::INT AS penalty FROM p),
        o AS (SELECT *, round(({base}) / 5.0)::INT AS base FROM c), q AS (SELECT *, greatest(0, least(100, base - penalty))::INT AS overall FROM o)
        SELECT result_id, {', '.join(S.SUBSCORES)}, base, penalty, overall, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 55 THEN 'fair' WHEN overall >= 30 THEN 'poor' ELSE 'unusable' END AS verdict FROM q"""


_PARSE = """WITH e AS (SELECT result_id, i - 1 AS pos, leaf_results[i] AS r FROM (SELECT result_id, leaf_results, unnest(range(1, len(leaf_results) + 1)) AS i FROM group_results)),
k AS (SELECT result_id, pos, (result_id + pos) % 7 AS k, r FROM e WHERE r IS NOT NULL),
t AS (SELECT result_id, pos, lower(r.status) AS st, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN -coalesce(r.score, 1) WHEN k = 2 THEN 99 ELSE r.score END AS sc, r.confidence AS cf, CASE WHEN k = 4 THEN NULL ELSE r.needs_human_review END AS rv FROM k),
u AS (SELECT *, CASE WHEN st = 'scored' AND sc IS NULL THEN 'insufficient_evidence' WHEN st IN ('scored', 'na', 'insufficient_evidence', 'tool_failed') THEN st ELSE 'insufficient_evidence' END AS status FROM t)
SELECT result_id, pos::INT AS pos, status, CASE WHEN status = 'scored' THEN greatest(0.0, least(5.0, sc)) END AS score, CASE WHEN cf IS NOT NULL THEN greatest(0.0, least(1.0, cf)) END AS confidence, coalesce(rv, status <> 'scored') AS review FROM u"""


def queries() -> dict:
    names = (applies_if_activation, repo_kinds, tool_status, tool_first_success, tool_missing_artifacts, tool_ledger, cache_split, finding_run_status, rule_score, score_parse, judge_rescore, citation_stats, hint_normalize)
    return {q.__name__: q for q in names}


def oracle_sql() -> dict:
    flags = ["uses_api", "uses_database", "uses_web_ui", "uses_containers", "uses_k8s", "uses_iac", "uses_ml", "uses_mobile_sdk", "uses_concurrency", "uses_async", "has_auth", "has_ci"]
    rule = "CASE " + " ".join(f"WHEN contains(lower(coalesce(question, '')), '{r['keyword']}') THEN {n}" for n, r in enumerate(KEYWORD_RULES, 1)) + " ELSE 0 END"
    pick = lambda f: "CASE rule " + " ".join(f"WHEN {n} THEN {'NULL' if r[f] is None else repr(r[f])}" for n, r in enumerate(KEYWORD_RULES, 1))
    kinds = ", ".join(f'count(*) FILTER (kind = \'{k}\') AS "{k}"' for k in ("empty", "retrieval", "activation_hint", "simal", "tool", "repo_line", "other"))
    return {
        "applies_if_activation": _predicates_sql(),
        "repo_kinds": f"""SELECT CASE WHEN k = '' THEN 'unknown' ELSE k END AS kind, count(*) AS repos, sum(known)::BIGINT AS known, sum(held)::BIGINT AS held FROM (SELECT regexp_replace(lower(trim(coalesce(repo_kind, ''))), '[\\s-]+', '_', 'g') AS k,
            {' + '.join(f'({c} IS NOT NULL)::INT' for c in flags)} AS known, {' + '.join(f'coalesce({c}::INT, 0)' for c in flags)} AS held FROM repo_signals) GROUP BY 1""",
        "tool_status": _STATUS + "SELECT run_id, st AS status, why AS reason FROM s",
        "tool_first_success": _STATUS + """, w AS (SELECT *, row_number() OVER p AS n, row_number() OVER (PARTITION BY repo, evidence_class ORDER BY (st = 'completed') DESC, started_at NULLS LAST, run_id) AS f,
            count(*) OVER (PARTITION BY repo, evidence_class) AS t, bool_or(st = 'completed') OVER (PARTITION BY repo, evidence_class) AS any_ok FROM s WINDOW p AS (PARTITION BY repo, evidence_class ORDER BY started_at NULLS LAST, run_id))
            SELECT repo, evidence_class, run_id, st AS status FROM w WHERE CASE WHEN any_ok THEN f = 1 ELSE n = t END""",
        "tool_missing_artifacts": "SELECT run_id, output FROM (SELECT run_id, artifacts, unnest(declared_outputs) AS output FROM tool_results) WHERE coalesce(output, '') <> '' AND NOT coalesce(list_contains(map_keys(artifacts), output), false)",
        "tool_ledger": "SELECT evidence_class, count(*) AS runs, count(*) FILTER (coalesce(cache_hit, false)) AS cached, round(sum(coalesce(CASE WHEN isnan(duration_sec) THEN NULL ELSE duration_sec END, 0.0)), 3) AS seconds, grouping_id(evidence_class) AS level FROM tool_results GROUP BY ROLLUP (evidence_class)",
        "cache_split": """WITH c AS (SELECT DISTINCT cache_key FROM tool_results WHERE hour(started_at) < 12 AND status = 'completed' AND cache_key IS NOT NULL)
            SELECT run_id, CASE WHEN cache_key IN (SELECT cache_key FROM c) THEN 'hit' ELSE 'miss' END AS cache FROM tool_results WHERE hour(started_at) >= 12""",
        "finding_run_status": """SELECT coalesce(t.status, 'no_run') AS run_status, sum(n)::BIGINT AS findings, count(f.run_id) AS runs FROM (SELECT run_id, count(*) AS n FROM findings GROUP BY run_id) f LEFT JOIN tool_results t ON t.run_id = f.run_id GROUP BY 1""",
        "rule_score": f"""SELECT leaf_key, rule, {pick('status')} ELSE 'insufficient_evidence' END AS status, ({pick('score')} ELSE NULL END)::DOUBLE AS score, ({pick('confidence')} ELSE 0.3 END)::DOUBLE AS confidence FROM (SELECT leaf_key, {rule} AS rule FROM leaf_definitions)""",
        "score_parse": _PARSE,
        "judge_rescore": _judge_sql(),
        "citation_stats": f"""WITH l AS (SELECT repo, unnest(leaf_results) AS r FROM group_results), c AS (SELECT repo, trim(coalesce(unnest(r.citations), '')) AS c FROM l WHERE r IS NOT NULL),
            k AS (SELECT repo, CASE WHEN c = '' THEN 'empty' WHEN starts_with(c, 'retrieval.') THEN 'retrieval' WHEN starts_with(c, 'activation_hint_evidence.') THEN 'activation_hint' WHEN starts_with(c, 'simal') THEN 'simal'
              WHEN starts_with(c, 'dynamic_tools') OR starts_with(c, 'tool_summary') THEN 'tool' WHEN regexp_matches(c, ':[^:]*[0-9][^:]*$') THEN 'repo_line' ELSE 'other' END AS kind FROM c)
            SELECT repo, count(*) AS citations, {kinds} FROM k GROUP BY repo""",
        "hint_normalize": """WITH h AS (SELECT repo, lower(trim(hint_type)) AS kind, trim(hint_value) AS value, max(CASE WHEN hint_priority IS NULL THEN 5 ELSE greatest(1, least(10, hint_priority)) END)::INT AS priority FROM loaded_files
            WHERE lower(trim(hint_type)) IN ('path', 'glob', 'component', 'keyword') AND trim(hint_value) <> '' GROUP BY 1, 2, 3)
            SELECT repo, kind, value, priority, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, kind, value) AS place FROM h""",
    }
