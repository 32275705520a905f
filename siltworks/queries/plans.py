"""Queries on the plan of an evaluation: activation, recorded answers, inventories, schema search, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions.paths import plain
from siltworks.operators import model as M
from siltworks.operators import search as S
from siltworks.operators.activation import group_plan
from siltworks.operators.findings import severity_rank
from siltworks.plans.predicate import activate
from siltworks.queries.scoring import MODULE_RULES, _predicates_sql
from siltworks.session import table, widen_first
from siltworks.sources.inventories import lock_entries

SCHEMA_QUERIES = ("retry", "cache", "limit", "test", "release")


def activation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the base rubric per repository; the latest result of a group overrides its module."""
    groups = table(spark, sf_dir, "leaf_definitions").where("repo IS NULL").select("module_id", "group_id").distinct()
    last = Window.partitionBy("repo", "module_id", "group_id").orderBy(F.col("finished_at").desc_nulls_last(), F.desc("result_id"))
    own = table(spark, sf_dir, "group_results").withColumn("n", F.row_number().over(last)).where("n = 1").select("repo", "module_id", "group_id", "enabled", "confidence")
    return group_plan(groups, activate(table(spark, sf_dir, "repo_signals"), MODULE_RULES), own)


def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the forks that the base rubric's answers cover, by the key of their request."""
    q = table(spark, sf_dir, "leaf_definitions").select("leaf_key", "repo", F.col("question").alias("prompt")).withColumn("key", M.request_key(["prompt"]))
    recorded = q.where("repo IS NULL").groupBy("key").agg(F.concat(F.lit("leaf "), F.min("leaf_key")).alias("answer"))
    return M.answer(q.where("repo IS NOT NULL"), recorded, "key").select("leaf_key", "answer", "source")


def dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that lock files name: how many repositories, files and versions."""
    files = table(spark, sf_dir, "loaded_files").select(F.struct("file_id", "repo").alias("f"), "content")
    e = lock_entries(files, "f", "content")
    return e.groupBy("name").agg(F.count_distinct("f.repo").alias("repos"), F.count_distinct("f.file_id").alias("files"), F.count_distinct("version").alias("versions"), F.count("*").alias("entries"))


def schema_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged windows of each document, within a budget."""
    docs = widen_first(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return S.schema_search(docs, "doc_id", "text", SCHEMA_QUERIES).withColumn("queries", F.array_join("queries", " ; "))


def schema_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by its former name."""
    return schema_search(spark, sf_dir)


def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report per repository: worst finding rank, files loaded, results, kind."""
    f = table(spark, sf_dir, "findings").groupBy("repo").agg(F.count("*").alias("findings"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    l = table(spark, sf_dir, "loaded_files").groupBy("repo").agg(F.count("*").alias("files"), F.count_distinct(plain(F.col("path"))).alias("paths"))  # noqa: E741
    r = table(spark, sf_dir, "group_results").groupBy("repo").agg(F.count("*").alias("results"))
    s = table(spark, sf_dir, "repo_signals").select("repo").join(f, "repo", "left").join(l, "repo", "left").join(r, "repo", "left").fillna(0, ["findings", "worst", "files", "paths", "results"])
    return s.select("repo", F.to_json(F.struct("repo", F.struct("findings", "worst").alias("summary"), F.struct("files", "paths").alias("evidence"), "results")).alias("report"))


def queries() -> dict:
    return {q.__name__: q for q in (activation_plan, recorded_answers, dependency_inventory, schema_search, schema_search_all, report_payload)}


def oracle_sql() -> dict:
    q = ", ".join(f"('{w}')" for w in SCHEMA_QUERIES)
    split = r"CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END"
    merge = lambda src, keys, n: f"""SELECT {keys}, min(s) AS s, max(e) AS e, {n} AS m, list_sort(list(DISTINCT query)) AS qs FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e, query ROWS UNBOUNDED PRECEDING) AS isl
        FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e, query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src})) GROUP BY {keys}, isl"""  # noqa: E731
    sql = {
        "activation_plan": f"""WITH m AS ({_predicates_sql()}), g AS (SELECT DISTINCT module_id, group_id FROM leaf_definitions WHERE repo IS NULL),
            o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, module_id, group_id ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS n FROM group_results) WHERE n = 1)
            SELECT m.repo, m.module_id, g.group_id, coalesce(o.enabled, m.enabled, true) AS enabled, coalesce(o.confidence, m.confidence, 0.5) AS confidence, o.enabled IS NOT NULL AS overridden
            FROM m JOIN g ON g.module_id = m.module_id LEFT JOIN o ON o.repo = m.repo AND o.module_id = m.module_id AND o.group_id = g.group_id""",
        "recorded_answers": """WITH b AS (SELECT question, 'leaf ' || min(leaf_key) AS answer FROM leaf_definitions WHERE repo IS NULL GROUP BY question)
            SELECT leaf_key, b.answer, CASE WHEN b.answer IS NULL THEN 'none' ELSE 'recorded' END AS source FROM leaf_definitions d LEFT JOIN b ON b.question IS NOT DISTINCT FROM d.question WHERE d.repo IS NOT NULL""",
        "dependency_inventory": r"""WITH l AS (SELECT file_id, repo, unnest(regexp_split_to_array(content, '\r\n|\n|\r')) AS l FROM loaded_files),
            e AS (SELECT file_id, repo, regexp_extract(l, '^  ([A-Za-z][\w./-]*)@([0-9][\w.+-]*):$', 1) AS name, regexp_extract(l, '^  ([A-Za-z][\w./-]*)@([0-9][\w.+-]*):$', 2) AS version FROM l WHERE regexp_matches(l, '^  ([A-Za-z][\w./-]*)@([0-9][\w.+-]*):$'))
            SELECT name, count(DISTINCT repo) AS repos, count(DISTINCT file_id) AS files, count(DISTINCT version) AS versions, count(*) AS entries FROM e GROUP BY name""",
        "schema_search": f"""WITH d AS (SELECT doc_id, {split} AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, i AS n, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
            o AS (SELECT doc_id, greatest(1, n - 2) AS s, n + 2 AS e, q.query FROM l, (VALUES {q}) AS q(query) WHERE regexp_matches(line, '(?i)' || q.query)), a AS ({merge('o', 'doc_id, query', 'count(*)')}),
            b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY s) AS k FROM a), c AS (SELECT doc_id, query, s, e, m FROM b WHERE k <= 20), g AS ({merge('c', 'doc_id', 'sum(m)')}),
            w AS (SELECT g.doc_id, s, least(e, len(ls)) AS e, m, qs, (list_sum(list_transform(ls[s:least(e, len(ls))], lambda x: length(x))) + least(e, len(ls)) - s)::BIGINT AS chars FROM g JOIN d ON d.doc_id = g.doc_id),
            p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS place, sum(chars) OVER (PARTITION BY doc_id ORDER BY s) > 2000 AS ov FROM w), z AS (SELECT *, max(CASE WHEN place > 1 AND ov THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS st FROM p)
            SELECT doc_id, place, s AS start, e AS "end", m::BIGINT AS matches, array_to_string(qs, ' ; ') AS queries, chars FROM z WHERE st = 0 AND place <= 25""",
        "report_payload": """WITH f AS (SELECT repo, count(*) AS n, max(CASE lower(trim(coalesce(severity, ''))) WHEN 'critical' THEN 5 WHEN 'error' THEN 4 WHEN 'high' THEN 4 WHEN 'warning' THEN 3 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 WHEN 'note' THEN 1 ELSE 0 END) AS w FROM findings GROUP BY repo),
            l AS (SELECT repo, count(*) AS n, count(DISTINCT coalesce(ltrim(replace(path, '\\', '/'), './'), '')) AS p FROM loaded_files GROUP BY repo), r AS (SELECT repo, count(*) AS n FROM group_results GROUP BY repo)
            SELECT s.repo, '{"repo":"' || s.repo || '","summary":{"findings":' || coalesce(f.n, 0) || ',"worst":' || coalesce(f.w, 0) || '},"evidence":{"files":' || coalesce(l.n, 0) || ',"paths":' || coalesce(l.p, 0) || '},"results":' || coalesce(r.n, 0) || '}' AS report
            FROM repo_signals s LEFT JOIN f ON f.repo = s.repo LEFT JOIN l ON l.repo = s.repo LEFT JOIN r ON r.repo = s.repo""",
    }
    return sql | {"schema_search_all": sql["schema_search"]}
