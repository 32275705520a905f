"""Queries on the evidence of rubric groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import is_build_output, plain, read_priority, segments
from siltworks.operators import evidence as E
from siltworks.operators.findings import SEVERITY_RANKS, severity_rank, severity_word
from siltworks.operators.signals import LANGUAGES, language
from siltworks.queries.search import _BUILD, _F, _MIN, _SEG, HINT_SQL, MATCH_SQL, _priority_sql
from siltworks.session import table, widen_first

#: tools by evidence class and language, and what a repository's own registry changes and adds
SPECS = (("lint", "python", "stylewarden", 5), ("lint", "any", "tidyline", 3), ("sast", "any", "patternhound", 5), ("tests", "python", "casecount", 4), ("tests", "go", "gocases", 4), ("complexity", "any", "knotmeter", 2), ("dup", "javascript", "twinspot", 2))
PATCH = (("lint", "any", "tidyline", 9), ("tests", "java", "unitrun", None), ("dup", "javascript", "twinspot", None))
STEPS = (("A1", "file_match"), ("A1", "repo_scan"), ("B2", "dynamic_tool"), ("C3", "file_match"), ("C3", "dynamic_tool"), ("I1", "repo_scan"), ("H4", "file_match"))
SHOWN = 25
MODES = 3


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_files").withColumn("path", plain(F.col("path")))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("repo", language(F.col("path")).alias("lang")).where("lang IS NOT NULL AND repo IS NOT NULL").distinct()


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository how many files a dump leaves out for what reason, and takes (kept)."""
    f = widen_first(_files(spark, sf_dir).select("repo", "path", "content"))
    return f.select("repo", F.coalesce(E.skip_reason(F.col("path"), F.col("content")), F.lit("kept")).alias("reason")).groupBy("repo", "reason").agg(F.count("*").alias("files"))


def dump_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each repository that are read first, up to 60,000 characters, the last one cut."""
    f = _files(spark, sf_dir).where(~is_build_output(F.col("path"))).select("repo", "file_id", "path", read_priority(F.col("path")).alias("priority"), F.size(segments(F.col("path"))).alias("depth"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"))
    return E.dump_cut(f, ["repo"], [F.col(c) for c in ("priority", "depth", "path", "file_id")], "chars", 180, 60_000).select("repo", "file_id", "place", "taken")


def dump_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository files, characters, files longer than 8,000 characters, and characters within that."""
    n = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    return _files(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("files"), F.sum(n).alias("chars"), F.count_if(n > 8000).alias("truncated"), F.sum(F.least(n, F.lit(8000))).alias("included"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and file name among manifests and configuration the shallowest path."""
    names = (*E.MANIFESTS, ".env", "data.py", "fixture.py", "table.js")
    return E.shallowest(_files(spark, sf_dir).where("repo IS NOT NULL"), "repo", "path", names)


def hint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file is what its own hint asks for."""
    f = table(spark, sf_dir, "loaded_files")
    hint = E.safe_path(F.col("hint_value"))
    return f.select("file_id", hint.alias("hint"), F.coalesce(E.hint_match(plain(F.col("path")), F.col("hint_type"), hint), F.lit("none")).alias("match"))


def retrieval_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct safe hints of every group with their highest priority."""
    f = table(spark, sf_dir, "loaded_files").where("group_id IS NOT NULL AND hint_type IN ('path', 'glob')")
    return f.select("repo", "group_id", "hint_type", E.safe_path(F.col("hint_value")).alias("hint"), "hint_priority").where("hint IS NOT NULL").groupBy("repo", "group_id", "hint_type", "hint").agg(F.coalesce(F.max("hint_priority"), F.lit(0)).alias("priority"), F.count("*").alias("files"))


def _specs(spark: SparkSession) -> DataFrame:
    ddl = "evidence_class string, lang string, tool string, priority int"
    return E.patched(spark.createDataFrame(SPECS, ddl), spark.createDataFrame(PATCH, ddl), ["evidence_class", "lang", "tool"]).fillna(0, ["priority"])


def tool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools for each repository's languages, in the order they are tried."""
    return E.tool_candidates(_languages(spark, sf_dir), _specs(spark), "repo")


def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_evidence(table(spark, sf_dir, "tool_results"), ["repo", "evidence_class"])


def evidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the evidence classes there are, runs, completed runs and those with an artifact."""
    left = F.coalesce(F.size("artifacts") > 0, F.lit(False))
    return table(spark, sf_dir, "tool_results").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("evidence_class")), ",").alias("classes"), F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(left).alias("with_artifacts"))


def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository its severities with their counts, by rank descending, then name."""
    counted = table(spark, sf_dir, "findings").groupBy("repo", severity_word(F.col("severity")).alias("word")).agg(F.count("*").alias("n"))
    entry = F.struct((-severity_rank(F.col("word"))).alias("r"), "word", "n")
    shown = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["word"], F.lit("="), e["n"]))
    return counted.groupBy("repo").agg(F.array_join(shown, ";").alias("severities"))


def report_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run whether its report can be had, and whether all its findings are among those included."""
    n = table(spark, sf_dir, "findings").where("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("total"))
    runs = table(spark, sf_dir, "tool_results").select("run_id", F.coalesce("status", F.lit("")).alias("status"), "reason").join(n, "run_id", "left").fillna(0, ["total"])
    return runs.select("run_id", F.coalesce("reason", F.lit("")).alias("reason"), "total", E.report_state(F.col("status"), F.col("total"), SHOWN).alias("s")).select("run_id", "reason", "total", "s.*")


def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles as answers in three manners of speaking, and how long the objects are that are found in them."""
    b, k = F.col("evidence_bundle"), F.pmod("result_id", F.lit(MODES))
    said = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), b, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("The answer is "), b, F.lit(" as asked"))).otherwise(b)
    return table(spark, sf_dir, "group_results").select("result_id", E.first_object(said).isNotNull().alias("found"))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf results as whole scores (halves to even), without failed tools, with clean citations and remediations."""
    leaves = table(spark, sf_dir, "group_results").select("result_id", F.posexplode("leaf_results").alias("pos", "r")).where("r IS NOT NULL")
    whole = F.greatest(F.lit(0), F.least(F.lit(5), F.bround("r.score", 0).cast("int")))
    joined = lambda c: F.coalesce(F.array_join(E.text_list(F.col(c)), "|"), F.lit(""))
    return leaves.select(
        "result_id", "pos", F.when(F.col("r.status") == "tool_failed", "insufficient_evidence").otherwise(F.col("r.status")).alias("status"),
        F.when((F.col("r.status") == "scored") & F.col("r.score").isNotNull(), whole.cast("double")).alias("score"), joined("r.citations").alias("citations"), joined("r.remediation").alias("remediation"),
    )


def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence the profile of every group of a repository comes to."""
    steps = spark.createDataFrame(STEPS, "group_id string, strategy string")
    return E.bundle_rows(_files(spark, sf_dir).where("repo IS NOT NULL"), table(spark, sf_dir, "tool_results"), steps, _languages(spark, sf_dir))


_QUERIES = (
    skip_reasons, dump_cut, dump_manifest, manifest_files, hint_matches, retrieval_hints, tool_candidates, first_evidence, evidence_profile, severity_map, report_states,
    answer_objects, baseline_scores, evidence_bundles,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


_PLAIN = "coalesce(ltrim(replace(path, '\\', '/'), './'), '')"
_EXT = r"regexp_extract(lower(path), '(\.[^./]+)$', 1)"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in LANGUAGES.items()) + " END"
_LANGS = f"SELECT DISTINCT repo, {_LANG} AS lang FROM f WHERE {_LANG} IS NOT NULL AND repo IS NOT NULL"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


def oracle_sql() -> dict:
    dirs = ", ".join(f"'{d}'" for d in E.IGNORED_DIRS)
    names = ", ".join(f"'{n}'" for n in (*E.MANIFESTS, ".env", "data.py", "fixture.py", "table.js"))
    rank = "CASE word " + " ".join(f"WHEN '{w}' THEN {r}" for w, r in SEVERITY_RANKS.items()) + " ELSE 0 END"
    clean = lambda c: rf"coalesce(array_to_string(list_filter(list_transform(r.{c}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''), '|'), '')"
    return {
        "skip_reasons": rf"""WITH {_F}, {_MIN}, sk AS (SELECT repo, CASE WHEN path = '' OR {_BUILD} OR list_has_any(string_split(regexp_replace(path, '[^/]*$', ''), '/'), [{dirs}]) THEN 'generated_path'
            WHEN regexp_matches(lower(path), '\.min\.(js|css)$') THEN 'ignored_name_or_ext' WHEN content IS NULL OR NOT regexp_matches(content, '\S') THEN 'empty' WHEN minified THEN 'minified_or_generated_content' ELSE 'kept' END AS reason FROM n)
            SELECT repo, reason, count(*) AS files FROM sk GROUP BY repo, reason""",
        "dump_cut": f"""WITH {_F}, p AS (SELECT repo, file_id, path, {_priority_sql()} AS priority, len({_SEG})::INT AS depth, coalesce(length(content), 0)::BIGINT AS chars FROM f WHERE NOT {_BUILD}),
            r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, depth, path, file_id) AS place FROM p), u AS (SELECT *, 60000 - coalesce(sum(chars) OVER (PARTITION BY repo ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft FROM r WHERE place <= 180)
            SELECT repo, file_id, place, least(chars, lft)::BIGINT AS taken FROM u WHERE lft > 0""",
        "dump_manifest": "SELECT repo, count(*) AS files, sum(coalesce(length(content), 0))::BIGINT AS chars, count(*) FILTER (length(content) > 8000) AS truncated, sum(least(coalesce(length(content), 0), 8000))::BIGINT AS included FROM loaded_files GROUP BY repo",
        "manifest_files": f"""WITH {_F}, m AS (SELECT repo, path, regexp_extract(path, '[^/]*$', 0) AS name, len({_SEG})::INT AS depth FROM f WHERE repo IS NOT NULL), k AS (SELECT * FROM m WHERE name IN ({names})),
            r AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY depth, path) AS n, count(*) OVER (PARTITION BY repo, name) AS c FROM (SELECT DISTINCT * FROM k)) SELECT repo, name, path, depth, c AS paths FROM r WHERE n = 1""",
        "hint_matches": f"WITH h AS (SELECT file_id, hint_type, {_PLAIN} AS p, {HINT_SQL} AS hint FROM loaded_files) SELECT file_id, hint, coalesce({MATCH_SQL}, 'none') AS match FROM h",
        "retrieval_hints": f"WITH h AS (SELECT repo, group_id, hint_type, {HINT_SQL} AS hint, hint_priority FROM loaded_files WHERE group_id IS NOT NULL AND hint_type IN ('path', 'glob')) SELECT repo, group_id, hint_type, hint, coalesce(max(hint_priority), 0) AS priority, count(*) AS files FROM h WHERE hint IS NOT NULL GROUP BY ALL",
        "tool_candidates": f"""WITH {_F}, l AS ({_LANGS}), w AS (SELECT repo, lang, 1 AS own FROM l UNION ALL SELECT DISTINCT repo, 'any', 0 FROM l), b AS (SELECT * FROM (VALUES {_values(SPECS)}) AS v(ec, lang, tool, pr)), c AS (SELECT * FROM (VALUES {_values(PATCH)}) AS v(ec, lang, tool, pr)),
            s AS (SELECT coalesce(c.ec, b.ec) AS ec, coalesce(c.lang, b.lang) AS lang, coalesce(c.tool, b.tool) AS tool, coalesce(c.pr, b.pr, 0) AS pr FROM b FULL JOIN c ON c.ec = b.ec AND c.lang = b.lang AND c.tool = b.tool),
            m AS (SELECT repo, ec, tool, pr, own, row_number() OVER (PARTITION BY repo, ec, tool ORDER BY pr DESC NULLS LAST, own DESC) AS k FROM w JOIN s ON s.lang = w.lang)
            SELECT repo, ec AS evidence_class, tool, pr AS priority, row_number() OVER (PARTITION BY repo, ec ORDER BY pr DESC NULLS LAST, own DESC, tool) AS place FROM m WHERE k = 1""",
        "first_evidence": "SELECT repo, evidence_class, tool, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, evidence_class ORDER BY started_at NULLS LAST, run_id) AS n FROM tool_results WHERE status = 'completed') WHERE n = 1",
        "evidence_profile": "SELECT repo, coalesce(array_to_string(list_sort(list(DISTINCT evidence_class) FILTER (evidence_class IS NOT NULL)), ','), '') AS classes, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (cardinality(artifacts) > 0) AS with_artifacts FROM tool_results GROUP BY repo",
        "severity_map": f"WITH c AS (SELECT repo, CASE WHEN trim(coalesce(severity, '')) = '' THEN 'unknown' ELSE lower(trim(severity)) END AS word, count(*) AS n FROM findings GROUP BY ALL) SELECT repo, string_agg(word || '=' || n, ';' ORDER BY {rank} DESC, word) AS severities FROM c GROUP BY repo",
        "report_states": f"""WITH n AS (SELECT run_id, count(*) AS t FROM findings WHERE run_id IS NOT NULL GROUP BY 1), j AS (SELECT r.run_id, coalesce(r.reason, '') AS reason, coalesce(n.t, 0) AS total, coalesce(r.status, '') = 'completed' AS ok FROM tool_results r LEFT JOIN n ON n.run_id = r.run_id)
            SELECT run_id, reason, total, CASE WHEN ok THEN 'ok' ELSE 'unavailable' END AS state, CASE WHEN ok THEN least(total, {SHOWN}) ELSE 0 END AS included, ok AND total <= {SHOWN} AS complete FROM j""",
        "answer_objects": r"""WITH b AS (SELECT result_id, evidence_bundle AS b FROM group_results), c AS (SELECT result_id, b, regexp_extract(b, '\{.*\}', 0, 's') AS c FROM b)
            SELECT result_id, coalesce((starts_with(ltrim(b), '{') AND json_valid(b)) OR (c <> '' AND json_valid(c)), false) AS found FROM c""",
        "baseline_scores": f"""WITH l AS (SELECT result_id, i - 1 AS pos, leaf_results[i] AS r FROM (SELECT result_id, leaf_results, unnest(range(1, len(leaf_results) + 1)) AS i FROM group_results))
            SELECT result_id, pos::INT AS pos, CASE WHEN r.status = 'tool_failed' THEN 'insufficient_evidence' ELSE r.status END AS status, CASE WHEN r.status = 'scored' AND r.score IS NOT NULL THEN greatest(0, least(5, round_even(r.score, 0)))::DOUBLE END AS score,
              {clean('citations')} AS citations, {clean('remediation')} AS remediation FROM l WHERE r IS NOT NULL""",
        "evidence_bundles": f"""WITH f0 AS (SELECT file_id, repo, group_id, hint_type, hint_priority, {_PLAIN} AS p, {_PLAIN} AS path, {HINT_SQL} AS hint FROM loaded_files WHERE repo IS NOT NULL), f AS (SELECT * FROM f0),
            m AS (SELECT *, row_number() OVER (PARTITION BY repo, group_id ORDER BY hint_priority DESC NULLS LAST, path, file_id) AS n FROM f WHERE group_id IS NOT NULL AND {MATCH_SQL} IS NOT NULL), g AS (SELECT DISTINCT repo, group_id FROM f WHERE group_id IS NOT NULL), l AS ({_LANGS}),
            e AS (SELECT repo, group_id, 'file_match' AS strategy, count(*) AS items FROM m WHERE n <= 20 GROUP BY ALL UNION ALL SELECT g.repo, g.group_id, 'dynamic_tool', count(DISTINCT t.evidence_class) FROM g JOIN tool_results t ON t.repo = g.repo AND t.status = 'completed' GROUP BY ALL
              UNION ALL SELECT g.repo, g.group_id, 'repo_scan', count(DISTINCT l.lang) FROM g JOIN l ON l.repo = g.repo GROUP BY ALL)
            SELECT g.repo, g.group_id, s.strategy, coalesce(e.items, 0) AS items FROM g JOIN (VALUES {_values(STEPS)}) AS s(group_id, strategy) ON s.group_id = g.group_id LEFT JOIN e ON e.repo = g.repo AND e.group_id = g.group_id AND e.strategy = s.strategy""",
    }
