"""Queries on paths, texts and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import paths as P
from siltworks.functions import text as X
from siltworks.operators import evidence as E
from siltworks.operators import search as S
from siltworks.operators import signals as G
from siltworks.session import table, widen_first

QUERIES = ("retry", "logger\\.", "eval(", "assert |raise ", "import .*worker", "TODO")
GLOBS = ("src/**/*.py", "**/*.md", "deploy/*", "**/.env*", "config/*_[0-9]*.js", "docs/**", "cmd/?????.go")
SIGNALS = {"has_tests": r"(^|/)tests?/", "has_docs": r"(^|/)docs/", "has_deploy": r"^deploy/", "has_container": r"dockerfile", "has_sql": r"\.sql$", "has_env": r"(^|/)\.?env(\.|$)"}
VERSIONS = (("lockfile", r"(?m)^lockfile: (\d+)"), ("module", r"__version__ = ['\"](\d+\.\d+)"), ("banner", r"^/\*! \w+ v(\d+\.\d+)"), ("map", r"^\{\"version\":(\d+)"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_files").select("file_id", "repo", P.plain(F.col("path")).alias("path"), "content")


def minified_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", X.looks_minified(F.col("content")).alias("minified"), F.size(X.lines(F.col("content"))).alias("lines"))


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", "path", P.is_build_output(F.col("path")).alias("build_output"))


def path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", P.read_priority(F.col("path")).alias("priority"), F.size(P.segments(F.col("path"))).alias("depth"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    able = ~P.is_build_output(F.col("path")) & S.may_match(spark, F.col("content"), QUERIES)
    files = widen_first(_files(spark, sf_dir)).where(able).where(~X.looks_minified(F.col("content")))
    return S.occurrences(S.file_lines(files, "file_id", "content"), "file_id", QUERIES)


def code_search_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def code_search_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.windows(_found(spark, sf_dir), "file_id").withColumn("queries", F.array_join("queries", " ; ")).drop("focus")


def code_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows of every repository, none above 12 lines: by distinct queries, then files that their own hint
    asks for, matches, path from the end, and start."""
    files = table(spark, sf_dir, "loaded_files").select("file_id", "repo", P.plain(F.col("path")).alias("path"), "hint_type", E.safe_path(F.col("hint_value")).alias("hint"), F.size(X.lines(F.col("content"))).alias("size"))
    w = S.cap_windows(S.windows(_found(spark, sf_dir), "file_id"), files, "file_id", 12)
    w = w.join(files.select("file_id", "repo", "path", E.hint_match(F.col("path"), F.col("hint_type"), F.col("hint")).isNotNull().alias("hinted")), "file_id")
    order = [F.size("queries").desc(), F.desc("hinted"), F.desc("matches"), F.desc("path"), F.col("start"), F.col("file_id")]
    best = w.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where("place <= 20")
    return best.select("repo", "file_id", "start", "end", "focus", "matches", "hinted", "place")


def code_search_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.windows(_found(spark, sf_dir), "file_id").join(_files(spark, sf_dir).select("file_id", "repo"), "file_id")
    return S.best_windows(found, ["repo"], "file_id", 3, 20).select("repo", "file_id", "start", "end", "matches", F.array_join("queries", " ; ").alias("queries"), "place")


def dump_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each repository that are read first, up to 60,000 characters."""
    files = _files(spark, sf_dir).where(~P.is_build_output(F.col("path"))).select("repo", "file_id", "path", P.read_priority(F.col("path")).alias("priority"), F.size(P.segments(F.col("path"))).alias("depth"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"))
    return S.within_budget(files, ["repo"], [F.col("priority"), F.col("depth"), F.col("path"), F.col("file_id")], "chars", 180, 60_000)


def glob_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.glob_coverage(_files(spark, sf_dir), "repo", "path", GLOBS)


def snippet_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that are the same but for case and blanks."""
    q = table(spark, sf_dir, "leaf_definitions").select("leaf_key", X.fingerprint(F.col("question")).alias("fingerprint"))
    return q.groupBy("fingerprint").agg(F.min("leaf_key").alias("leaf_key"), F.count("*").alias("copies"))


def signals_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.infer(_files(spark, sf_dir), "repo", "path", SIGNALS)


def version_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pick_versions(_files(spark, sf_dir), "repo", "path", "content", VERSIONS)


def citation_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many citations of a file in a repository share lines with each."""
    leaves = table(spark, sf_dir, "group_results").select("repo", F.explode("leaf_results").alias("r")).where("r IS NOT NULL")
    cited = leaves.select("repo", F.explode("r.citations").alias("citation")).where("citation IS NOT NULL")
    return S.overlap_counts(S.citation_intervals(cited), ["repo", "path"], "citation")


_F = "f AS (SELECT file_id, repo, coalesce(ltrim(replace(path, '\\', '/'), './'), '') AS path, content FROM loaded_files)"
_L = r"""CASE WHEN content = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(content, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END"""
_SEG = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_BUILD = (
    f"(list_has_any(string_split(lower(path), '/'), [{', '.join(repr(d) for d in P.GENERATED_DIRS)}]) OR regexp_matches(lower(path), '^public/(build|dist)/') OR ends_with(lower(path), '.map')"
    rf" OR regexp_matches(lower(path), '\.(min|bundle|chunk)\.(js|css)$') OR lower(path) IN ({', '.join(repr(b) for b in P.BUNDLES)}))"
)
_MIN = f"""s AS (SELECT *, {_L} AS ls FROM f), m AS (SELECT *, coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) AS mx, coalesce(list_sum(list_transform(ls, lambda l: length(l))), 0) / greatest(len(ls), 1) AS av,
  coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) / greatest(length(content), 1) AS sh FROM s),
n AS (SELECT *, coalesce(len(ls) > 0 AND (mx >= 3000 OR (mx >= 1500 AND av >= 400) OR (len(ls) <= 5 AND av >= 500) OR (len(ls) <= 12 AND av >= 350 AND sh >= 0.6) OR (sh >= 0.85 AND mx >= 1200)), false) AS minified FROM m)"""


def _priority_sql() -> str:
    starts = lambda ws: "(" + " OR ".join(f"starts_with(lower(path), '{w}')" for w in ws) + ")"
    ends = lambda ws: "(" + " OR ".join(f"ends_with(lower(path), '{w}')" for w in ws) + ")"
    return (
        f"(100 + CASE WHEN len({_SEG}) = 1 THEN -30 ELSE 0 END + CASE WHEN coalesce(lower({_SEG}[-1]), '') IN ({', '.join(repr(n) for n in P.FIRST_NAMES)}) THEN -25 ELSE 0 END + "
        + " + ".join([f"CASE WHEN {starts(w)} THEN {p} ELSE 0 END" for w, p in P.PREFIX_POINTS] + [f"CASE WHEN {ends(w)} THEN {p} ELSE 0 END" for w, p in P.SUFFIX_POINTS])
        + ")"
    )


def _occurrence_sql() -> str:
    pats = {q: q for q in QUERIES} | {"eval(": "eval\\("}
    q = ", ".join("({}, {})".format("'" + a.replace("'", "''") + "'", "'(?i)" + b.replace("'", "''") + "'") for a, b in pats.items())
    return f"""WITH {_F}, {_MIN}, l AS (SELECT file_id, repo, i AS line_no, ls[i] AS line FROM (SELECT file_id, repo, ls, unnest(range(1, len(ls) + 1)) AS i FROM n WHERE NOT minified AND NOT {_BUILD})),
        o AS (SELECT file_id, repo, line_no::INT AS line_no, q.query FROM l, (VALUES {q}) AS q(query, pat) WHERE regexp_matches(line, pat))"""


_ISLANDS = """, a AS (SELECT *, greatest(1, line_no - 3) AS s, line_no + 3 AS e FROM o), b AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e, query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a),
  c AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e, query ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS island FROM b),
  w AS (SELECT file_id, any_value(repo) AS repo, island, min(s) AS start, max(e) AS "end", count(*) AS matches, list_sort(list(DISTINCT query)) AS qs, count(DISTINCT line_no) AS lines FROM c GROUP BY file_id, island)"""


_SAFE = r"regexp_replace(regexp_replace(replace(trim(hint_value), '\', '/'), '^(\./)+', ''), '^/+', '')"
HINT_SQL = rf"CASE WHEN {_SAFE} <> '' AND NOT regexp_matches({_SAFE}, '(^|/)\.\.(/|$)') THEN {_SAFE} END"
_TAIL = r"'(^|/)' || replace(regexp_replace(regexp_replace(hint, '([.+^$(){}|\[\]\\])', '\\\1', 'g'), '\*+', '[^/]*', 'g'), '?', '[^/]') || '$'"
MATCH_SQL = f"""CASE WHEN hint_type = 'path' AND p = hint THEN 'equal' WHEN hint_type = 'path' AND starts_with(p, rtrim(hint, '/') || '/') THEN 'below' WHEN hint_type = 'glob' AND regexp_matches(p, {_TAIL}) THEN 'glob' END"""


def queries() -> dict:
    names = (minified_filter, path_filter, path_priority, code_search_occurrences, code_search_islands, code_search_selected, code_search_capped, dump_prefix, glob_coverage, snippet_dedupe, signals_by_repo, version_pick, citation_overlaps)
    return {q.__name__: q for q in names}


def oracle_sql() -> dict:
    ext = r"regexp_extract(lower(path), '(\.[^./]+)$', 1)"
    lang = f"CASE {ext} " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in G.LANGUAGES.items()) + " END"
    flags = ", ".join(f"bool_or(regexp_matches(lower(path), '{p}')) AS {n}" for n, p in SIGNALS.items())
    globs = ", ".join("({}, {})".format("'" + g + "'", "'" + P.glob_pattern(g) + "'") for g in GLOBS)
    ver = " UNION ALL ".join("SELECT repo, path, {} AS rule, '{}' AS source, regexp_extract(content, '{}', 1) AS version FROM f".format(i, n, p.replace("'", "''")) for i, (n, p) in enumerate(VERSIONS))
    return {
        "minified_filter": f"WITH {_F}, {_MIN} SELECT file_id, minified, len(ls)::INT AS lines FROM n",
        "path_filter": f"WITH {_F} SELECT file_id, path, {_BUILD} AS build_output FROM f",
        "path_priority": f"WITH {_F} SELECT file_id, {_priority_sql()} AS priority, len({_SEG})::INT AS depth FROM f",
        "code_search_occurrences": _occurrence_sql() + " SELECT file_id, line_no, query FROM o",
        "code_search_islands": _occurrence_sql() + _ISLANDS + " SELECT file_id, island, start, \"end\", matches, array_to_string(qs, ' ; ') AS queries, lines FROM w",
        "code_search_selected": _occurrence_sql() + _ISLANDS + """, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY len(qs) DESC, matches DESC, start) AS n FROM w),
            t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY len(qs) DESC, matches DESC, file_id, start) AS place FROM p WHERE n <= 3)
            SELECT repo, file_id, start, "end", matches, array_to_string(qs, ' ; ') AS queries, place FROM t WHERE place <= 20""",
        "code_search_capped": _occurrence_sql() + _ISLANDS + rf""", z AS (SELECT file_id, island, list_sort(list(DISTINCT line_no)) AS ms FROM c GROUP BY file_id, island),
            x AS (SELECT w.*, z.ms[len(z.ms) // 2 + 1] AS focus, len(n.ls)::INT AS size, n.path AS p FROM w JOIN z ON z.file_id = w.file_id AND z.island = w.island JOIN n ON n.file_id = w.file_id),
            y AS (SELECT *, greatest(1, focus - 6) AS bg FROM x), k AS (SELECT file_id, repo, qs, matches, focus, p,
              CASE WHEN "end" - start + 1 <= 12 THEN start WHEN bg + 11 > size THEN greatest(1, size - 11) ELSE bg END AS start, CASE WHEN "end" - start + 1 <= 12 THEN "end" WHEN bg + 11 > size THEN size ELSE bg + 11 END AS "end" FROM y),
            h AS (SELECT file_id, hint_type, {HINT_SQL} AS hint FROM loaded_files), j AS (SELECT k.*, {MATCH_SQL} IS NOT NULL AS hinted FROM k JOIN h ON h.file_id = k.file_id),
            t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY len(qs) DESC, hinted DESC, matches DESC, p DESC, start, file_id) AS place FROM j)
            SELECT repo, file_id, start::INT AS start, "end"::INT AS "end", focus, matches, hinted, place FROM t WHERE place <= 20""",
        "dump_prefix": f"""WITH {_F}, p AS (SELECT repo, file_id, path, {_priority_sql()} AS priority, len({_SEG})::INT AS depth, coalesce(length(content), 0)::INT AS chars FROM f WHERE NOT {_BUILD}),
            r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, depth, path, file_id) AS place FROM p), u AS (SELECT *, sum(chars) OVER (PARTITION BY repo ORDER BY place)::BIGINT AS upto FROM r WHERE place <= 180) SELECT * FROM u WHERE upto <= 60000""",
        "glob_coverage": f"""WITH {_F}, g AS (SELECT * FROM (VALUES {globs}) AS v(pattern, pat)), h AS (SELECT repo, pattern, count(DISTINCT path) AS matches, min(path) AS first FROM f, g WHERE regexp_matches(path, pat) GROUP BY 1, 2)
            SELECT e.repo, e.pattern, coalesce(h.matches, 0) AS matches, h.first FROM (SELECT DISTINCT repo, pattern FROM f, g) e LEFT JOIN h ON h.repo IS NOT DISTINCT FROM e.repo AND h.pattern = e.pattern""",
        "snippet_dedupe": r"SELECT regexp_replace(regexp_replace(lower(coalesce(question, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS fingerprint, min(leaf_key) AS leaf_key, count(*) AS copies FROM leaf_definitions GROUP BY 1",
        "signals_by_repo": f"WITH {_F} SELECT repo, count(DISTINCT path) AS files, coalesce(array_to_string(list_sort(list(DISTINCT {lang}) FILTER ({lang} IS NOT NULL)), ','), '') AS languages, {flags} FROM f GROUP BY repo",
        "version_pick": f"WITH {_F}, v AS ({ver}), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rule, len(string_split(path, '/')), path, source, version) AS n FROM v WHERE version <> '') SELECT repo, source, version, path FROM r WHERE n = 1",
        "citation_overlaps": r"""WITH l AS (SELECT repo, unnest(leaf_results) AS r FROM group_results), c0 AS (SELECT DISTINCT repo, unnest(r.citations) AS citation FROM l WHERE r IS NOT NULL),
            c AS (SELECT repo, citation, regexp_extract(citation, '^(.+):(\d{1,9})(?:-(\d{1,9}))?$', 1) AS path, regexp_extract(citation, '^(.+):(\d{1,9})(?:-(\d{1,9}))?$', 2)::INT AS low,
              greatest(regexp_extract(citation, '^(.+):(\d{1,9})(?:-(\d{1,9}))?$', 2)::INT, coalesce(nullif(regexp_extract(citation, '^(.+):(\d{1,9})(?:-(\d{1,9}))?$', 3), ''), '0')::INT) AS high
              FROM c0 WHERE regexp_matches(citation, '^(.+):(\d{1,9})(?:-(\d{1,9}))?$'))
            SELECT a.repo, a.path, a.citation, count(*) AS overlaps FROM c a JOIN c b ON b.repo IS NOT DISTINCT FROM a.repo AND b.path = a.path AND b.low <= a.high AND b.high >= a.low GROUP BY ALL""",
    }
