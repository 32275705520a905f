"""Evidence for the groups of a rubric: files by hint, tools by language, runs, dumps, and what was left out and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.paths import is_build_output, segments
from siltworks.functions.text import looks_minified

#: Directories whose files no dump takes.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "dist", "build", ".idea", ".vscode", "css", "include",
    "vendor", "vendors", "libs", "lib", "third_party", "third-party", "site-packages", ".next", ".nuxt", ".angular", ".cache", "public", "static", "target", "out", ".gradle",
    ".husky", ".pnpm", "jspm_packages", "bower_components", "coverage", "htmlcov", ".tox", ".nox", ".terraform", ".serverless", ".aws-sam", ".eggs",
)
#: Files that tell of a repository's tools and versions.
MANIFESTS = (
    ".python-version", ".tool-versions", "runtime.txt", "pyproject.toml", "setup.cfg", "requirements.txt", "setup.py", "Pipfile", "tox.ini",
    ".nvmrc", ".node-version", "package.json", "yarn.lock", "package-lock.json", "pnpm-lock.yaml", "tsconfig.json", "go.mod", "composer.json",
)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def skip_reason(path: Column, text: Column, prefixes: Sequence[str] = ()) -> Column:
    """The first reason for which a dump leaves a file out; null if it takes it. `path` is in plain form."""
    parents = F.filter(segments(F.regexp_replace(path, r"[^/]*$", "")), lambda s: s != "")
    ignored = F.arrays_overlap(parents, F.array(*[F.lit(d) for d in IGNORED_DIRS]))
    for p in prefixes:
        ignored = ignored | path.startswith(p)
    return (
        F.when((path == "") | is_build_output(path) | ignored, "generated_path")
        .when(F.lower(path).rlike(r"\.min\.(js|css)$"), "ignored_name_or_ext")
        .when(text.isNull() | ~text.rlike(r"\S"), "empty")
        .when(looks_minified(text), "minified_or_generated_content")
    )


def dump_cut(files: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, most_items: int, budget: int) -> DataFrame:
    """Per group the first items within the budget, the last of them cut to what is left: adds `place` and `taken`."""
    first = files.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most_items)
    before = F.coalesce(F.sum(F.col(size).cast("bigint")).over(Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("__left", F.lit(budget) - before).where(F.col("__left") > 0).withColumn("taken", F.least(F.col(size).cast("bigint"), "__left")).drop("__left")


def shallowest(files: DataFrame, key: str, path: str, names: Sequence[str] = MANIFESTS) -> DataFrame:
    """Per key and manifest name the path with the fewest parts, then the least, and how many there are."""
    at = F.struct(F.size(segments(F.col(path))).alias("depth"), F.col(path).alias("path"))
    named = files.select(key, path, base_name(F.col(path)).alias("name")).where(F.col("name").isin(*names))
    return named.groupBy(key, "name").agg(F.min(at).alias("m"), F.count_distinct(path).alias("paths")).select(key, "name", "m.path", "m.depth", "paths")


def safe_path(value: Column) -> Column:
    """A path below the repository in plain form; null if it is empty or leads out of it."""
    rel = F.regexp_replace(F.translate(F.trim(value), "\\", "/"), r"^(\./)+", "")
    rel = F.regexp_replace(rel, r"^/+", "")
    return F.when((rel != "") & ~rel.rlike(r"(^|/)\.\.(/|$)"), rel)


def glob_tail(glob: Column) -> Column:
    """A glob as a regular expression for the last parts of a path: * and ? stay within a part, all else stands for itself."""
    plain = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(^|/)"), F.replace(F.regexp_replace(plain, r"\*+", "[^/]*"), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def hint_match(path: Column, kind: Column, hint: Column) -> Column:
    """How a path is what a hint asks for: equal, below (a directory), glob; null if it isn't."""
    return (
        F.when((kind == "path") & (path == hint), "equal")
        .when((kind == "path") & path.startswith(F.concat(F.regexp_replace(hint, r"/+$", ""), F.lit("/"))), "below")
        .when((kind == "glob") & F.expr("true") & F.coalesce(F.regexp_like(path, glob_tail(hint)), F.lit(False)), "glob")
    )


def patched(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `base` with those of `patch` over them: a non-null field of the patch counts, new keys are added."""
    fields = [c for c in base.columns if c not in keys]
    b, p = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in fields]), patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in fields])
    return b.join(p, list(keys), "full").select(*keys, *[F.coalesce(f"__p_{c}", f"__b_{c}").alias(c) for c in fields])


def tool_candidates(languages: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """Per key and evidence class the tools for its languages and those for any: by priority, own languages first, then name.

    `languages` has a row per key and language, `specs` evidence_class, lang, tool and priority.
    """
    own = languages.select(key, "lang").distinct().withColumn("own", F.lit(1))
    wanted = own.unionByName(languages.select(key).distinct().select(key, F.lit("any").alias("lang"), F.lit(0).alias("own")))
    best = wanted.join(specs, "lang").groupBy(key, "evidence_class", "tool").agg(F.max(F.struct("priority", "own")).alias("m"))
    place = F.row_number().over(Window.partitionBy(key, "evidence_class").orderBy(F.desc("m.priority"), F.desc("m.own"), "tool"))
    return best.select(key, "evidence_class", "tool", F.col("m.priority").alias("priority"), place.alias("place"))


def first_evidence(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the tool and run that completed first; later ones don't replace it. One aggregation, combined on the map side."""
    at = F.struct(F.col("started_at").isNull(), "started_at", "run_id")
    return runs.where("status = 'completed'").groupBy(*keys).agg(F.min_by("tool", at).alias("tool"), F.min_by("run_id", at).alias("run_id"))


def report_state(status: Column, total: Column, shown: int) -> Column:
    """STRUCT<state, included, complete> of a run's report of so many findings, of which at most `shown` are included."""
    ok = status == "completed"
    return F.struct(
        F.when(ok, "ok").otherwise("unavailable").alias("state"), F.when(ok, F.least(total, F.lit(shown))).otherwise(0).cast("bigint").alias("included"), (ok & (total <= shown)).alias("complete")
    )


def first_object(text: Column) -> Column:
    """The JSON object in an answer: within a fence, else the whole, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text))
    cut = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    parsed = lambda x: F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$"))
    return F.coalesce(parsed(body), parsed(cut))


def text_list(values: Column) -> Column:
    """Texts without blanks around them, without null and empty ones."""
    return F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v.isNotNull() & (v != ""))


def bundle_rows(files: DataFrame, runs: DataFrame, steps: DataFrame, languages: DataFrame, most_files: int = 20) -> DataFrame:
    """Evidence per repository and group: repo, group_id, strategy, items.

    `steps` says which strategies a group's profile has. Files are those that hints ask for, by priority, within a
    budget of files that all hints of a group share; tools are the classes with a completed run; scans the languages.
    Files are ranked after a cut on the map side, so a hot group is no single task's.
    """
    order = [F.desc("hint_priority"), F.col("path"), F.col("file_id")]
    matched = files.where(hint_match(F.col("path"), F.col("hint_type"), safe_path(F.col("hint_value"))).isNotNull() & F.col("group_id").isNotNull())
    taken = matched.withColumn("n", F.row_number().over(Window.partitionBy("repo", "group_id").orderBy(*order))).where(F.col("n") <= most_files)
    by_file = taken.groupBy("repo", "group_id").agg(F.count("*").alias("items")).withColumn("strategy", F.lit("file_match"))
    groups = files.where("group_id IS NOT NULL").select("repo", "group_id").distinct()
    tools = runs.where("status = 'completed'").groupBy("repo").agg(F.count_distinct("evidence_class").alias("items")).withColumn("strategy", F.lit("dynamic_tool"))
    scans = languages.groupBy("repo").agg(F.count_distinct("lang").alias("items")).withColumn("strategy", F.lit("repo_scan"))
    every = by_file.unionByName(groups.join(tools.unionByName(scans), "repo"))
    return groups.join(steps, "group_id").join(every, ["repo", "group_id", "strategy"], "left").fillna(0, ["items"]).select("repo", "group_id", "strategy", "items")
