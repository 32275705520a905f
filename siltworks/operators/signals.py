"""What a repository's files tell about it: languages, layout, versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The language of each file ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".php": "php", ".rb": "ruby", ".rs": "rust",
    ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".dart": "dart",
    ".mjs": "javascript", ".cjs": "javascript", ".kts": "kotlin", ".cc": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hxx": "cpp",
}


def language(path: Column) -> Column:
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ending == e, name).otherwise(out)
    return out


def infer(files: DataFrame, key: str, path: str, tests: Mapping[str, str]) -> DataFrame:
    """Per key its files, sorted languages, and one flag per test: whether any path matches the pattern."""
    low = F.lower(F.col(path))
    return files.groupBy(key).agg(
        F.count_distinct(path).alias("files"), F.array_join(F.array_sort(F.collect_set(language(F.col(path)))), ",").alias("languages"),
        *[F.bool_or(low.rlike(p)).alias(name) for name, p in tests.items()],
    )


def pick_versions(files: DataFrame, key: str, path: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Per key the version that the first fitting rule finds, from the shallowest path, then the least path."""
    found = F.array_compact(F.array(*[F.when(F.regexp_extract(text, p, 1) != "", F.struct(F.lit(i).alias("rule"), F.lit(n).alias("source"), F.regexp_extract(text, p, 1).alias("version"))) for i, (n, p) in enumerate(rules)]))
    each = files.where(F.col(text).isNotNull()).select(key, path, F.explode(found).alias("f"))
    depth = F.size(F.split(path, "/"))
    return each.groupBy(key).agg(F.min(F.struct("f.rule", depth.alias("depth"), F.col(path).alias("path"), "f.source", "f.version")).alias("m")).select(key, "m.source", "m.version", "m.path")
