"""Paths as Columns: plain form, generated outputs, priority for reading, citation kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of build output and third-party code that a text search passes over.
GENERATED_DIRS = ("dist", "build", "target", "out", "coverage", ".next", ".nuxt", ".cache", "node_modules", "vendor", "bower_components", "jspm_packages")
#: Bundles of common frameworks.
BUNDLES = ("public/js/app.js", "public/js/vendor.js", "public/js/manifest.js", "public/css/app.css")
#: Names read first, and the bonus or malus of path beginnings and endings.
FIRST_NAMES = (
    "readme", "readme.md", "readme.rst", "license", "package.json", "requirements.txt", "pyproject.toml", "poetry.lock", "go.mod", "go.sum",
    "cargo.toml", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "makefile",
)
PREFIX_POINTS = (
    (("src/", "app/", "lib/", "pkg/", "cmd/", "internal/"), -18),
    (("tests/", "test/", "docs/", "scripts/", ".github/"), -10),
    (("sample_runs/", "summarized_reports/", "runs_", "notebooks/"), 20),
)
SUFFIX_POINTS = (((".md", ".txt", ".rst"), -4), ((".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".java", ".php", ".rb", ".rs"), -6))


def plain(path: Column) -> Column:
    """Forward slashes, without leading dots and slashes; null is empty."""
    return F.coalesce(F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", ""), F.lit(""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_build_output(path: Column) -> Column:
    """Whether a plain path is generated, bundled or minified output."""
    low = F.lower(path)
    return (
        F.arrays_overlap(segments(low), F.array(*[F.lit(d) for d in GENERATED_DIRS]))
        | low.rlike(r"^public/(build|dist)/")
        | low.endswith(".map")
        | low.rlike(r"\.(min|bundle|chunk)\.(js|css)$")
        | low.isin(*BUNDLES)
    )


def read_priority(path: Column) -> Column:
    """Points of a path with forward slashes; the fewer, the earlier it is read."""
    low = F.lower(path)
    parts = segments(low)
    any_of = lambda test, words: F.coalesce(sum((test(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    points = F.lit(100) + F.when(F.size(parts) == 1, -30).otherwise(0) + F.when(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).isin(*FIRST_NAMES), -25).otherwise(0)
    for words, p in PREFIX_POINTS:
        points = points + F.when(any_of(low.startswith, words), p).otherwise(0)
    for words, p in SUFFIX_POINTS:
        points = points + F.when(any_of(low.endswith, words), p).otherwise(0)
    return points


def citation_kind(citation: Column) -> Column:
    """Where a citation points: the first rule that fits, in this order."""
    c = F.trim(F.coalesce(citation, F.lit("")))
    return (
        F.when(c == "", "empty")
        .when(c.startswith("retrieval."), "retrieval")
        .when(c.startswith("activation_hint_evidence."), "activation_hint")
        .when(c.startswith("simal"), "simal")
        .when(c.startswith("dynamic_tools") | c.startswith("tool_summary"), "tool")
        .when(c.rlike(r":[^:]*[0-9][^:]*$"), "repo_line")
        .otherwise("other")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of whole paths: ** crosses directories, * and ? don't, [] are sets."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "_/-" else glob[i]), i + 1
    return f"^{out}$"
