"""Trees of files as rows: path, bytes, text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import segments

#: Directories that a walk passes over, and endings that are never or always text.
SKIPPED_DIRS = (".git", ".hg", ".svn", "node_modules", "dist", "build", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode")
NEVER_TEXT = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".exe", ".so", ".dll", ".woff", ".woff2", ".mp3", ".mp4", ".parquet")
ALWAYS_TEXT = (".py", ".js", ".ts", ".go", ".java", ".rb", ".rs", ".php", ".c", ".h", ".cpp", ".md", ".txt", ".rst", ".json", ".yml", ".yaml", ".toml", ".xml", ".html", ".css", ".sql", ".sh", ".ini", ".cfg")


def read_tree(spark: SparkSession, root: str, skipped: Sequence[str] = SKIPPED_DIRS, most_bytes: int = 512_000) -> DataFrame:
    """The files below a folder: path relative to it, length, and the first bytes of the content.

    Only parts below the folder count against the skipped directories. Paths are filtered before any content is
    read; rows come in no order, so whoever cuts them must sort by path first. Empty files give no row, since the
    binary source has no split for them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z0-9]+:(//[^/]*)?(?=/)", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    rows = raw.select(path.alias("path"), "length", F.substring("content", 1, most_bytes).alias("content"))
    return rows.where(~F.arrays_overlap(segments(F.col("path")), F.array(*[F.lit(d) for d in skipped])))


def looks_binary(text: Column) -> Column:
    """Whether a text holds a NUL, or more than one in fifty characters of it are control characters."""
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.coalesce(F.contains(text, F.lit("\x00")) | (controls > 0.02 * F.length(text)), F.lit(False))


def with_text(files: DataFrame, probe: int = 2048) -> DataFrame:
    """Adds `text`: the content as UTF-8 with replacements, or null if the file is no text.

    Endings decide where they can; else the first bytes must hold no NUL and be UTF-8, of which a character cut
    off at the end of the probe is forgiven. Empty files are empty texts.
    """

    @F.pandas_udf("string")
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in batches:
            yield pd.Series([_decode(p, c, probe) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return files.withColumn("text", decode("path", "content"))


def _decode(path: str, content: bytes | None, probe: int) -> str | None:
    low = path.lower()
    if content is None or low.endswith(NEVER_TEXT):
        return None
    if not low.endswith(ALWAYS_TEXT):
        start = content[:probe]
        if b"\x00" in start:
            return None
        try:
            start.decode("utf-8")
        except UnicodeDecodeError as e:
            if e.start < len(start) - 3:
                return None
    return content.decode("utf-8", "replace")
