"""Text search by line: occurrences, merged windows, ranked snippets, budgets, coverage of globs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions.paths import glob_pattern
from siltworks.functions.text import lines


def valid_patterns(spark: SparkSession, queries: Sequence[str]) -> dict[str, str]:
    """Each query as a regular expression; one that is none stands for its own letters. No job is run for it."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    out = {}
    for q in queries:
        try:
            compile_(q)
            out[q] = q
        except PySparkException:
            out[q] = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in q)
    return out


def may_match(spark: SparkSession, text: Column, queries: Sequence[str]) -> Column:
    """Whether some line of the text can match a query: a test of the whole text, made before it is split into lines."""
    patterns = valid_patterns(spark, queries).values()
    if any(re.search(r"\\[AZzG]|\(\?<?[!=]", p) for p in patterns):  # these look beyond a line
        return F.lit(True)
    return text.rlike("(?im)" + "|".join(f"(?:{p})" for p in patterns))


def file_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, line_no from 1, line. Null texts have none."""
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(lines(F.col(text))).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def occurrences(numbered: DataFrame, key: str, queries: Sequence[str]) -> DataFrame:
    """One row per line and query that it matches (key, line_no, query); all queries are tried in one pass."""
    patterns = valid_patterns(numbered.sparkSession, queries)
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike("(?i)" + p), F.lit(q)) for q, p in patterns.items()]))
    return numbered.select(key, "line_no", hit.alias("hits")).where(F.size("hits") > 0).select(key, "line_no", F.explode("hits").alias("query"))


def windows(found: DataFrame, key: str, context: int = 3, distance: int = 10) -> DataFrame:
    """Occurrences with context lines merged into windows: key, start, end, matches, queries (sorted), lines matched, and
    the focus, the upper median of the lines matched.

    Two windows are one if the later starts at most `distance` lines after the end of all earlier ones. Windows
    stay within a file, whose lines bound the work of a task.
    """
    at = found.select(key, "line_no", "query", F.greatest(F.lit(1), F.col("line_no") - context).alias("start"), (F.col("line_no") + context).alias("end"))
    order = Window.partitionBy(key).orderBy("start", "end", "query")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = at.withColumn("new", F.when(before.isNull() | (F.col("start") > before + distance), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("matches"), F.array_sort(F.collect_set("query")).alias("queries"), F.count_distinct("line_no").alias("lines"),
        F.get(F.sort_array(F.collect_set("line_no")), F.floor(F.count_distinct("line_no") / 2).cast("int")).alias("focus"),
    )


def cap_windows(found: DataFrame, sizes: DataFrame, key: str, most: int) -> DataFrame:
    """Windows of at most so many lines: longer ones are centred on their focus, and moved back from the text's end.

    `sizes` has each key's number of lines as `size`. With `most` of 0 or less nothing is capped.
    """
    w = found.join(sizes.select(key, "size"), key)
    if most <= 0:
        return w.drop("size")
    long = F.col("end") - F.col("start") + 1 > most
    begin = F.greatest(F.lit(1), F.col("focus") - most // 2)
    over = begin + most - 1 > F.col("size")
    start = F.when(over, F.greatest(F.lit(1), F.col("size") - most + 1)).otherwise(begin)
    end = F.when(over, F.col("size")).otherwise(begin + most - 1)
    return w.select(*[(F.when(long, {"start": start, "end": end}[c]).otherwise(F.col(c)) if c in ("start", "end") else F.col(c)).alias(c) for c in found.columns])


def best_windows(found: DataFrame, group: Sequence[str], key: str, per_file: int, total: int) -> DataFrame:
    """Per group the best windows: most distinct queries, then matches, then key and start; quotas per file and in all."""
    order = [F.size("queries").desc(), F.desc("matches"), F.col(key), F.col("start")]
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).where(F.col("n") <= per_file)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= total).drop("n")


def within_budget(items: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, most_items: int, budget: int) -> DataFrame:
    """Per group the first items whose sizes together stay within the budget; adds `place` and `upto`.

    At most `most_items` are taken of a group: the rest is left before the sums are made, so no task sees more.
    """
    first = items.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most_items)
    upto = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("upto", F.sum(F.col(size).cast("bigint")).over(upto)).where(F.col("upto") <= budget)


def glob_coverage(files: DataFrame, group: str, path: str, globs: Sequence[str]) -> DataFrame:
    """Per group and glob how many distinct paths match, and the first of them; globs without a match have 0."""
    hit = F.array_compact(F.array(*[F.when(F.col(path).rlike(glob_pattern(g)), F.lit(g)) for g in globs]))
    found = files.select(group, path, F.explode(hit).alias("pattern")).distinct().groupBy(group, "pattern").agg(F.count("*").alias("matches"), F.min(path).alias("first"))
    every = files.select(group).distinct().select(group, F.explode(F.array(*[F.lit(g) for g in globs])).alias("pattern"))
    return every.join(found, [group, "pattern"], "left").fillna(0, ["matches"])


def _running(points: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums of points (keys, at and counts) up to each place (`name`) and before it (`name_before`).

    Points are summed by place first, on the map side, so a window holds the places of its key and not its rows.
    """
    by = points.groupBy(*keys, "at").agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in sums])
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by.select(*keys, "at", *[F.sum(c).over(upto).alias(c) for c in sums], *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before") for c in sums])


def _at(rows: DataFrame, running: DataFrame, keys: Sequence[str], place: str, column: str, name: str) -> DataFrame:
    """The rows with a running sum at the place that one of their columns names, null keys being equal."""
    r = running.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("__at"), F.col(column).alias(name))
    same = F.col(place) == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(r, same).drop("__at", *[f"__{k}" for k in keys])


def findings_in_citations(citations: DataFrame, findings: DataFrame) -> DataFrame:
    """Per citation `path:from-to` of a repository how many findings lie in its lines, and in how many lines.

    Findings are counted per line; running sums over the lines and the citations' ends of a file give each citation
    the difference of two sums, so no citation meets the lines of its file one by one. Citations without any are left out.
    """
    keys = ["repo", "path"]
    c = citation_intervals(citations)
    found = findings.where("line IS NOT NULL").groupBy(*keys, F.col("line").alias("at")).agg(F.count("*").alias("n")).withColumn("held", F.lit(1))
    ends = c.select(*keys, F.explode(F.array("low", "high")).alias("at")).withColumns({"n": F.lit(0).cast("bigint"), "held": F.lit(0)})
    run = _running(found.unionByName(ends), keys, ["n", "held"])
    for place, column, name in (("high", "n", "a"), ("high", "held", "b"), ("low", "n_before", "x"), ("low", "held_before", "y")):
        c = _at(c, run, keys, place, column, name)
    return c.select("repo", "citation", (F.col("a") - F.col("x")).alias("findings"), (F.col("b") - F.col("y")).alias("lines")).where("findings > 0")


def citation_intervals(citations: DataFrame) -> DataFrame:
    """Distinct citations ``path:from`` or ``path:from-to`` of a repository as (repo, citation, path, low, high); others are left out."""
    g = lambda i: F.regexp_extract(F.col("citation"), r"^(.+):(\d{1,9})(?:-(\d{1,9}))?$", i)
    high = F.when(g(3) != "", g(3)).otherwise(g(2))
    return citations.where(g(0) != "").select("repo", "citation", g(1).alias("path"), g(2).cast("int").alias("low"), high.cast("int").alias("high")).distinct()


def overlap_counts(intervals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Per closed interval [low, high] how many of its key's intervals, itself included, share a point with it.

    Those that begin by its end, less those that end before its beginning: running sums over the distinct places of a
    key, so the work grows with the intervals and not with their pairs, and a key of many intervals is many rows of
    the joins and few of the window. An interval that ends before it begins counts as one that begins and ends at `low`.
    """
    i = intervals.withColumn("high", F.greatest("low", "high")).select(*keys, name, "low", "high")
    point = lambda c, begun: i.select(*keys, F.col(c).alias("at"), F.lit(begun).alias("begun"), F.lit(1 - begun).alias("ended"))
    run = _running(point("low", 1).unionByName(point("high", 0)), keys, ["begun", "ended"])
    both = _at(_at(i, run, keys, "high", "begun", "__begun"), run, keys, "low", "ended_before", "__ended")
    return both.select(*keys, name, (F.col("__begun") - F.col("__ended")).alias("overlaps"))


def schema_search(docs: DataFrame, key: str, text: str, queries: Sequence[str], context: int = 2, per_query: int = 20, most: int = 25, most_chars: int = 2_000) -> DataFrame:
    """Windows of one text a row that hold the queries, merged twice: within each query, then across them.

    Of each query the first `per_query` windows count. Then windows in order of their start are given out until
    there are `most` or the next would exceed `most_chars`; the first always comes. A window ends at the text's end.
    """
    numbered = file_lines(docs, key, text)
    found = occurrences(numbered, key, queries)
    own = Window.partitionBy(key, "query")
    at = found.select(key, "query", "line_no", F.greatest(F.lit(1), F.col("line_no") - context).alias("start"), (F.col("line_no") + context).alias("end"))
    first = _merge(at, [key, "query"], 1).withColumn("n", F.row_number().over(own.orderBy("start"))).where(F.col("n") <= per_query)
    merged = _merge(first.select(key, "query", "start", "end", "matches"), [key], 1)
    sizes = docs.where(F.col(text).isNotNull()).select(key, F.transform(lines(F.col(text)), F.length).alias("sizes"))
    w = merged.join(sizes, key).withColumn("end", F.least("end", F.size("sizes")))
    chars = F.aggregate(F.slice("sizes", F.col("start"), F.col("end") - F.col("start") + 1), F.lit(0), lambda a, x: a + x) + F.col("end") - F.col("start")
    order = Window.partitionBy(key).orderBy("start")
    w = w.withColumns({"chars": chars, "place": F.row_number().over(order)})
    over = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) > most_chars
    stopped = F.max(F.when((F.col("place") > 1) & F.col("over"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumn("over", over).withColumn("stopped", stopped).where((F.col("stopped") == 0) & (F.col("place") <= most)).select(key, "place", "start", "end", "matches", "queries", "chars")


def _merge(at: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """Closed intervals merged within keys: start, end, matches, queries (sorted)."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "query")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = at.withColumn("__new", F.when(before.isNull() | (F.col("start") > before + distance), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum("matches") if "matches" in at.columns else F.count("*")
    return island.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), n.alias("matches"), F.array_sort(F.collect_set(F.col("query"))).alias("queries")).drop("__island")
