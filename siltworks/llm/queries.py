"""The registered queries of the training-data operators, and the SQL that some are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.authored import not_typed
from siltworks.llm.credentials import find_credentials, redact, step_report
from siltworks.llm.mixing import clean_source, draw_plan, systematic_copies
from siltworks.llm.mojibake import repair_encoding
from siltworks.llm.packing import fill_report, items_of, pack, placement_report
from siltworks.llm.subjects import assign, document_words, fit
from siltworks.llm.tokens import token_count
from siltworks.llm.topn import skip_report, top_n_per_group
from siltworks.session import materialize, table, widen

#: The rank of each severity word.
SEVERITY_RANK = {"critical": 5, "high": 4, "error": 4, "medium": 3, "warning": 3, "low": 2, "info": 1, "note": 1}


def severity_rank(severity: Column) -> Column:
    word = F.lower(F.regexp_replace(severity, r"^\s+|\s+$", ""))
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(word, F.lit(""))), F.lit(0))


def plain_path(path: Column) -> Column:
    """Forward slashes, without leading dots and slashes; null is empty."""
    return F.coalesce(F.regexp_replace(F.translate(path, "\\", "/"), r"^[./]+", ""), F.lit(""))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per finding of a file: deliveries equal in tool, rule, line and message are one, led by the least id.

    Files and deliveries are told apart by 128 bits of hash each, so names and messages aren't shuffled.
    """
    hashed = lambda *c: [F.xxhash64(F.lit(seed), *[x for k in c for x in (k.isNull(), k)]) for seed in (1, 2)]
    col = F.col
    file, delivery = hashed(col("repo"), plain_path(col("file"))), hashed(col("tool"), col("message"))
    rows = findings.select("finding_id", severity_rank(col("severity")).cast("byte").alias("rank"), *[h.alias(f"file{i}") for i, h in enumerate(file)], *[h.alias(f"same{i}") for i, h in enumerate(delivery)], "rule_id", "line")
    return rows.groupBy("file0", "file1", "same0", "same1", "rule_id", "line").agg(F.min_by("rank", "finding_id").alias("severity_rank"), F.min("finding_id").alias("finding_id"))


def _most_severe(spark: SparkSession, sf_dir: str, report: list | None = None) -> DataFrame:
    rows = distinct_findings(table(spark, sf_dir, "findings")).withColumns({"line": F.coalesce("line", F.lit(0)), "rule_id": F.coalesce("rule_id", F.lit(""))})
    return top_n_per_group(rows, [F.col("file0"), F.col("file1")], F.col("severity_rank"), ["line", "rule_id", "finding_id"], n=5, keep=["finding_id"], report=report)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most severe findings of every file of every repository."""
    return _most_severe(spark, sf_dir).select("finding_id")


def p1_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the row groups, and of the rows, were read for it."""
    report: list = []
    _most_severe(spark, sf_dir, report)
    return skip_report(spark, report)


P1_FOUND_SQL = """
WITH d AS (
  SELECT repo, coalesce(ltrim(replace(file, '\\', '/'), './'), '') AS f, tool, rule_id, line, message, finding_id,
    CASE lower(trim(severity)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'error' THEN 4 WHEN 'medium' THEN 3 WHEN 'warning' THEN 3
      WHEN 'low' THEN 2 WHEN 'info' THEN 1 WHEN 'note' THEN 1 ELSE 0 END AS sev
  FROM findings
), u AS (
  SELECT repo, f, rule_id, line, arg_min(sev, finding_id) AS sev, min(finding_id) AS finding_id FROM d GROUP BY repo, f, tool, rule_id, line, message
), r AS (
  SELECT finding_id, row_number() OVER (PARTITION BY repo, f ORDER BY sev DESC, coalesce(line, 0), coalesce(rule_id, ''), finding_id) AS k FROM u
)
SELECT finding_id FROM r WHERE k <= 5
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_files").select("file_id", "repo", "path", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that their repository's authors did not type."""
    return not_typed(_files(spark, sf_dir)).select("file_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those files with what gave them away."""
    return not_typed(_files(spark, sf_dir)).select("file_id", F.array_join("kinds", ",").alias("kinds"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with garbled text, and their text as far as it could be restored."""
    return repair_encoding(_files(spark, sf_dir), "content").drop("content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_encoding(table(spark, sf_dir, "loaded_files").select("file_id", "content"), "content").select("file_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and questions as (src, rec_id, owner, text)."""
    files = table(spark, sf_dir, "loaded_files").select(F.lit("loaded_files").alias("src"), F.col("file_id").alias("rec_id"), F.col("repo").alias("owner"), F.col("content").alias("text"))
    leaves = table(spark, sf_dir, "leaf_definitions").select(F.lit("leaf_definitions").alias("src"), F.col("leaf_key").alias("rec_id"), F.col("repo").alias("owner"), F.col("question").alias("text"))
    return files.unionByName(leaves)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of files and questions on which a usable credential begins."""
    return find_credentials(_texts(spark, sf_dir)).select("src", "rec_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and questions with a credential, with every place of one blanked."""
    texts = _texts(spark, sf_dir)
    return redact(texts, find_credentials(texts))


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What owner counts, forms and the scan for literals do: literals and places by what became of them."""
    return step_report(_texts(spark, sf_dir))


#: kinds of containers that one run packs for; more are an error, none is left out
MOST_CONTAINERS = 1000


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its bin, for each kind of container."""
    containers = [(r["container"], r["capacity_tokens"]) for r in table(spark, sf_dir, "containers").limit(MOST_CONTAINERS + 1).collect()]
    if len(containers) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of containers")
    return pack(materialize(items_of(table(spark, sf_dir, "documents"), containers)))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bins each kind of container takes, and how full they are."""
    return fill_report(p6_packed(spark, sf_dir))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: all documents are placed, no bin is over a capacity, no text is cut without need."""
    return placement_report(p6_packed(spark, sf_dir))


P6_PLACED_SQL = """
SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS badly_cut, 0 AS overfull_bins FROM containers
"""


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents drawn for every mixture with their copies, and the plan they were drawn by."""
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    docs = materialize(docs.select("doc_id", clean_source(F.col("source")).alias("source"), F.coalesce(token_count(F.col("text")), F.lit(0)).alias("tokens")))
    sizes = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens").cast("bigint")).alias("tokens"))
    plan = materialize(draw_plan(sizes, table(spark, sf_dir, "mixtures"), table(spark, sf_dir, "mix_targets")))
    offered = docs.join(plan.select("mixture", "source", "expected"), "source")
    return systematic_copies(offered, ["mixture", "source"], "expected", [F.col("tokens"), F.xxhash64("doc_id")]), plan


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mixture, one row per copy."""
    drawn, _ = _drawn(spark, sf_dir)
    return drawn.select("mixture", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mixture and source: the share wanted and the share really reached, of the wanted and of the drawn total."""
    drawn, plan = _drawn(spark, sf_dir)
    got = drawn.groupBy("mixture", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"), F.count("*").alias("drawn_docs"), F.max("copies").alias("most_copies")
    )
    rows = plan.join(got, ["mixture", "source"], "left").fillna(0, ["drawn_tokens", "drawn_docs", "most_copies"])
    total = Window.partitionBy("mixture")
    return rows.select(
        "mixture", "source", "target_share", "max_repeats", F.col("docs").alias("source_docs"), F.col("tokens").alias("source_tokens"),
        F.round("wanted_tokens", 0).cast("bigint").alias("wanted_tokens"), "drawn_tokens", "drawn_docs", "most_copies",
        F.round(F.col("drawn_tokens") * F.col("target_share") / F.col("wanted_tokens"), 6).alias("share_of_wanted_total"),
        F.round(F.col("drawn_tokens") / F.sum("drawn_tokens").over(total), 6).alias("share_of_drawn_total"),
    )


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mixture and source: its documents, and what must be none: those drawn too often, or a copy or more off what is expected."""
    drawn, plan = _drawn(spark, sf_dir)
    off = F.abs(F.col("copies") - F.col("expected")) >= 1
    got = drawn.join(plan.select("mixture", "source", "max_repeats"), ["mixture", "source"]).groupBy("mixture", "source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), F.count_if(off).alias("off_expectation"))
    rows = plan.select("mixture", "source", F.col("docs").alias("source_docs")).join(got, ["mixture", "source"], "left")
    return rows.fillna(0, ["too_often", "off_expectation"])


P7_BOUNDS_SQL = """
WITH d AS (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents GROUP BY 1)
SELECT t.mixture, lower(trim(t.source)) AS source, coalesce(d.n, 0) AS source_docs, 0 AS too_often, 0 AS off_expectation
FROM mix_targets t LEFT JOIN d ON d.source = lower(trim(t.source))
"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document deals with."""
    return assign(*fit(document_words(table(spark, sf_dir, "documents")), table(spark, sf_dir, "subject_labels")))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per subject over the whole corpus."""
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


_QUERIES = [
    p1_found, p1_skipping, p2_found, p2_kinds, p4_found, p4_repaired, p5_found, p5_redacted, p5_steps,
    p6_packed, p6_fill, p6_placed, p7_mixed, p7_shares, p7_bounds, p8_found, p8_composition,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict:
    return {"p1_found": P1_FOUND_SQL, "p6_placed": P6_PLACED_SQL, "p7_bounds": P7_BOUNDS_SQL}
