"""Queries on nested group results (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.shred import NestedColumn, NestedDoc, shred, tables_of
from siltworks.session import table

SEARCHES = ("retrieval.code_search", "simal.search", "activation_hint_evidence.search")
HITS = tuple(f"{s}.hits_by_query" for s in SEARCHES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, citation, query and hit rows of every group result, each tied to its parent."""
    df = table(spark, sf_dir, "group_results")
    docs = [NestedColumn("result", "leaf_results"), NestedDoc("bundle", F.col("evidence_bundle"), maps=HITS)]
    lists = [f"{h}{{}}[].hit_ids[]" for h in HITS]
    paths = [("result", "leaf_results[].leaf_id"), ("result", "leaf_results[].citations[]"), *[("bundle", h + "{}") for h in HITS], *[("bundle", p) for p in lists]]
    flat = shred(df, F.col("result_id"), docs, tables_of(paths, fold=lists, nulls=[h + "{}" for h in HITS]))

    def rows(t: DataFrame, section: str, parent: Column, pos: Column, item: Column) -> DataFrame:
        return t.select(F.col("record").alias("result_id"), F.lit(section).alias("section"), parent.alias("parent"), pos.cast("bigint").alias("pos"), F.coalesce(item, F.lit("")).alias("item"))

    at = lambda i: F.element_at("pos", i)
    out = rows(flat["result:leaf_results[]"], "leaf", F.lit(""), at(1), F.col("leaf_id")).unionByName(rows(flat["result:leaf_results[].citations[]"], "citation", at(1).cast("string"), at(2), F.col("value")))
    queries, hits = [], []
    for s, h in zip(SEARCHES, HITS, strict=True):
        names = flat[f"bundle:{h}{{}}"]
        queries.append(rows(names, "query", F.lit(s), F.lit(0), F.col("name")))
        keyed = flat[f"bundle:{h}{{}}[]"].withColumn("of", F.slice("pos", 1, 1))
        parents = names.select("record", F.col("pos").alias("of"), F.col("name").alias("query"))
        hits.append(rows(keyed.join(parents, ["record", "of"]), "hit", F.col("query"), at(2), F.array_join("hit_ids", ",")))
    for q in queries:
        out = out.unionByName(q)
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return out.unionByName(found.distinct())


P3_FOUND_SQL = """
WITH b0 AS (
  SELECT result_id, CASE WHEN evidence_bundle IS NOT NULL AND json_valid(evidence_bundle) THEN evidence_bundle::JSON END AS j FROM group_results
), b1 AS (
  SELECT result_id, CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END) ELSE j END AS j FROM b0 WHERE j IS NOT NULL
), s AS (
  SELECT result_id, p.path, json_extract(j, '$.' || p.path || '.hits_by_query') AS h
  FROM b1, (VALUES ('retrieval.code_search'), ('simal.search'), ('activation_hint_evidence.search')) AS p(path) WHERE j IS NOT NULL
), e AS (
  SELECT s.result_id, s.path, u.key AS k, u.value AS v FROM s, json_each(s.h) AS u WHERE json_type(s.h) = 'OBJECT'
), l AS (
  SELECT result_id, i - 1 AS pos, leaf_results[i] AS x FROM (SELECT result_id, leaf_results, unnest(range(1, len(leaf_results) + 1)) AS i FROM group_results)
), c AS (
  SELECT result_id, pos AS leaf, i - 1 AS pos, x.citations[i] AS item FROM (SELECT *, unnest(range(1, len(x.citations) + 1)) AS i FROM l WHERE x IS NOT NULL)
), h AS (
  SELECT e.result_id, e.k, i - 1 AS pos, json_extract(e.v, '$[' || (i - 1) || ']') AS el FROM (SELECT *, unnest(range(1, json_array_length(v)::BIGINT + 1)) AS i FROM e WHERE json_type(v) = 'ARRAY') e
)
SELECT result_id, 'leaf' AS section, '' AS parent, pos::BIGINT AS pos, coalesce(x.leaf_id, '') AS item FROM l WHERE x IS NOT NULL
UNION ALL SELECT result_id, 'citation', leaf::VARCHAR, pos::BIGINT, item FROM c WHERE item IS NOT NULL
UNION ALL SELECT DISTINCT result_id, 'query', path, 0::BIGINT, k FROM e
UNION ALL SELECT DISTINCT result_id, 'hit', k, pos::BIGINT, coalesce(array_to_string(list_filter(from_json(el->'hit_ids', '["VARCHAR"]'), lambda x: x IS NOT NULL), ','), '')
FROM h WHERE json_type(el) <> 'NULL'
"""


def queries() -> dict:
    return {"p3_found": p3_found}


def oracle_sql() -> dict:
    return {"p3_found": P3_FOUND_SQL}
