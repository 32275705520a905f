"""Places within groups of any size, by ranges instead of one window a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import materialize


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in their group by `order`, which must tell the rows of a group apart.

    Rows are dealt by ranges of group and order; places count within a range, and the rows of a group in the ranges
    before are added. So a group of a third of all rows is a third of the tasks'. Null keys are a group of their own;
    rows that `order` doesn't tell apart come in any order. A column called `name` is replaced.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.drop(name).repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = ranged.withColumn("__local", local).join(parts, same)
    return rows.select(*[c for c in df.columns if c != name], (F.col("__local") + F.col("__before")).cast("int").alias(name))
