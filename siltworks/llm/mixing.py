"""Mixing sources to target weights by systematic sampling.

Each document of a stratum has an expected number of copies. The expected copies are summed along the stratum,
one random offset is added, and a copy is drawn at every whole number that the sum crosses. Documents are taken
in order of their size, so the tokens drawn follow the expectation closely. The sums run in two levels: within
range partitions, and over the partitions' totals, so that a stratum of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltworks.session import stored

#: One copy in the whole-number units in which sums are kept, so that they are exact.
UNIT = 1 << 24


def clean_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def systematic_copies(df: DataFrame, strata: Sequence[str], expected: str, order: Sequence[Column], seed: int = 11) -> DataFrame:
    """The rows that are drawn, with `copies` (at least 1), by systematic sampling within each stratum.

    `expected` is a column of expected copies: null, NaN or negative counts as 0. A row gets its expectation
    rounded down or up, hence never more than the next whole number, and on average over offsets exactly its
    expectation: a stratum has one random offset, told by `seed`. Rows equal in `order` come in any order within one
    run, repeated rows are rows of their own, null strata are strata. Empty in, empty out.
    """
    spark = df.sparkSession
    e = F.col(expected).cast("double")
    units = F.when(e.isNull() | F.isnan(e) | (e < 0), F.lit(0)).otherwise(F.round(e * UNIT)).cast("bigint")
    keys = [F.col(c) for c in strata]
    sort = [F.xxhash64(*keys), *keys, *order]
    ranged = df.withColumn("__units", units).withColumn("__stratum", F.xxhash64(*keys)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort)
    ranged = ranged.withColumn("__part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField("__sum", LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        carried = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c) for c in strata]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                code = np.nan_to_num(code.astype(float), nan=-1)
                change[1:] |= code[1:] != code[:-1]
            first = tuple(c[0].as_py() for c in cols)
            change[0] = first != last
            total = np.cumsum(batch.column("__units").to_numpy())
            begins = np.flatnonzero(change)
            before = np.where(begins > 0, total[begins - 1], 0)
            base = np.zeros(batch.num_rows, dtype=np.int64)
            at = np.searchsorted(begins, np.arange(batch.num_rows), side="right") - 1
            base[at >= 0] = before[at[at >= 0]]
            out = total - base + np.where(at < 0, carried, 0)
            last, carried = tuple(c[-1].as_py() for c in cols), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=batch.schema.append(pa.field("__sum", pa.int64())))

    rows = stored(ranged.mapInArrow(running, schema), "systematic")
    parts = rows.groupBy("__part", *strata).agg(F.sum("__units").alias("__total"))
    upto = Window.partitionBy(*strata).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__total").over(upto), F.lit(0)))
    parts = parts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(strata)], "__base")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(strata):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))

    offset = F.pmod(F.xxhash64(F.lit(seed), "__stratum"), F.lit(UNIT))
    upper = F.col("__base") + F.col("__sum") + offset
    drawn = rows.join(parts, same).withColumn("copies", F.shiftright(upper, 24) - F.shiftright(upper - F.col("__units"), 24))
    return drawn.where(F.col("copies") > 0).select(*df.columns, "copies")


def draw_plan(sizes: DataFrame, mixtures: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mixture and source: tokens there are, tokens wanted, and the copies of each document that give them.

    `sizes` has one row per source (source, docs, tokens), null being documents without a source, which count
    to the corpus' size. A source that is too small gives every document `max_repeats` times; one without a
    document gives nothing. What such sources lack isn't made up by others, so theirs stay at their targets.
    """
    corpus = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = targets.select("mixture", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(mixtures, "mixture")
    plan = wanted.join(sizes.where(F.col("source").isNotNull()), "source", "left").fillna(0, ["docs", "tokens"])
    plan = plan.withColumn("wanted_tokens", F.col("target_share") * F.col("size_factor") * F.lit(corpus))
    return plan.withColumn("expected", F.when(F.col("tokens") > 0, F.least(F.col("wanted_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))
