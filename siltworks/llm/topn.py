"""The N highest-scoring rows of every group, by statistics-guided skipping.

The rows are clustered by group and descending score into Parquet files in the shared folder. Row groups end where
groups end, if that leaves them half full or more, so a group that fills several has row groups of its own, of
ever lower scores. A manifest tells of each row group its highest score and the set of groups in it. Row groups are
then read in waves of descending highest score, and those are skipped whose highest score lies strictly below the
current N-th score of every group in them. A group of any size is split over tasks by score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltworks.session import drop_scratch, materialize, scratch_path, spread

_K, _L, _S, _T, _P = "__key", "__key2", "__score", "__tie", "__row"
_MANIFEST = "file string, row_group int, top double, rows bigint, groups array<struct<key:bigint,key2:bigint>>"


def _group_keys(groups: Sequence[Column]) -> list[Column]:
    """128 bits of hash for a group, in which nulls equal each other and nothing else."""
    told = [x for g in groups for x in (g.isNull(), g)]
    return [F.xxhash64(*told).alias(_K), F.xxhash64(F.lit(0x5BD1E995), *told).alias(_L)]


def top_n_per_group(df: DataFrame, groups: Sequence[Column], score: Column, ties: Sequence[Column | str], n: int = 5, keep: Sequence[str] | None = None, max_waves: int = 8, row_group_rows: int = 1 << 13, report: list | None = None) -> DataFrame:
    """The columns of `df`, or those in `keep`, and `rank` (from 1) for the first n rows of each group.

    Rows are ordered by `score` descending, then by `ties` ascending (nulls first), columns or names of such; rows
    equal in all of these come in any order. A null or NaN score is below every other score. Nulls in group columns
    equal each other; groups are told apart by 128 bits of hash. An empty input gives an empty result. Columns of any
    name pass through, save `rank`, which is replaced. `max_waves` bounds the reading rounds; `row_group_rows` is the
    size of a row group, some million rows being fit for tables of many TB. To `report`, a dict is added with the row
    groups and rows there are, and those that were read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    names = [c for c in (df.columns if keep is None else keep) if c != "rank"]
    tied = {t: i for i, t in enumerate(ties) if isinstance(t, str)}
    own = [c for c in names if c not in tied]
    s = score.cast("double")
    order = [F.col(_S).desc(), *[F.col(f"{_T}{i}").asc() for i in range(len(ties))]]
    keyed = df.select(
        *_group_keys(groups),
        F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s).alias(_S),
        *[(F.col(f"`{t}`") if isinstance(t, str) else t).alias(f"{_T}{i}") for i, t in enumerate(ties)],
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias(_P)] if own else []),
    )
    path = scratch_path(spark, "topn")
    manifest = materialize(_cluster(keyed, [F.col(_K), F.col(_L), *order], path, row_group_rows))
    by_rank = Window.partitionBy(_K, _L).orderBy(*order)
    top: DataFrame | None = None
    read = []
    for low, high in _waves(manifest, max_waves):
        wave = manifest.where((F.col("top") >= low) & (F.col("top") < high) if high is not None else F.col("top") >= low)
        if top is not None:
            nth = top.where(F.col("rank") == n).select(F.struct(F.col(_K).alias("key"), F.col(_L).alias("key2")).alias("g"), F.col(_S).alias("nth"))
            held = wave.select("file", "row_group", "top", "rows", F.explode("groups").alias("g")).join(nth, "g", "left")
            wave = held.where(F.col("nth").isNull() | (F.col("top") >= F.col("nth"))).select("file", "row_group", "rows").distinct()
        wave = materialize(wave.select("file", "row_group", "rows"))
        count, rows = wave.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        read.append((count, rows))
        if not count:
            continue
        found = _read(wave.repartition(spread(spark, count)), keyed.schema, n)
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = materialize(found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= n))
    if report is not None:
        count, rows = manifest.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        report.append({"row_groups": count, "row_groups_read": sum(c for c, _ in read), "rows": rows, "rows_read": sum(r for _, r in read), "waves": len(read)})
    drop_scratch(spark, path)
    if top is None:
        top = keyed.where(F.lit(False)).withColumn("rank", F.lit(1))
    return top.select(*[(F.col(f"{_T}{tied[c]}") if c in tied else F.col(f"{_P}.c{own.index(c)}")).alias(c) for c in names], "rank")


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI as Spark names it, or of a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _borders(rows: pa.Table) -> np.ndarray:
    """Where a new group begins, but for the first row."""
    k, m = rows.column(_K).to_numpy(), rows.column(_L).to_numpy()
    return np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1


def _cluster(keyed: DataFrame, order: Sequence[Column], path: str, row_group_rows: int) -> DataFrame:
    """Write the rows in this order, one file per range of it, and return the manifest of row groups.

    Every attempt of a task writes a file of its own, and the manifest names those of the attempts that ended.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(path)
        name, writer, made = f"{uuid.uuid4().hex}.parquet", None, []
        waiting: list[pa.Table] = []

        def put(rows: pa.Table) -> None:
            nonlocal writer
            if writer is None:
                fs.create_dir(folder, recursive=True)
                writer = pq.ParquetWriter(f"{folder}/{name}", rows.schema, filesystem=fs, compression="zstd", write_statistics=[_S])
            writer.write_table(rows, row_group_size=rows.num_rows)
            at = np.r_[0, _borders(rows)]
            groups = pa.StructArray.from_arrays([rows.column(c).combine_chunks().take(pa.array(at)) for c in (_K, _L)], names=["key", "key2"])
            made.append((f"{path}/{name}", len(made), float(rows.column(_S).to_numpy().max()), rows.num_rows, groups))

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < row_group_rows:
                continue
            rows = pa.concat_tables(waiting)
            while rows.num_rows >= row_group_rows:
                cuts = _borders(rows.slice(0, row_group_rows))
                cuts = cuts[cuts >= row_group_rows // 2]
                cut = int(cuts[0]) if len(cuts) else row_group_rows
                put(rows.slice(0, cut))
                rows = rows.slice(cut)
            waiting, held = [rows], rows.num_rows
        if held:
            put(pa.concat_tables(waiting))
        if writer is not None:
            writer.close()
            files, numbers, tops, sizes, groups = zip(*made, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(g) for g in groups])], pa.int32()), pa.concat_arrays(groups))
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(numbers, pa.int32()), pa.array(tops, pa.float64()), pa.array(sizes, pa.int64()), lists], names=["file", "row_group", "top", "rows", "groups"])

    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _MANIFEST)


def _waves(manifest: DataFrame, most: int) -> list[tuple[float, float | None]]:
    """Score ranges [low, high) from the top down: one per distinct maximum, or equal parts if there are many."""
    levels = [r[0] for r in manifest.select("top").distinct().orderBy(F.desc("top")).limit(most + 1).collect()]
    if len(levels) > most:
        cuts = manifest.approxQuantile("top", [i / most for i in range(1, most)], 0.01)
        levels = [*sorted({c for c in cuts if c > float("-inf")}, reverse=True), float("-inf")]
    return list(zip(levels, [None, *levels][: len(levels)], strict=True))


def _read(wave: DataFrame, schema: StructType, n: int) -> DataFrame:
    """The rows of these row groups, of each group only the first n of each row group: rows are stored in rank order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, k in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                fs, name = _file_system(uri)
                with fs.open_input_file(name) as f:
                    rows = pq.ParquetFile(f).read_row_group(k)
                begins = np.r_[0, _borders(rows)]
                place = np.arange(rows.num_rows) - np.repeat(begins, np.diff(np.r_[begins, rows.num_rows]))
                yield from rows.take(pa.array(np.flatnonzero(place < n))).select(schema.names).combine_chunks().to_batches()

    return wave.mapInArrow(read, schema)


def skip_report(spark: SparkSession, reports: Sequence[dict]) -> DataFrame:
    """What `top_n_per_group` reported, as rows."""
    return spark.createDataFrame([tuple(int(r[k]) for k in ("row_groups", "row_groups_read", "rows", "rows_read", "waves")) for r in reports], "row_groups bigint, row_groups_read bigint, rows bigint, rows_read bigint, waves bigint")
