"""Findings as a stream: counts per time window, kept up as reports arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.findings import severity_word
from siltworks.session import scratch_path


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files, or one such file, as a stream, with the schema of what lies there now."""
    now, stream = spark.read.parquet(path), spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    files, (folder, _, name) = now.inputFiles(), path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # streams read folders only
        return stream.schema(now.schema).option("pathGlobFilter", name).parquet(folder)
    return stream.schema(now.schema).parquet(path)


def window_counts(findings: DataFrame, every: str = "1 day", time: str = "scanned_at", late: str | None = None) -> DataFrame:
    """Findings per window, class and severity word.

    With `late`, findings older than that behind the newest are dropped and closed windows are given out once;
    without, every window stays open. Findings without a time are left out.
    """
    rows = findings.where(F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if late else rows
    counted = rows.groupBy(F.window(time, every).alias("w"), "evidence_class", severity_word(F.col("severity")).alias("severity")).agg(F.count("*").alias("findings"))
    return counted.select(F.col("w.start").alias("begins"), "evidence_class", "severity", "findings")


def once_each(findings: DataFrame, key: str = "finding_id", time: str = "ingested_at", within: str = "7 days") -> DataFrame:
    """Each finding once, if its further deliveries come within the given time."""
    return findings.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, run through the stream to a table in the shared folder; the last state is returned.

    The sink writes each batch to a path of its own, so a batch that is run again overwrites its own rows only.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/state/batch={max(seen)}")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/state")
