"""Session helpers: a configured session, and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def build_session(app: str = "siltworks", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; a cluster's own settings stay as they are."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if the cluster names one.

    Where it is unset, a temporary folder is made and set as the checkpoint folder, if executors run on this machine
    alone, as in tests; on a cluster that is an error, since executors couldn't read what others wrote.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if not current:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        current = sc.getCheckpointDir()
    return (named or current).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that cuts lineage or is read by row groups.

    What is there is deleted by `drop_scratch`, at the latest when the driver's process ends.
    """
    path = f"{shared_dir(spark)}/siltworks-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_rest)
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete these scratch tables, or all that this process has made; frames that still read them fail from then on."""
    for path in paths or tuple(_made):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


def _drop_rest() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            drop_scratch(spark)
    except Exception:  # the JVM may have gone already
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a compressed table in the shared folder, and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; the lineage ends there and the loss of executors is harmless."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, rows: int, per_task: int = 1) -> int:
    """How many tasks share `rows` pieces of work: one each while they are few, a small multiple of the cores later."""
    most = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(-(-rows // per_task), most))


def widen(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores, ahead of heavy work on each row.

    A scan of many files or row groups passes unchanged; only an input of fewer splits than cores is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def widen_first(df: DataFrame) -> DataFrame:
    """As `widen`, ahead of heavy filters and expressions: an observed count keeps the optimizer from moving them below the dealing out."""
    wide = widen(df)
    return df if wide is df else wide.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
