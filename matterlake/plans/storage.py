"""Shared scratch storage: checkpoints, stream state and stream results."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session in one
    process (master ``local`` or ``local[..]``, not ``local-cluster``), where
    nothing is set, takes a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    )
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matterlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder.

    The folder carries the application id, so what a finished application
    left can be expired as a whole.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows of ``df`` as a table in the shared folder.

    Cuts the lineage of a frame that several later branches read, and pins
    what is not reproducible (partition numbers).  A lost executor costs only
    the tasks it ran: the table stays.  Parquet keeps pruning and statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions.

    For work whose cost per row is far above that of moving the row, so that
    neither a few large input files nor a run of long texts sit in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def spread_if_narrow(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores is dealt over the cores.

    A large table has more splits than cores and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` texts; a smaller setting stays as it is.

    A batch is held whole by a Python worker, and texts may be long.
    """
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= rows:
        spark.conf.set(BATCH_KEY, str(rows))
