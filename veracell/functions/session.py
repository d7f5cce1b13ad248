"""Session helpers: a local session for tests and the shared scratch folder of a cluster."""
from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veracell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


#: Folders handed out by ``scratch_path`` and not dropped yet.
_handed_out: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete every written step of this session; returns how many folders went.

    Call it when the results that were built on them are stored: DataFrames that still read a
    step fail afterwards.
    """
    return drop_paths(spark, list(_handed_out))


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders; returns how many were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(conf).delete(at, True))
        if path in _handed_out:
            _handed_out.remove(path)
    return gone


def forget_shuffles(spark: SparkSession) -> None:
    """Let shuffle files go that nothing refers to any more: the JVM only looks for such when it
    collects garbage, which a driver with little to do may not do for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Steps:
    """Written states of a loop: the present one and the one before it are kept, older ones go, and
    shuffle files of finished rounds too."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "loop")
        df.write.parquet(path)
        self.paths.append(path)
        drop_paths(self.spark, self.paths[:-self.keep])
        self.paths = self.paths[-self.keep:]
        forget_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Survives the loss of executors, fixes positional columns, keeps later scans columnar, and,
    unlike ``checkpoint()``, does not carry the constraints of the old plan along, which grow
    without bound in loops.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, key_cols: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """Add a row identity.

    One key column is reused as it is, several become a struct. Without keys, positions are
    numbered and the result is written once, so that every later evaluation sees the same ids.
    """
    if key_cols:
        key = F.col(key_cols[0]) if len(key_cols) == 1 else F.struct(*key_cols)
        return df.withColumn(name, key)
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if a key is null or repeated: later joins by the key would lose or multiply rows."""
    rows, keys, worst = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n"), F.count(F.when(F.col(key).isNotNull(), 1)), F.max("n")).first()
    nulls = rows is not None and not df.where(F.col(key).isNull()).isEmpty()
    if nulls or (worst or 0) > 1:
        raise ValueError(f"{key} does not identify rows: {keys} keys for {rows} rows"
                         + (", some null" if nulls else "")
                         + "; name another key or none (rows are then numbered)")


def ship(spark: SparkSession) -> str:
    """Give the executors this package, which Python functions on them import.

    Needed where it is neither installed on the executors nor on their PYTHONPATH.
    """
    import shutil
    from pathlib import Path
    root = Path(__file__).resolve().parents[2]
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "veracell"), "zip",
                               root, "veracell")
    spark.sparkContext.addPyFile(made)
    return made


def materialise(df: DataFrame, *keys: str) -> DataFrame:
    """Write a table that many passes will read, spread evenly over all cores by its keys.

    Later scans split the written files by ``spark.sql.files.maxPartitionBytes``.
    """
    return cut_lineage(df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys))
