"""Session, shared scratch folder and size bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a job has shown it to be under this many bytes.
BROADCAST_BYTES = 64 << 20
# Columns per aggregate: wider tables are profiled in several aggregates.
AGG_CHUNK = 400


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and for bench.py; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as set in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage, fixes ids that depend on the partitioning, and gives the
    optimizer true sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing will read again."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def agg_rows(df: DataFrame, exprs: list[Column], chunk: int = AGG_CHUNK) -> list:
    """Values of many global aggregates, in order; one job per `chunk` of them."""
    out: list = []
    for start in range(0, len(exprs), chunk):
        part = exprs[start:start + chunk]
        out.extend(df.agg(*[e.alias(f"a{i}") for i, e in enumerate(part)]).first())
    return out


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides are shuffled, for sides that grow with the input behind an explode.

    Spark sizes such a side by what stood before the explode, takes it for small and has the driver build a table of all of it.
    """
    return left.hint("merge").join(right, on, how)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when a job shows the table's printed rows to be under the bound."""
    width = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    size = df.agg(width.alias("b")).first()["b"] or 0
    return size <= limit
