"""Session helpers and the shared folder in which intermediate tables live.

Every table that outlives one Spark job is written below the folder the
cluster names in ``spark.checkpoint.dir``, which all executors can reach, so
losing an executor never loses data.  A folder of our own is chosen only where
that setting is absent and everything runs on one machine (tests); a cluster
without it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strataform")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="strataform-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/strataform-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _RUNS[app])
    return _RUNS[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage and lets several consumers share one computation; unlike a
    cached frame it survives the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex[:10]}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again, as loops do step by step."""
    path = getattr(table, "_staged_path", None)
    if path:
        fs, p = hadoop(table.sparkSession, path)
        fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session uses."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, heavy: bool = False) -> DataFrame:
    """The rows over at least as many tasks as there are cores.

    For work that costs more than moving its rows, over inputs that are split
    into too few parts (small files, single row groups).  Inputs with enough
    parts, as all large ones have, stay as they are.  So do rows that come out
    of a shuffle, whose parts aren't known before it runs, unless the work is
    ``heavy`` (a model per row).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df.repartition(max(cores, partitions(df.sparkSession))) if heavy else df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
