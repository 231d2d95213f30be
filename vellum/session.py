"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_PLACED = {}


def build_session(name: str = "vellum", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the jobs rely on.

    Master and shuffle partitions are the deployment's choice; ``cores`` makes a
    local session, for tests and the bench, with a few partitions for each core.
    """
    builder = SparkSession.builder
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "8g")
        shuffle_partitions = shuffle_partitions or (int(cores) if cores.isdigit() else 8)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.appName(name)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every column costs several calls to the JVM each; the largest plans have thousands of columns.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    ``spark.checkpoint.dir`` is the cluster's choice and is taken as it is. Only
    a local master without that setting gets a folder of its own, because a
    machine-local path would be lost with its executor on a real cluster.
    """
    sc = spark.sparkContext
    if _PLACED.get(sc.applicationId):
        return
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        sc.setCheckpointDir(configured)
    _PLACED[sc.applicationId] = True


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative step with a reliable checkpoint."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
