"""Session helpers: building one for tests and benches, and cutting lineage durably."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(cores: int | str = "*", name: str = "quernstone", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably and return it with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without one (a test) gets a
    temporary folder, and a session on a cluster without one is refused, since its executors share no machine's folder. Never
    localCheckpoint: its blocks die with an executor.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernstone-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it is a scan of fewer: costly work on a few small files then uses them all.

    An input of more partitions, as any large one, is left as it is; so is what isn't a plain scan.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)
