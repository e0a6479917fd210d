"""Session settings the jobs expect."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even if that costs one more exchange further down
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str = "/tmp/checkpoints") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", checkpoints)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine, where it may be unset, a folder of the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` in the folder of ``spark.checkpoint.dir``, so a lost executor costs no recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a table in the folder of ``spark.checkpoint.dir``, for loops that join what they made before.

    A checkpoint keeps the size that was estimated for its plan, which multiplies with every join; a table has its real one.
    """
    path = f"{_checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
