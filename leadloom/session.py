"""Session helpers: the settings the operators rely on and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the operators need for right results and bounded memory.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # repeated JSON keys: the last one wins
    "spark.sql.variant.allowDuplicateKeys": "true",
    # recursive queries are bounded by their own depth, not by a number of rows
    "spark.sql.cteRecursionRowLimit": "-1",
    # batches for Python end by size: long texts need not wait for 10,000 rows, which would all be in memory twice
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to an existing session."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per context.

    Spark's own file server carries it, so the package need not be installed
    on the executors nor lie in the folder a job is started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_leadloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="leadloom-package-"), "leadloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._leadloom_shipped = True


def build_session(app: str = "leadloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **REQUIRED,
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` decides.  Only where neither it nor the context
    names a folder (local tests) is a temporary one made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="leadloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

