"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application, so that their workers can import it, and set the rows of an Arrow batch."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="loomspark-")
        archive = os.path.join(folder, "loomspark_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for where, _, names in os.walk(_PACKAGE):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(where, name)
                    z.write(path, os.path.join("loomspark", os.path.relpath(path, _PACKAGE)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
        # Spark's default fits narrow rows; a batch of so many whole texts would be held several times over in a task.
        if spark.conf.get(_BATCH) == "10000":
            spark.conf.set(_BATCH, BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Only where the setting is absent and the master is local (tests, a single machine) a temporary folder takes its place;
    on a cluster its absence is an error, as other machines could not read such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than a shuffle.

    Large tables have more partitions than that already and stay as they are; a small file would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def session(app: str = "loomspark", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; more settings by keyword, dots as __."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
