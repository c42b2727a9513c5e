"""Session settings, code shipping and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("typolith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TYPOLITH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application.

    Executors may run elsewhere, so Python workers get the code through Spark's file server
    and not through a path that only the driver has.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="typolith-code-")
        target = os.path.join(folder, "typolith_code.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(_PACKAGE.rglob("*.py")):
                archive.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
        context.addPyFile(target)
        _shipped[context.applicationId] = target
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a local session a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="typolith-scratch-")
            spark.sparkContext.setCheckpointDir(current)
        folder = current
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends here.

    Any executor can be lost afterwards without recomputing what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/typolith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reader(spark: SparkSession, sf_dir: str):
    """A function from table name to DataFrame over one folder of Parquet tables."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
