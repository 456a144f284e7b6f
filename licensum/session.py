"""Session settings the jobs rely on."""

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs. On a cluster the submitted settings apply instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("licensum")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Gives the package to all Python workers of the session, once; needless where it is installed on them."""
    context = spark.sparkContext
    if getattr(context, "_licensum_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='licensum-')}/licensum.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    context._licensum_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names.

    On a cluster the setting is required, since executors do not see each other's disks; a local session has one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/licensum-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

    return f"{tempfile.mkdtemp(prefix='licensum-')}/table"


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for what several later steps read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
