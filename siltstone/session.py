"""Session helpers: the shared folder, tables written to cut lineage, table reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests, a local session) a temporary folder of this machine
    is made, set as the checkpoint folder, and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = _OWN.get(spark.sparkContext.applicationId)
    if not own:
        own = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(own)
        _OWN[spark.sparkContext.applicationId] = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes this application's tables from the shared folder; results not yet written are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read back.

    This cuts the lineage, so that a lost executor costs a re-read and not the whole plan, and
    later uses of the table do not compute it again.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, where it need not be installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once_per_id(df: DataFrame, key: str) -> DataFrame:
    """One row per id of a table in which rows may be delivered twice.

    A redelivered row carries the same values, so which one is kept does not matter.
    """
    return df.dropDuplicates([key])
