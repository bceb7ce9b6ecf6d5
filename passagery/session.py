"""Session construction and the shared scratch area for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "20g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "passagery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tested under; cluster settings win when present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        for key, value in LOCAL_CONF.items():
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the application, once; a no-op when it was sent before."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "passagery.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(home.rglob("*.py")):
                out.write(source, source.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(application)
    return spark


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: reliable lineage cut, columnar on reuse."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
