"""Sessions, the shared folder and staged tables.

Nothing here touches a machine-local folder on a cluster: staged tables go to
the folder named by ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_own_dir: list[str] = []


def local_session(app: str = "inkwarden", cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="inkwarden-"))
        path = _own_dir[0]
    return f"{path.rstrip('/')}/inkwarden-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone already: the folder stays for the cluster's own cleaning
        pass


_cleaned: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the application's other staged tables at exit."""
    base = shared_dir(spark)
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_delete, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: what reads the result survives lost executors without
    recomputing ``df``, and two readers do not compute it twice.
    """
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    _staged[id(out)] = out, path
    return out


_staged: dict[int, tuple[DataFrame, str]] = {}


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again. Others go with the application."""
    kept, path = _staged.pop(id(df), (None, ""))
    if kept is df:
        _delete(df.sparkSession, path)
