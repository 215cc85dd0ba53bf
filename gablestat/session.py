"""Session settings and the durable cut points used before iterative work."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "gablestat", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the adaptive settings the operators rely on.

    Partition counts are left to adaptive execution: it starts from
    ``spark.sql.shuffle.partitions`` and coalesces by measured bytes. Joins carry
    no unconditional broadcast hint, so every broadcast is a decision Spark takes
    on a measured or provably bounded size.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, whose functions import it."""
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        base = os.path.join(tempfile.mkdtemp(prefix="gablestat-package-"), "gablestat")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only for a local master with no setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="gablestat-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative training cuts its own lineage in the checkpoint folder; make sure there is one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_recorders: list[list[str]] = []


@contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the paths of all tables that are stored inside, for a caller that deletes them once their readers are done."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path for ``drop_stored``."""
    path = fresh_path(df.sparkSession, "rows")
    for paths in _recorders:
        paths.append(path)
    df.write.parquet(path)
    # Spark deletes the shuffle files of a finished query once the driver has collected its plan, which a large heap may put off for hours
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path  # no job to find the schema


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``store`` wrote and nothing reads any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError("only tables in the shared folder are deleted")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    return store(df)[0]


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table in the shared folder; the tables that it stored on its way are deleted."""
    with recording() as paths:
        df = make()
    out = cut_lineage(df)
    for path in paths:
        drop_stored(spark, path)
    return out
