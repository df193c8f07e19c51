"""Steps written to the folder that all executors share, so later readers neither compute them again nor depend on their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions without a configured one, by application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary one; on a cluster executors would
    not share it, so there an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.conf.get("spark.app.id", "")
        if app not in _made:
            _made[app] = tempfile.mkdtemp(prefix="foliant-")
        found = _made[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later reads survive lost executors and nothing is computed twice.

    The files go when the application ends, or earlier with ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _fs(spark, path).deleteOnExit(_path(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for t in tables:
        spark, path = t.sparkSession, t._foliant_path
        _fs(spark, path).delete(_path(spark, path), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
