"""Tables written between stages of a job, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in a local session without one, an own folder."""
    known = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if known:
        return known.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_SETTING} is not set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="suitelens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later readers neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/suitelens/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables this application has staged; to be called when the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
