"""Tables written in the shared folder, to cut plans that use a table several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``, or in a session without that
    setting on one machine a temporary folder. A cluster has to name one, as its executors
    would each write to their own discs."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/quire-{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _own[0][7:], ignore_errors=True)
    return _own[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``root`` and read back: what follows has a short plan, and a
    lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove what this application wrote between steps. Tables that were made before read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
