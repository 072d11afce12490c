"""Tables that a computation of several jobs writes between them, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; within one machine (tests) one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("", "file://" + tempfile.mkdtemp(prefix="spark-"))


def kept(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The table written, and read back: it doesn't depend on executors, and its true size is known. It goes when the
    driver ends, or by `forget` (its path is added to `made`)."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no remaining plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if (spark, path) in _made:
            _made.remove((spark, path))
    paths.clear()


@atexit.register
def _forget_all() -> None:
    for spark, path in _made[:]:
        if path.startswith("file:"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            forget(spark, [path])
