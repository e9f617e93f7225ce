"""Tables written to shared storage and read back, where a plan would otherwise compute its input several times."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/streamlanes-shared"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder of spark.checkpoint.dir, which a cluster must name, removed when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or LOCAL_SHARED).rstrip('/')}/streamlanes/{name}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` as files in the folder of spark.checkpoint.dir: lineage and plan end there, and no lost executor brings them back."""
    path = shared_path(df.sparkSession, f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
