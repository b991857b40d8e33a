"""Shared staging folder: where lineage is cut and intermediate tables are written.

The folder is the one the cluster names in ``spark.checkpoint.dir``. It must be readable by every executor, so a lost
executor never loses staged rows. Only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` when the context has none yet."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="feedwright-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_staged(spark: SparkSession) -> int:
    """Delete what this session staged; frames that read it can no longer be used. Returns the number of paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _made:
        path = hadoop.Path(_made.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used wherever a result must not be recomputed differently (row positions) or where lineage grows in a loop. Unlike
    an RDD checkpoint, later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
