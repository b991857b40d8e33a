"""Object listings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedwright.registry import operator


@operator("list_objects")
def list_objects(spark: SparkSession, root: str, prefix: str = "", pattern: str | None = None) -> DataFrame:
    """Objects below ``root`` as rows of key, size, path (folder) and file (name).

    Only paths and sizes are read: the content column is pruned, so no object is opened. Folders named in ``prefix`` are
    part of the path that is listed, and its last part is a glob, so nothing beside it is listed. No object, no rows.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    start = re.sub(r"([\\{}\[\]*?])", r"\\\1", f"{root.rstrip('/')}/{prefix}")
    try:
        listing = reader.load(f"{start}*" if prefix and not prefix.endswith("/") else start)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        listing = spark.createDataFrame([], "path string, length long")
    listing = listing.select(F.col("path").alias("key"), F.col("length").alias("size"))
    return listing.select(
        "key",
        "size",
        F.regexp_extract("key", r"^(.*)/[^/]*$", 1).alias("path"),
        F.regexp_extract("key", r"([^/]*)$", 1).alias("file"),
    )
