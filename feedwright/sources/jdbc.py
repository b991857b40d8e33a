"""External databases over JDBC; the driver jar is supplied by the user."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from feedwright.registry import operator

# Default port and URL shape per database kind.
JDBC_URLS = {
    "postgres": (5432, "jdbc:postgresql://{host}:{port}/{database}"),
    "greenplum": (5432, "jdbc:postgresql://{host}:{port}/{database}"),
    "redshift": (5439, "jdbc:redshift://{host}:{port}/{database}"),
    "mysql": (3306, "jdbc:mysql://{host}:{port}/{database}"),
    "sqlserver": (1433, "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "oracle": (1521, "jdbc:oracle:thin:@//{host}:{port}/{database}"),
    "firebird": (3050, "jdbc:firebirdsql://{host}:{port}/{database}"),
    "sqlite": (None, "jdbc:sqlite:{database}"),
}


@operator("jdbc_url")
def jdbc_url(kind: str, database: str, host: str | None = None, port: int | None = None) -> str:
    """Connection URL of a database kind."""
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind {kind!r}")
    default_port, shape = JDBC_URLS[kind]
    return shape.format(host=host, port=port or default_port, database=database)


@operator("jdbc_options")
def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    fetch_size: int = 10000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options. A partitioned read needs the column, its bounds and the number of partitions together."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), **dict(properties or {})}
    parts = (partition_column, lower, upper, partitions)
    if any(part is not None for part in parts):
        if any(part is None for part in parts):
            raise ValueError("a partitioned read needs column, lower, upper and partitions")
        # Spark refuses `query` with partitionColumn: wrap it as a derived table.
        options["dbtable"] = table if table is not None else f"({query}) src"
        options.update(
            partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
        )
    elif table is not None:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


@operator("read_jdbc")
def read_jdbc(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    """Scan a table or query; filters and column lists are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()


@operator("write_jdbc")
def write_jdbc(
    df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 5000, **properties: str
) -> None:
    """Append to or overwrite an external table; an overwrite truncates and keeps the table's definition."""
    df.write.format("jdbc").mode(mode).options(
        url=url, dbtable=table, batchsize=str(batch_size), truncate="true", **properties
    ).save()
