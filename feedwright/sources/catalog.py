"""Catalog tables: description, creation, removal, publication."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedwright.functions.text import quoted, safe_identifier, text_literal
from feedwright.registry import operator
from feedwright.staging import stage

# Fixed value: how a NULL is named in a partition path.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Table properties that Spark and its metastore write themselves.
KEPT_BY_SPARK = re.compile(r"transient_lastDdlTime$|num(Files|Rows)$|(raw|total)(Data)?Size$|spark\.sql\.|EXTERNAL$")


def _sql_name(table: str) -> str:
    return ".".join(safe_identifier(part) for part in table.split("."))


@operator("run_sql")
def run_sql(spark: SparkSession, text: str, args: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """Pass-through Spark SQL with named arguments (``:name``, ``IDENTIFIER(:table)``) and frames (``{name}``)."""
    return spark.sql(text, args=dict(args or {}), **frames)


@operator("describe_table")
def describe_table(df: DataFrame, sort: bool = False) -> DataFrame:
    """Columns of a frame or table: name, type, precision text, nullable, default, position."""
    rows = []
    for position, field in enumerate(df.schema.fields):
        base, _, size = field.dataType.simpleString().partition("(")
        default = (field.metadata or {}).get("CURRENT_DEFAULT")
        rows.append((field.name, base, f"({size}" if size else None, field.nullable, default, position))
    if sort:
        rows.sort(key=lambda row: row[0])
    schema = "column_name string, data_type string, precision string, nullable boolean, column_default string, position int"
    return df.sparkSession.createDataFrame(rows, schema)


@operator("table_exists")
def table_exists(spark: SparkSession, table: str) -> bool:
    """True when the catalog knows the table."""
    return spark.catalog.tableExists(table)


@operator("schema_missing")
def schema_missing(spark: SparkSession, schema: str) -> bool:
    """True when the catalog does not know the schema."""
    return not spark.catalog.databaseExists(schema)


@operator("create_schema")
def create_schema(spark: SparkSession, schema: str) -> None:
    """Create a schema when it is missing."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_sql_name(schema)}")


@operator("materialize_temp")
def materialize_temp(df: DataFrame, name: str, cache: bool = True) -> DataFrame:
    """A query result as a named, typed temporary table of the session."""
    if cache:
        df = df.cache()
    df.createOrReplaceTempView(name)
    return df


@operator("archive_temp")
def archive_temp(spark: SparkSession, base: str, job_id: int | str, names: list[str] | None = None) -> list[str]:
    """Dump temporary tables under ``base/job_id=…/<name>``; returns the paths."""
    chosen = names or [table.name for table in spark.catalog.listTables() if table.isTemporary]
    paths = []
    for name in chosen:
        path = f"{base}/job_id={job_id}/{name}"
        spark.table(name).write.parquet(path)
        paths.append(path)
    return paths


@operator("table_from_sql")
def table_from_sql(spark: SparkSession, query: str | DataFrame, table: str) -> None:
    """Write a query into a table, replacing its rows. A query that reads the table itself is published by swap."""
    frame = spark.sql(query) if isinstance(query, str) else query
    publish(spark, {table: frame})


@operator("refresh_view")
def refresh_view(spark: SparkSession, query: str, table: str) -> None:
    """Recompute a materialised view."""
    table_from_sql(spark, query, table)


@operator("clone_structure")
def clone_structure(spark: SparkSession, source: str, target: str) -> None:
    """Empty copy of a table, with its partitioning, buckets and properties."""
    spark.sql(f"CREATE TABLE {_sql_name(target)} LIKE {_sql_name(source)}")
    _copy_properties(spark, source, target)


def _copy_properties(spark: SparkSession, source: str, target: str) -> None:
    """Properties that users have set; those that Spark keeps about files and statistics are left out."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {_sql_name(source)}").collect()
    own = {row["key"]: row["value"] for row in rows if not KEPT_BY_SPARK.match(row["key"])}
    if own:
        pairs = ", ".join(f"{text_literal(key)} = {text_literal(value)}" for key, value in own.items())
        spark.sql(f"ALTER TABLE {_sql_name(target)} SET TBLPROPERTIES ({pairs})")


@operator("clone_schema")
def clone_schema(spark: SparkSession, source: str, target: str) -> list[str]:
    """Empty copies of every table of a schema; returns the names created."""
    create_schema(spark, target)
    created = []
    for table in spark.catalog.listTables(source):
        if not table.isTemporary:
            clone_structure(spark, f"{source}.{table.name}", f"{target}.{table.name}")
            created.append(table.name)
    return created


@operator("create_if_missing")
def create_if_missing(spark: SparkSession, target: str, like: str) -> bool:
    """Create the target from a source structure when it is absent; True when it was created."""
    if spark.catalog.tableExists(target):
        return False
    clone_structure(spark, like, target)
    return True


@operator("truncate_table")
def truncate_table(spark: SparkSession, table: str) -> None:
    """Empty a table."""
    spark.sql(f"TRUNCATE TABLE {_sql_name(table)}")


@operator("drop_table")
def drop_table(spark: SparkSession, table: str) -> None:
    """Drop one table."""
    spark.sql(f"DROP TABLE IF EXISTS {_sql_name(table)}")


@operator("drop_tables_like")
def drop_tables_like(spark: SparkSession, schema: str, pattern: str) -> list[str]:
    """Drop the tables of a schema whose name matches a regex (unanchored); returns the names dropped."""
    dropped = []
    for table in spark.catalog.listTables(schema):
        if not table.isTemporary and re.search(pattern, table.name):
            drop_table(spark, f"{schema}.{table.name}")
            dropped.append(table.name)
    return dropped


def _write_like(spark: SparkSession, frame: DataFrame, name: str, table: str) -> None:
    """Write a new table in the layout of an existing one."""
    if not spark.catalog.tableExists(table):
        frame.write.saveAsTable(name)
        return
    old = spark.table(table)
    if {(f.name, f.dataType) for f in old.schema.fields} == {(f.name, f.dataType) for f in frame.schema.fields}:
        clone_structure(spark, table, name)
        frame.select(*[quoted(column) for column in old.columns]).write.insertInto(name)
        return
    parts = [column.name for column in spark.catalog.listColumns(table) if column.isPartition and column.name in frame.columns]
    (frame.write.partitionBy(*parts) if parts else frame.write).saveAsTable(name)
    _copy_properties(spark, table, name)


def _relocate_partitions(spark: SparkSession, table: str) -> None:
    """After a rename, point the partitions at the table's folder where the catalog has not done so itself."""
    if not any(column.isPartition for column in spark.catalog.listColumns(table)):
        return
    name = _sql_name(table)

    def location(partition: str = "") -> str:
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name} {partition}").collect()
        # For a partition its own location comes before the table's.
        return next(row["data_type"] for row in rows if row["col_name"] == "Location").rstrip("/")

    def spec(path: str) -> str:
        pairs = [part.split("=", 1) for part in path.split("/")]
        values = ["null" if value == NO_VALUE else text_literal(unquote(value)) for _, value in pairs]
        return ", ".join(f"{safe_identifier(unquote(key))} = {value}" for (key, _), value in zip(pairs, values))

    root = location()
    for row in spark.sql(f"SHOW PARTITIONS {name}").toLocalIterator():
        path = row["partition"]
        if location(f"PARTITION ({spec(path)})") == f"{root}/{path}":
            continue  # the catalog has moved it with the table
        spark.sql(f"ALTER TABLE {name} PARTITION ({spec(path)}) SET LOCATION {text_literal(f'{root}/{path}')}")
    spark.catalog.refreshTable(table)


@operator("publish_partitions")
def publish_partitions(spark: SparkSession, table: str, frame: DataFrame) -> None:
    """Replace the partitions of a table that occur in ``frame`` by its rows; the others are not touched.

    The frame may read the table: it is staged first. An empty frame changes nothing.
    """
    columns = [quoted(name) for name in spark.table(table).columns]
    rows = stage(frame.select(*columns), "partitions")
    # A table insert takes the mode from the session, not from the writer's options.
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


INTENTS = "__publish_intents"
INTENT_SECONDS = 3600


class _Intents:
    """Intent files of publications, in a folder of the warehouse that all sessions share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = self.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), INTENTS)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str, state: str):
        return self.fs.Path(self.root, f"{name}.{state}")

    def write(self, name: str, entries: list[dict]) -> None:
        out = self.system.create(self.path(name, "prepared"), True)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()

    def commit(self, name: str) -> None:
        """The one rename that decides: from here on the new tables hold."""
        if not self.system.rename(self.path(name, "prepared"), self.path(name, "committed")):
            raise RuntimeError(f"publication {name} was undone by another session")

    def remove(self, name: str, state: str) -> None:
        self.system.delete(self.path(name, state), False)

    def open(self) -> list[tuple[str, str, int, list[dict]]]:
        """(name, state, age in milliseconds, entries) of publications that are not finished."""
        if not self.system.exists(self.root):
            return []
        found, now = [], time.time() * 1000
        for status in self.system.listStatus(self.root):
            name, _, state = status.getPath().getName().rpartition(".")
            if state not in ("prepared", "committed"):
                continue
            source = self.system.open(status.getPath())
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            source.close()
            try:
                found.append((name, state, int(now - status.getModificationTime()), json.loads(text)))
            except ValueError:
                if state == "committed":  # a prepared one may be cut short: nothing was swapped yet
                    raise
                found.append((name, state, int(now - status.getModificationTime()), []))
        return found


def _swap(spark: SparkSession, entry: dict) -> None:
    """Put a new table in its place, from whatever step an earlier attempt reached."""
    table, new, old = entry["table"], entry["new"], entry["old"]
    if spark.catalog.tableExists(new):
        if spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {_sql_name(table)} RENAME TO {_sql_name(old)}")
        if spark.catalog.tableExists(old):
            _relocate_partitions(spark, old)  # else dropping it would take files of its successor
        spark.sql(f"ALTER TABLE {_sql_name(new)} RENAME TO {_sql_name(table)}")
    _relocate_partitions(spark, table)


def _finish(spark: SparkSession, intents: _Intents, name: str, entries: list[dict]) -> None:
    for entry in entries:
        _swap(spark, entry)
    for entry in entries:
        drop_table(spark, entry["old"])
    intents.remove(name, "committed")


@operator("recover_publications")
def recover_publications(spark: SparkSession, older_than: float = INTENT_SECONDS) -> dict[str, str]:
    """Finish publications that were committed and undo those that were not, where the session that made them is gone.

    An intent younger than ``older_than`` seconds may belong to a session at work and is left. Returns what was done,
    ``finished`` or ``undone``, by publication.
    """
    intents, done = _Intents(spark), {}
    for name, state, age, entries in intents.open():
        if age < older_than * 1000:
            continue
        if state == "committed":
            _finish(spark, intents, name, entries)
        else:
            intents.remove(name, state)
            for entry in entries:
                drop_table(spark, entry["new"])
        done[name] = "finished" if state == "committed" else "undone"
    return done


@operator("published_table")
def published_table(spark: SparkSession, table: str) -> DataFrame:
    """A table as the last committed publication left it, also while its names are still being swapped."""
    for _, state, _, entries in _Intents(spark).open():
        for entry in entries:
            if state == "committed" and entry["table"] == table and spark.catalog.tableExists(entry["new"]):
                return spark.table(entry["new"])
    return spark.table(table)


@operator("publish")
def publish(spark: SparkSession, frames: Mapping[str, DataFrame], dry_run: bool = False) -> dict[str, DataFrame]:
    """All-or-nothing publication of a step's tables.

    Every frame is first written to a staging table, so a frame may read the table it replaces. A table of the same
    columns keeps its partitioning, buckets and properties; one whose columns change keeps the partition columns that
    are left. The names are written to an intent file before, and the rename of that file commits all tables at once: a
    session that dies before it has changed nothing, and after it the next one completes the swap of names
    (:func:`recover_publications`; a publication of the same tables does so itself). :func:`published_table` reads the new
    state from the commit on. ``dry_run`` writes nothing.
    """
    if dry_run:
        return dict(frames)
    intents, suffix = _Intents(spark), uuid.uuid4().hex[:12]
    for name, state, _, entries in intents.open():
        if state == "committed" and {entry["table"] for entry in entries} & set(frames):
            _finish(spark, intents, name, entries)
    entries = [{"table": table, "new": f"{table}__new_{suffix}", "old": f"{table}__old_{suffix}"} for table in frames]
    try:
        intents.write(suffix, entries)
        for entry in entries:
            _write_like(spark, frames[entry["table"]], entry["new"], entry["table"])
        intents.commit(suffix)
    except Exception:
        for entry in entries:
            drop_table(spark, entry["new"])
        intents.remove(suffix, "prepared")
        raise
    _finish(spark, intents, suffix, entries)
    return {table: spark.table(table) for table in frames}


@operator("ddl_from_schema")
def ddl_from_schema(schema: T.StructType, table: str | None = None) -> str:
    """Column list or CREATE TABLE text of a schema."""
    columns = ", ".join(f"{safe_identifier(field.name)} {field.dataType.simpleString()}" for field in schema.fields)
    return f"CREATE TABLE {_sql_name(table)} ({columns})" if table else f"({columns})"
