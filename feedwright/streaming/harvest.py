"""Incremental ingestion of feed files.

The state is a list of file versions: path, modification time and length. A stream discovers new paths (no content is
read); a listing adds the versions of paths delivered again, which a stream does not report. A run takes the present
version of every file that the job log does not call complete in that version, whenever it was seen: matches file names
to feeds, orders all of them by extract date, and goes date by date, checking the load order against the log as it is
then, logging RUNNING with a lease, calling a handler for each feed (or file) of the date, and logging each outcome.
Files that failed, matched no feed or were in flight stay on the list for the next run; so do those of a run that died,
once its lease is over.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from feedwright.functions.dates import normalise_extract_date
from feedwright.functions.logic import first_case
from feedwright.operators.quality import datacop
from feedwright.operators.runlog import COMPLETE, ERROR, READY, RUNNING
from feedwright.registry import operator
from feedwright.sources.delimited import read_delimited, write_csv
from feedwright.sources.records import first_lines
from feedwright.staging import stage

EXTRACT_DATE = "EXTRACT_DATE"
FILES_PER_BATCH = 1000
LEASE_SECONDS = 3600
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), True),
        T.StructField("modificationTime", T.TimestampType(), True),
        T.StructField("length", T.LongType(), True),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def _positions(control: Row, file: Column) -> Column:
    """Capture groups of a control row's regex by position name."""
    pattern = f"(?i){control['file_regex']}"
    groups = re.compile(control["file_regex"]).groups
    pairs: list[Column] = []
    named = [(int(field[4:]), control[field]) for field in control.__fields__ if re.fullmatch(r"pos_\d+", field)]
    for index, name in sorted(named):
        if not name:
            continue
        if index <= groups:
            value = F.nullif(F.regexp_extract(file, pattern, index), F.lit(""))
        else:
            # A regex without groups captures 1.
            value = F.lit("1" if not groups and index == 1 else None).cast("string")
        pairs += [F.lit(name), value]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


@operator("match_file_patterns")
def match_file_patterns(files: DataFrame, control: DataFrame | Sequence[Row]) -> DataFrame:
    """Files with the feed whose regex matches their name; files that match none are left out.

    Regexes are unanchored and ignore case; the lowest one that matches wins, and a pattern with a record length also
    needs the file's ``first_line_length`` to be equal. Capture groups are named by the columns ``pos_1``, ``pos_2`` and so on. The control
    table is configuration, one row per feed: its patterns become one CASE projection over the files, so files and
    patterns are never joined.
    """
    rows = control.collect() if isinstance(control, DataFrame) else list(control)
    rows = sorted(rows, key=lambda row: row["file_regex"])
    file = F.col("file")

    def hits(row: Row) -> Column:
        named = file.rlike(f"(?i){row['file_regex']}")
        wanted = row["record_length"] if "record_length" in row else None
        return named & (F.col("first_line_length") == wanted) if wanted else named

    which = first_case([(hits(row), F.lit(index)) for index, row in enumerate(rows)], F.lit(None).cast("int"))
    matched = files.withColumn("_which", which).where(F.col("_which").isNotNull())

    def chosen(value, kind: str) -> Column:
        cases = [(F.col("_which") == index, value(row)) for index, row in enumerate(rows)]
        return first_case(cases, F.lit(None).cast(kind)).cast(kind)

    def check(row: Row) -> Column:
        return F.lit(int((row["perform_load_order_check"] if "perform_load_order_check" in row else 0) or 0))

    return matched.select(
        *files.columns,
        chosen(lambda row: F.lit(row["file_regex"]), "string").alias("file_regex"),
        chosen(lambda row: F.lit(row["processing_group_name"]), "string").alias("processing_group_name"),
        chosen(check, "int").alias("perform_load_order_check"),
        chosen(lambda row: _positions(row, file), "map<string,string>").alias("attributes"),
    )


@operator("route_by_record_length")
def route_by_record_length(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, first_line_length): length of the first line of each file, for patterns with a record length.

    Of each file only the head is read.
    """
    return first_lines(spark, paths).select("path", F.length("line").alias("first_line_length"))


@operator("order_by_extract_date")
def order_by_extract_date(matched: DataFrame, now: Column | None = None, ordered: bool = True) -> DataFrame:
    """Files with their extract date, earlier dates first, by file name within a date.

    A missing or unreadable date counts as now, unless the feed's load order is checked: then it is an error.
    """
    text = F.try_element_at("attributes", F.lit(EXTRACT_DATE))
    moment = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    parsed = normalise_extract_date(text)
    required = F.col("perform_load_order_check") == 1
    # The message is the only thing evaluated for a required date that cannot be read.
    date = F.when(parsed.isNotNull(), parsed).when(
        required, F.raise_error(F.concat(F.lit("no extract date in file name "), F.col("file"))).cast("string")
    ).otherwise(moment)
    dated = matched.withColumn("extract_date", date)
    return dated.orderBy("extract_date", "file") if ordered else dated


@operator("load_gap")
def load_gap(log: DataFrame, files: DataFrame, feed: str = "processing_group_name") -> DataFrame:
    """Load-order verdict per file against the run log.

    ``log`` has (feed, job_id, extract_ts, status) and ``files`` (feed, extract_ts, …). Relative to the last complete
    run of the feed: FIRST without one; ERROR_OLDER before it; OK on the next day; otherwise a gap, which is ERROR_GAP
    when an incomplete run lies in between and WARNING_GAP when none does. Whether one lies in between only depends on
    the earliest incomplete run after the last success, so the log is folded to one row per feed and never paired with
    the files.
    """
    done = F.col("status") == COMPLETE
    last = log.groupBy(feed).agg(F.max_by("extract_ts", F.when(done, F.col("job_id"))).alias("last_success"))
    after = (
        log.where(~done)
        .join(last, feed)
        .where(F.col("extract_ts") > F.col("last_success"))
        .groupBy(feed)
        .agg(F.min("extract_ts").alias("first_incomplete"))
    )
    facts = last.where(F.col("last_success").isNotNull()).join(after, feed, "left")
    here = F.col("extract_ts")
    verdict = (
        F.when(F.col("last_success").isNull(), "FIRST")
        .when(F.col("last_success") > here, "ERROR_OLDER")
        .when(F.date_add(F.col("last_success").cast("date"), 1) == here.cast("date"), "OK")
        .when(F.col("first_incomplete") < here, "ERROR_GAP")
        .otherwise("WARNING_GAP")
    )
    return files.join(facts, feed, "left").withColumn("verdict", verdict)


@operator("check_load_order")
def check_load_order(log: DataFrame, files: DataFrame, feed: str = "processing_group_name") -> DataFrame:
    """As :func:`load_gap`; raises when a file that must be checked has an error verdict."""
    judged = load_gap(log, files, feed)
    wrong = judged.where(F.startswith("verdict", F.lit("ERROR")) & (F.col("perform_load_order_check") == 1)).first()
    if wrong is not None:
        raise ValueError(f"load order: {wrong['verdict']} for {wrong['file']}, last success {wrong['last_success']}")
    return judged


@operator("skip_in_flight")
def skip_in_flight(files: DataFrame, log: DataFrame, now: Column | None = None) -> DataFrame:
    """Files without a READY or RUNNING job of the same feed and file name.

    Where the log has a column ``lease_until``, a job whose lease is over by ``now`` no longer holds its file: whoever ran
    it is gone. A job without a lease holds it until its status changes.
    """
    held = F.col("status").isin(READY, RUNNING)
    if "lease_until" in log.columns:
        moment = now if now is not None else F.current_timestamp()
        held = held & (F.col("lease_until").isNull() | (F.col("lease_until") > moment))
    busy = log.where(held).select("processing_group_name", F.col("identifier").alias("file")).distinct()
    return files.join(busy, ["processing_group_name", "file"], "left_anti")


def files_of(batch: DataFrame) -> DataFrame:
    """Path, file name, size and modification time of discovered files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("file")
    return batch.select("path", name, F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def list_versions(spark: SparkSession, incoming: str) -> DataFrame:
    """(path, modificationTime, length) of the files that are in the folder now; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(incoming)
    return listed.select("path", "modificationTime", "length")


def file_stream(spark: SparkSession, incoming: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of new files, at most ``max_files`` in a micro-batch."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
    )
    return reader.load(incoming).select("path", "modificationTime", "length")


@operator("discover_files")
def discover_files(spark: SparkSession, incoming: str, checkpoint: str, max_files: int = FILES_PER_BATCH) -> StreamingQuery:
    """Add all files that arrived since the last call to the list of files seen, then stop.

    A repeated micro-batch replaces its own part of the list.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{_seen(checkpoint)}/seen_in={batch_id}")

    return (
        file_stream(spark, incoming, max_files)
        .writeStream.option("checkpointLocation", f"{checkpoint}/discovery")
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )


def _seen(checkpoint: str) -> str:
    return f"{checkpoint}/seen"


VERSION = "path string, modificationTime timestamp, length bigint"


def waiting_versions(listed: DataFrame, seen: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions to process, versions new to the list of files seen).

    To process is what is in the folder now and seen, or delivered again since, without a complete job of that version. A
    job or a list entry without a version, from before versions were kept, stands for any.
    """
    path = _plain_path("path").alias("path")
    listed = listed.select(path, "modificationTime", "length")
    same = (F.col("here.modificationTime") == F.col("there.modificationTime")) & (F.col("here.length") == F.col("there.length"))
    same = (F.col("here.path") == F.col("there.path")) & (F.col("there.modificationTime").isNull() | same)
    here = listed.alias("here")
    seen = seen.select(path, "modificationTime", "length").distinct()
    known = here.join(seen.select("path").distinct(), "path", "left_semi").alias("here")
    again = known.join(seen.alias("there"), same, "left_anti")
    done = log.where(F.col("status") == COMPLETE).select(path, F.col("modified").alias("modificationTime"), F.col("size").alias("length"))
    waiting = known.join(done.distinct().alias("there"), same, "left_anti")
    return waiting, again


def _read_if_there(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # no folder before the first write
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


Handler = Callable[[SparkSession, str, list[Row], int], None]


@operator("harvest_stream")
def harvest_stream(
    spark: SparkSession,
    incoming: str,
    control: DataFrame,
    checkpoint: str,
    handler: Handler,
    log_path: str | None = None,
    max_files: int = FILES_PER_BATCH,
    archive: str | None = None,
    dry_run: bool = False,
    group: str | None = None,
    job_per: str = "feed",
    parallel: int = 1,
    lease_seconds: int = LEASE_SECONDS,
) -> DataFrame:
    """Process all waiting files; returns the jobs of this run (path, feed, file, extract_date, batch_id, status).

    ``handler(spark, extract_date, files, batch_id)`` is called for each feed of an extract date, or with ``job_per="file"``
    for each file, dates ascending over all waiting files whatever ``max_files`` is; ``files`` are the rows of that call.
    Of one date up to ``parallel`` calls run at once. The job log is ``log_path`` or a folder beside the checkpoint. When a
    call fails the other calls of its date still run and keep their outcome; then, or at an error verdict of the load
    order, the run ends with that error and the rest waits. Job ids grow with time and do not depend on any setting.

    A file delivered again under its name, with another time or length, is a new version and is processed again. A job that
    began holds its files for ``lease_seconds``, which no call may exceed; a later run takes over what a dead one left.

    ``archive`` moves a file there once it is complete, to the same place below it as below ``incoming``; where another
    version lies there already, its time is added to the name. ``group`` takes only the control rows with that
    ``grouping_code``. ``dry_run`` lists what is in the folder now and returns the files in their order with status
    ``PLANNED``; it checks the first date and changes no state.
    """
    log_path = log_path or f"{checkpoint}/jobs"
    log = read_log(spark, log_path)
    if dry_run:
        listed = list_versions(spark, incoming)
        waiting, _ = waiting_versions(listed, listed, log)
    else:
        stream = discover_files(spark, incoming, checkpoint, max_files)
        stream.awaitTermination()
        if stream.exception() is not None:
            raise stream.exception()
        seen = _read_if_there(spark, VERSION, _seen(checkpoint))
        waiting, again = waiting_versions(list_versions(spark, incoming), seen, log)
        again = stage(again, "again")
        if not again.isEmpty():
            again.write.parquet(f"{_seen(checkpoint)}/seen_in=again-{time.time_ns()}")
    rows = [row for row in control.collect() if group is None or row["grouping_code"] == group]
    files = files_of(waiting)
    if any(row["record_length"] for row in rows if "record_length" in row):
        # Only files that match a feed by name are opened.
        names = [row.asDict() | {"record_length": None} for row in rows]
        named = match_file_patterns(files, [Row(**row) for row in names]).select(*files.columns)
        paths = [row["path"] for row in named.select("path").toLocalIterator()]
        lengths = route_by_record_length(spark, paths) if paths else spark.createDataFrame([], "path string, first_line_length int")
        files = named.join(lengths.withColumn("path", _plain_path("path")), "path", "left")
    dated = skip_in_flight(order_by_extract_date(match_file_patterns(files, rows), ordered=False), log)
    # The log changes while the run goes on; what is to be done does not.
    plan = stage(dated.withColumn("extract_ts", F.col("extract_date").try_cast("timestamp")), "harvest")
    jobs: list[tuple] = []
    ordered = plan.orderBy("extract_date", "file", "path").toLocalIterator()
    for date, dated_files in itertools.groupby(ordered, key=lambda row: row["extract_date"]):
        chosen = list(dated_files)
        if not dry_run or not jobs:
            past = read_log(spark, log_path).where(F.col("status").isin(COMPLETE, ERROR))
            check_load_order(past, plan.where(F.col("extract_date") == date))
        batch_id = time.time_ns() // 1000
        found = [
            (batch_id + n, row["processing_group_name"], row["file"], row["path"], date) for n, row in enumerate(chosen)
        ]
        if dry_run:
            jobs += [(*job, batch_id, "PLANNED") for job in found]
            continue
        versions = [(row["modified"], row["size"]) for row in chosen]
        write_log(spark, log_path, batch_id, [(*job, RUNNING) for job in found], versions, lease_seconds)
        unit = "processing_group_name" if job_per == "feed" else "path"
        calls: dict[str, list[int]] = {}
        for n, row in enumerate(chosen):
            calls.setdefault(row[unit], []).append(n)

        def attempt(own: list[int]) -> Exception | None:
            try:
                handler(spark, date, [chosen[n] for n in own], found[own[0]][0])
            except Exception as error:
                return error
            return None

        status = [ERROR] * len(chosen)
        try:
            with ThreadPoolExecutor(parallel) as pool:
                outcomes = list(pool.map(attempt, calls.values()))
            for own, error in zip(calls.values(), outcomes, strict=True):
                for n in own:
                    status[n] = ERROR if error else COMPLETE
        finally:
            write_log(spark, log_path, batch_id, [(*job, end) for job, end in zip(found, status, strict=True)], versions)
        if archive:
            _move(spark, [row for row, end in zip(chosen, status, strict=True) if end == COMPLETE], incoming, archive)
        jobs += [(*job, batch_id, end) for job, end in zip(found, status, strict=True)]
        for error in outcomes:
            if error:
                raise error
    schema = (
        "job_id bigint, processing_group_name string, file string, path string, extract_date string, batch_id bigint, "
        "status string"
    )
    return spark.createDataFrame(jobs, schema)


def _move(spark: SparkSession, rows: Sequence[Row], incoming: str, target: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    top = hadoop.Path(incoming)
    system = top.getFileSystem(conf)
    top = system.makeQualified(top).toUri().getPath()
    for row in rows:
        source = hadoop.Path(row["path"])
        inside = source.toUri().getPath()
        inside = inside.removeprefix(top.rstrip("/") + "/") if inside.startswith(top.rstrip("/") + "/") else source.getName()
        place = hadoop.Path(target, inside)
        if system.exists(place):
            place = hadoop.Path(target, f"{inside}.{row['modified']:%Y%m%dT%H%M%S%f}")
        system.mkdirs(place.getParent())
        if not system.rename(source, place):
            raise OSError(f"complete, but not moved to {place}: {row['path']}")


def _plain_path(name: str) -> Column:
    return F.regexp_replace(F.col(name), r"^file:/+", "/")


LOG = (
    "job_id bigint, processing_group_name string, identifier string, path string, {} status string, "
    "modified timestamp, size bigint, lease_until timestamp"
)


def write_log(
    spark: SparkSession, log_path: str, batch_id: int, rows: list[tuple], versions: Sequence[tuple] | None = None, lease_seconds: int | None = None
) -> None:
    """Job rows of one extract date: the outcome replaces what was written when the jobs began.

    ``versions`` are (modification time, length) of the files. With ``lease_seconds`` the jobs hold their files so long.
    """
    versions = versions or [(None, None)] * len(rows)
    frame = spark.createDataFrame([(*row, *version, None) for row, version in zip(rows, versions, strict=True)], LOG.format("extract_date string,"))
    frame = frame.withColumn("extract_ts", F.col("extract_date").try_cast("timestamp"))
    if lease_seconds is not None:
        frame = frame.withColumn("lease_until", F.current_timestamp() + F.expr(f"interval {int(lease_seconds)} seconds"))
    frame.drop("extract_date").coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The job log; empty when there is none yet."""
    return _read_if_there(spark, LOG.format("") + ", extract_ts timestamp, batch_id bigint", log_path)


@operator("harvest_datacop")
def harvest_datacop(
    schemas: dict[str, T.StructType | str],
    output: str,
    max_issues: int | None = None,
    **read_options,
) -> Handler:
    """A handler that validates each feed's files into good and bad CSV sinks, keyed by feed, date and set of files.

    A date that is run again with the same files replaces what it wrote. Rows are validated once: the annotated rows
    are staged and both sinks are derived from them.
    """

    def handler(spark: SparkSession, date: str, files: list[Row], batch_id: int) -> None:
        by_feed = lambda row: row["processing_group_name"]
        for feed, feed_files in itertools.groupby(sorted(files, key=by_feed), key=by_feed):
            group = list(feed_files)
            schema = schemas[feed]
            names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
            rows = read_delimited(
                spark, [row["path"] for row in group], columns=names, corrupt=True, **read_options
            )
            result = datacop(rows, schema, job_id=batch_id, table=feed, max_issues=max_issues, staged=True)
            paths = sorted(row["path"] for row in group)
            part = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
            place = f"feed={feed}/extract_date={date.replace(':', '').replace(' ', 'T')}/files={part}"
            write_csv(result.good, f"{output}/good/{place}", upper_headers=False, mode="overwrite")
            write_csv(
                result.bad.withColumn("issues", F.to_json("issues")),
                f"{output}/bad/{place}",
                upper_headers=False,
                mode="overwrite",
            )

    return handler
