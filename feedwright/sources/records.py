"""Records of text files: heads of files, leading rows dropped, and quoted newlines read by many tasks.

Whether a line begins inside quotes depends on all lines before it. Each split of a file is scanned for both answers, a
fold over one row per split fixes its first state, and then each task cuts the records of its own splits. Only the pieces
of records that cross a split are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

HEAD_STEP = 64 << 10


def readable_by_arrow(path: str) -> bool:
    """Whether executors can open the path themselves; other stores only Spark's readers reach."""
    import pyarrow.fs

    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def first_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """(path, line): the first line of each file that has one. Of each file only the head is read, until its first newline.

    Files in a store that executors cannot open themselves are read by Spark, whole.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    some = listed.where("length > 0").first()
    if some is None or not readable_by_arrow(some["path"]):
        lines = spark.read.text(paths, recursiveFileLookup=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_position"), _decoded(encoding),
        )
        return lines.where("_start = 0").groupBy("path").agg(F.min_by("value", "_position").alias("line"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        import pyarrow.fs

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, inside = pyarrow.fs.FileSystem.from_uri(path)
                head = b""
                with system.open_input_stream(inside, compression=None, buffer_size=HEAD_STEP) as source:
                    source = gzip.GzipFile(fileobj=source) if path.endswith(".gz") else source
                    while True:
                        step = source.read(HEAD_STEP)
                        head += step
                        text = head.decode(encoding, errors="replace")
                        line = text.splitlines()[:1]
                        if not step or len(text.splitlines()) > 1:
                            break
                found.append(line[0] if line else "")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "line"])

    return listed.where("length > 0").select("path").mapInArrow(heads, "path string, line string")


def ends_inside(line: str, inside: bool, sep: str, quote: str, escape: str | None) -> bool:
    """Whether the line ends within a quoted cell, given whether it begins in one.

    A quote opens a cell only as its first character; elsewhere in an unquoted cell it is plain text. A quoted cell ends at
    its first quote that is neither escaped nor, where the quote escapes itself, doubled.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line.startswith(quote, at):
                inside, at = True, at + 1
            else:
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
        while True:
            end = line.find(quote, at)
            skip = line.find(escape, at) if escape and escape != quote else -1
            if 0 <= skip < end:
                at = skip + 2
                continue
            if end < 0:
                return True
            if escape == quote and line.startswith(quote, end + 1):
                at = end + 2
                continue
            break
        inside, at = False, line.find(sep, end + 1)
        if at < 0:
            return False
        at += len(sep)


def _source_lines(spark: SparkSession, paths, encoding: str | None, eol: str | None) -> DataFrame:
    """Lines with their split. Spark cuts bytes at line ends, so an encoding must have ASCII's; UTF-16 has not."""
    reader = spark.read.option("lineSep", eol) if eol else spark.read
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("last"),
        _decoded(encoding),
    )


def _decoded(encoding: str | None) -> Column:
    if not encoding or encoding.lower() in ("utf-8", "utf8", "us-ascii"):
        return F.col("value")
    if encoding.lower().startswith(("utf-16", "utf-32")):
        raise ValueError(f"lines of {encoding} cannot be told apart")
    return F.decode(F.col("value").cast("binary"), encoding).alias("value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, bool], pa.RecordBatch]]:
    """Stretches of one split within the batches, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # A task reads one split after the other, so a change of file or start begins a new one.
        file, start = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("start").to_numpy()
        bounds = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for low, high in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
            split = tuple(batch.column(name)[int(low)].as_py() for name in ("file", "start", "last"))
            yield split, batch.slice(low, high - low)


def drop_leading_lines(spark: SparkSession, paths: str | Sequence[str], n: int, encoding: str | None = None, eol: str | None = None) -> DataFrame:
    """(file, value): the lines of each file but its first ``n``, in one pass and without a copy.

    The lines dropped must lie in the first split of their file; a file whose first split holds fewer is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for split, piece in _runs(batches):
            if split[:2] != (current or (None, None))[:2]:
                _whole(current, left)
                current, left = split, n if split[1] == 0 else 0
            gone = min(left, piece.num_rows)
            left -= gone
            if gone < piece.num_rows:
                yield piece.slice(gone).select(["file", "value"])
        _whole(current, left)

    return _source_lines(spark, paths, encoding, eol).mapInArrow(run, "file string, value string")


def _whole(split: tuple[str, int, bool] | None, left: int) -> None:
    if split and left and not split[2]:
        raise ValueError(f"the leading rows of {split[0]} go beyond its first split; set larger splits")


def quoted_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    sep: str = ",",
    quote: str = '"',
    escape: str | None = "\\",
    skip_rows: int = 0,
    header: bool = False,
    encoding: str | None = None,
    eol: str | None = None,
) -> DataFrame:
    """(file, value): records of delimited files whose quoted cells may hold newlines, read by one task per split.

    ``skip_rows`` lines, and with ``header`` the first record after them, are left out of every file; they must lie in its
    first split. Lines end with ``eol``, else with a newline that a carriage return may precede; inside cells the newline
    stays. A record longer than a split is put together in one task, as it must be.
    """
    lines, newline = _source_lines(spark, paths, encoding, eol or "\n"), eol or "\n"
    if not eol:
        lines = lines.withColumn("value", F.regexp_replace("value", r"\r\z", ""))

    def after_skip(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, np.ndarray]]:
        """(split, lines, places of those with a quote), the skipped lines left out."""
        current, left = None, 0
        for split, piece in _runs(batches):
            if split[:2] != (current or (None, None))[:2]:
                _whole(current, left)
                current, left = split, skip_rows if split[1] == 0 else 0
            gone = min(left, piece.num_rows)
            left -= gone
            values = piece.column("value").slice(gone)
            yield split, values, np.flatnonzero(pc.match_substring(values, quote).to_numpy(zero_copy_only=False))
        _whole(current, left)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list[bool]] = {}
        for split, values, marked in after_skip(batches):
            both = ends.setdefault(split[:2], [False, True])
            for line in values.take(pa.array(marked)).to_pylist():
                both[:] = [ends_inside(line, state, sep, quote, escape) for state in both]
        columns = [[key[0] for key in ends], [key[1] for key in ends], *[[both[k] for both in ends.values()] for k in (0, 1)]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["file", "start", "from_outside", "from_inside"])

    # One row per split, as in the list that the driver holds for any scan of these files.
    states: dict[tuple[str, int], bool] = {}
    found = lines.mapInArrow(scan, "file string, start bigint, from_outside boolean, from_inside boolean").collect()
    file, inside = None, False
    for row in sorted(found, key=lambda row: (row["file"], row["start"])):
        inside = inside and row["file"] == file
        file = row["file"]
        states[file, row["start"]] = inside
        inside = row["from_inside"] if inside else row["from_outside"]
    known = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and pieces of those that cross a split: the ``head`` of one, the ``tail`` of an earlier one."""
        names, kinds = ["file", "value", "piece", "start"], [pa.string(), pa.string(), pa.string(), pa.int64()]
        current, inside, began_here, first = None, False, False, False
        waiting: list[str] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def left_open() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield made([(current[0], newline.join(waiting), "head" if began_here else "tail", current[1])])
                waiting.clear()

        for split, values, marked in after_skip(batches):
            if current is None or split[:2] != current[:2]:
                yield from left_open()
                current, inside, first = split, known.value[split[:2]], header and split[1] == 0
                began_here = not inside
            if not len(marked) and not inside and not first:
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([split[0]] * n, pa.string()), values, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
                continue
            rows, quotes = [], set(marked.tolist())
            for k, line in enumerate(values.to_pylist()):
                waiting.append(line)
                if k in quotes:
                    inside = ends_inside(line, inside, sep, quote, escape)
                if not inside:
                    if first:
                        first = False
                    else:
                        rows.append((split[0], newline.join(waiting), *((None, None) if began_here else ("tail", split[1]))))
                    waiting.clear()
                    began_here = True
            if rows:
                yield made(rows)
        yield from left_open()

    cut_rows = lines.mapInArrow(cut, "file string, value string, piece string, start bigint")
    whole = cut_rows.where("piece is null").select("file", "value")
    # Heads and tails: at most two per split. Tails that follow a head, up to the next head, belong to it.
    order = Window.partitionBy("file").orderBy("start", F.col("piece") == "head")
    pieces = cut_rows.where("piece is not null").withColumn("record", F.count_if(F.col("piece") == "head").over(order))
    joined = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    crossing = joined.select("file", F.array_join(F.transform("parts", lambda part: part["value"]), newline).alias("value"))
    return whole.unionByName(crossing)
