"""WARC archives as Zstandard files with a dictionary in front, written and read back.

An archive starts with a skippable frame that holds the dictionary, followed by one frame per record, so every record
can be decoded alone. The reader loads the dictionary from that frame, decodes frame by frame, and validates the version
line, the required headers and every length; what does not hold raises.

Tasks write archives under names of their own to the shared folder and report them in a manifest that is staged, so a
repeated task leaves an unread file behind and nothing is read twice.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedwright.llm.common import chunks, query, table
from feedwright.staging import scratch_path, stage

# Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MIN_SHARED_BYTES = 100
# Payload in one archive, dictionary size and the sample it is made from, per archive.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 200
RECORD_DATE = "2024-01-15T00:00:00Z"

MANIFEST = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    if not (record_id.startswith("<urn:page:") and record_id.endswith(">")):
        raise ValueError(f"record id {record_id!r}")
    name = record_id[10:-1]
    return None if name == "none" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries digest and length of the payload, not the payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", RECORD_DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        # A header is one line; what would end it, and the escape itself, is percent-encoded.
        lines.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    lines.append(("Content-Length", str(len(block))))
    head = b"\r\n".join([VERSION, *[f"{name}: {value}".encode() for name, value in lines]])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one validated record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not blank:
        raise ValueError("not a WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(": ")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad or repeated header line {line[:80]!r}")
        fields[name.lower()] = value
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("content length does not match the record")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/1."):
        raise ValueError("block is no HTTP response")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    size = int(fields["x-payload-length"])
    if kind == "response":
        if len(payload) != size or f"sha256:{hashlib.sha256(payload).hexdigest()}" != digest:
            raise ValueError("payload does not match its length and digest")
        refers = None
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
            raise ValueError("revisit without profile or reference, or with a payload")
        refers = _page_of(fields["warc-refers-to"])
    else:
        raise ValueError(f"record type {kind!r}")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest.removeprefix("sha256:"),
        "refers_to": refers,
        "payload": payload if kind == "response" else None,
    }


def _dictionary(samples: list[bytes]) -> bytes:
    """Raw content dictionary: the starts of the first records, where headers and page templates are."""
    data = b"".join(sample[:1024] for sample in samples)[-DICTIONARY_BYTES:]
    return data if len(data) >= 8 else data.ljust(8, b" ")


def write_archive(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Write records as one archive; returns (records, payload bytes taken)."""
    import itertools

    import zstandard

    first = list(itertools.islice(records, SAMPLE_RECORDS))
    raw = _dictionary(first)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=True)
    n = size = 0
    for record in itertools.chain(first, records):
        out.write(compressor.compress(record))
        n, size = n + 1, size + len(record)
    return n, size


def read_archive(source) -> Iterator[dict]:
    """Records of an open archive, one decoded frame at a time."""
    import zstandard

    head = source.read(8)
    if len(head) != 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    size = struct.unpack("<I", head[4:])[0]
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut short")
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    pending = b""
    while True:
        data = pending or source.read(1 << 20)
        if not data:
            return
        frame, parts, pending = decoder.decompressobj(), [], b""
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                pending = frame.unused_data
                break
            data = source.read(1 << 20)
            if not data:
                raise ValueError("the last frame is cut short")
        yield parse_record(b"".join(parts))


def first_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``first``, the smallest page id of an equal payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    given = pages.withColumn("digest", F.sha2(payload, 256)).withColumn("size", F.octet_length(payload))
    shared = (
        given.where(F.col("size") >= MIN_SHARED_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # A payload of very many pages is spread over salted keys; few payloads are shared at all.
    salts = 16
    salted = shared.select(
        F.col("digest").alias("_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    key = F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")
    return given.join(salted, (F.col("digest") == F.col("_digest")) & (key == F.col("_salt")), "left").drop("_digest", "_salt")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages as archives below ``path``; returns the staged manifest.

    Of equal payloads of at least 100 bytes the records with the smallest page id are responses and the others revisit
    it (a page id that occurs more than once is a response each time); NULL page ids count as largest, and a payload
    that only such pages have is a response each time. A null html is an empty payload.
    """
    given = first_pages(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).drop("digest", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for chunk in chunks(batch, "html"):
                    columns = [chunk.column(name) for name in ("page_id", "url", "html", "first")]
                    for page_id, url, html, first in zip(*[column.to_pylist() for column in columns], strict=True):
                        payload = (html or "").encode()
                        revisit = first is not None and first != page_id
                        yield record_bytes(page_id, url, payload, first, revisit)

        def archive(stream):
            taken = 0
            for record in stream:
                taken += len(record)
                yield record
                if taken >= ARCHIVE_BYTES:
                    return

        import itertools

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        stream = records()
        for head in stream:
            name = f"{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                n, size = write_archive(out, archive(itertools.chain([head], stream)))
            yield pa.RecordBatch.from_pydict({"archive": [f"{path}/{name}"], "n_records": [n], "n_bytes": [size]})

    return stage(given.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the archives of a manifest; a wrong number of records raises."""
    schema = RECORD if with_payload else T.StructType([f for f in RECORD.fields if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string()}.get(f.dataType.simpleString(), pa.binary())) for f in schema.fields])
        for batch in batches:
            for place, expected in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, root = pyarrow.fs.FileSystem.from_uri(place)
                rows, size, n = [], 0, 0
                with fs.open_input_stream(root) as source:
                    for record in read_archive(source):
                        size += len(record["payload"] or b"") if with_payload else 100
                        rows.append({name: record[name] for name in kind.names})
                        n += 1
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{place} has {n} records, the manifest says {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    # One archive is one unit of work; a task takes few of them.
    archives = manifest.repartition(max(1, min(100_000, manifest.count())), "archive")
    return archives.mapInArrow(run, schema)


ORACLE = f"""
with p as (
    select page_id, row_number() over () as rid, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select html, min(page_id) as first from p where n >= {MIN_SHARED_BYTES} group by html having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest,
       case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when first is not null and first is distinct from page_id then first end as refers_to
from p left join f using (html)
"""


@query("op4_warc_archives", ORACLE)
def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
