"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix is told apart by its first ``LENGTH`` bytes only. Its q-gram buckets carry 64-bit identifiers (a hash of the q
bytes), and refining a suffix by the identifiers at later offsets of the same text gives the bucket of its first 100
bytes; the identifiers are made once per text and reused at every offset and refinement.

Sorting every suffix of a corpus would move eight times its bytes, so buckets are refined in two rounds of growing
depth and shrinking size:

1. Every 100-byte window elects the q-gram with the least identifier in it (leftmost on ties). Equal windows elect equal
   grams, so windows meet in the bucket of their gram. Consecutive windows with one elected gram form a stretch, of
   which there is about one in (100 - q) / 2 bytes. Within the bucket, stretches are refined by the identifiers at both
   of their ends, which cover all their bytes: of equal ones all but the first are repeats as a whole. A first one in a
   bucket with other stretches stays open.
2. Open stretches are taken apart into their windows, and these are refined by the identifiers at the offsets
   0, 32, 36 and 68, which cover 100 bytes: all but the first of equal ones are repeats.

What must be first is known locally for what lies in one task, so a bucket receives at most one of equal entries per
task, and a gram with many stretches in a task skips the bucket and opens them at once: common strings load no task.
Identifiers are 64 bits wide; unequal strings share one with a probability of 2**-64 per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedwright.llm.common import query, table
from feedwright.staging import stage

LENGTH = 100
GRAM = 32
# Offsets whose q-grams cover a window.
OFFSETS = (0, 32, 36, 68)
SPAN = LENGTH - GRAM  # q-gram positions of a window, less one
SEGMENT_BYTES = 4 << 20
# Entries that a task gathers before it sends them, and that one bucket is meant to hold.
FLUSH_ENTRIES = 1_500_000
BUCKET_ENTRIES = 1_000_000
# Stretches of one gram that a task sends to the bucket before it opens them itself.
GRAM_ENTRIES = 64

REPEAT, OPEN, ENTRIES = 0, 1, 2
NO_ID = (1 << 63) - 1  # stands for a NULL id, which sorts last

# What travels between tasks: kind, the bucket or (for marks) the group of documents it goes to, packed arrays.
SENT = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType())]
)
SENT_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
# Runs of one document.
MARKED = "did long, digest long, repeats binary, opened binary"
MARKED_ARROW = pa.schema([("did", pa.int64()), ("digest", pa.int64()), ("repeats", pa.binary()), ("opened", pa.binary())])
RUN = np.dtype([("start", "<i8"), ("end", "<i8")])  # first and last window start
ENTRY = np.dtype([("gram", "<u4"), ("key", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("width", "u1"), ("open", "u1")])
PLACE = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4")])

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Grams:
    """Identifiers of the q-grams of byte arrays up to a given size, as products of powers of an odd base."""

    def __init__(self):
        self.table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.power = self.inverse = np.zeros(0, dtype=np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n < GRAM:
            return np.zeros(0, dtype=np.uint64)
        if len(self.power) < n:
            size = max(n, SEGMENT_BYTES + (1 << 16))
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=sums[1:])
        grams = sums[GRAM:] - sums[:-GRAM]
        grams *= self.inverse[: n - GRAM + 1]
        return _mixed(grams)


def windows(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-byte windows at the given places: q-gram buckets refined at the later offsets."""
    first = _mixed(grams[at + OFFSETS[0]] * np.uint64(3) ^ grams[at + OFFSETS[1]])
    later = _mixed(grams[at + OFFSETS[2]] * np.uint64(3) ^ grams[at + OFFSETS[3]])
    return _mixed(first * np.uint64(5) ^ later)


def _elected(grams: np.ndarray) -> np.ndarray:
    """For every window the place of its least q-gram."""
    place = np.uint64((1 << 24) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & place).astype(np.int64)


def _segments(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, segment places, documents, offsets in them): texts joined, long ones cut with an overlap."""
    parts: list[bytes] = []
    places, docs, offsets, size = [], [], [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), SEGMENT_BYTES):
            part = text[offset : offset + SEGMENT_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > SEGMENT_BYTES:
                yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(places), np.array(docs), np.array(offsets)
                parts, places, docs, offsets, size = [], [], [], [], 0
            parts.append(part)
            places.append(size)
            docs.append(number)
            offsets.append(offset)
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(places), np.array(docs), np.array(offsets)


def stretches(maker: Grams, texts: Sequence[bytes]) -> dict[str, np.ndarray]:
    """All stretches of some texts: gram, key, doc (number of the text), start (of the first window), width (to the last)."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("gram", "key", "doc", "start", "width")}
    for data, places, docs, offsets in _segments(texts):
        grams = maker.of(data)
        elected = _elected(grams)
        counts = np.diff(np.append(places, len(data))) - LENGTH + 1
        valid = np.arange(counts.sum()) + np.repeat(places - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        anchor = elected[valid]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        start, end = valid[first], valid[last]
        which = np.searchsorted(places, start, side="right") - 1
        width = (end - start).astype(np.uint64)
        out["gram"].append(grams[anchor[first]])
        out["key"].append(_mixed(windows(grams, start) * np.uint64(7) ^ windows(grams, end) + width))
        out["doc"].append(docs[which])
        out["start"].append(start - places[which] + offsets[which])
        out["width"].append(width.astype(np.int64))
    empty = {"gram": np.uint64, "key": np.uint64}
    return {name: np.concatenate(v) if v else np.zeros(0, dtype=empty.get(name, np.int64)) for name, v in out.items()}


def _ranks(did: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Dense order of documents; rows that repeat one share a rank."""
    order = np.lexsort((digest, did))
    new = np.concatenate([[True], (did[order][1:] != did[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
    ranks = np.empty(len(did), dtype=np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


def _later(group: Sequence[np.ndarray], rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of entries after the first of their group, mask of one first entry per group)."""
    order = np.lexsort((start, rank, *group[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for values in group:
        new[1:] |= values[order][1:] != values[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later, first = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    later[order] = (rank[order] > rank[head]) | ((rank[order] == rank[head]) & (start[order] > start[head]))
    first[order[new]] = True
    return later, first


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs by document and start, those that touch or overlap joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # A document's runs are apart from the others' in this order, so one running maximum serves all.
    shift = doc.astype(np.int64) << 33
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1] + 1])
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - shift)[np.append(at[1:], len(end)) - 1]


def _marks(kind: int, did: np.ndarray, digest: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Runs of window starts for the groups of documents they belong to, one row per group."""
    if kind == REPEAT:
        doc, start, end = _joined(doc, start, end)
    places = np.empty(len(doc), dtype=PLACE)
    places["doc"], places["start"], places["end"] = doc, start, end
    # By id and digest: all copies of one text share the digest.
    home = _mixed(_mixed(did.view(np.uint64)) ^ digest.view(np.uint64)) % np.uint64(buckets)
    yield from _packed(kind, did, digest, places, home.astype(np.int64)[doc])


def _rows(rows: list[tuple], schema: pa.Schema = SENT_ARROW) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1000):
        columns = list(zip(*rows[at : at + 1000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _packed(kind: int, did: np.ndarray, digest: np.ndarray, records: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """One row per bucket: its records with the keys of the documents they name."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = records[a:b].copy()
        named, own["doc"] = np.unique(own["doc"], return_inverse=True)
        head = np.array([len(named)], dtype="<i8").tobytes() + did[named].tobytes() + digest[named].tobytes()
        # Columns apart, so that what repeats compresses.
        yield kind, int(bucket[a]), head + b"".join([own[name].tobytes() for name in own.dtype.names])


def _unpacked(rows: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, digests, records) of several packed rows together."""
    dids, digests, parts, before = [], [], [], 0
    for value in rows["data"]:
        data = value.as_py()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        dids.append(np.frombuffer(data, "<i8", n, 8))
        digests.append(np.frombuffer(data, "<i8", n, 8 + 8 * n))
        at = 8 + 16 * n
        count = (len(data) - at) // kind.itemsize
        records = np.empty(count, dtype=kind)
        for name in kind.names:
            records[name] = np.frombuffer(data, kind[name], count, at)
            at += count * kind[name].itemsize
        records["doc"] += before
        before += n
        parts.append(records)
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
    return np.concatenate(dids), np.concatenate(digests), np.concatenate(parts)


class _Sender:
    """Gathers the entries of a task and sends what its own documents cannot settle."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.did: list[int] = []
        self.digest: list[int] = []
        self.parts: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, did: Sequence[int], digest: Sequence[int], found: dict[str, np.ndarray]) -> None:
        found["doc"] = found["doc"] + len(self.did)
        self.did.extend(did)
        self.digest.extend(digest)
        self.parts.append(found)
        self.size += len(found["doc"])

    def flush(self, split: bool) -> Iterator[pa.RecordBatch]:
        if self.size:
            did, digest = np.array(self.did, dtype=np.int64), np.array(self.digest, dtype=np.int64)
            all_ = {name: np.concatenate([part[name] for part in self.parts]) for name in self.parts[0]}
            rank = _ranks(did, digest)[all_["doc"]]
            later, first = _later([all_["key"]], rank, all_["start"])
            rows = list(_marks(REPEAT, did, digest, all_["doc"][later], all_["start"][later], (all_["start"] + all_["width"])[later], self.buckets))
            at = np.flatnonzero(first)
            gram, opened = all_["gram"][at], np.zeros(len(at), dtype=bool)
            if split:
                _, which, counts = np.unique(gram, return_inverse=True, return_counts=True)
                many = counts[which] > GRAM_ENTRIES
                hot = at[many]
                rows += _marks(OPEN, did, digest, all_["doc"][hot], all_["start"][hot], (all_["start"] + all_["width"])[hot], self.buckets)
                # One of them tells the bucket that the gram occurs.
                told = np.zeros(len(at), dtype=bool)
                told[np.unique(which, return_index=True)[1]] = True
                opened = many
                at, gram, opened = at[~many | told], gram[~many | told], opened[~many | told]
            entries = np.empty(len(at), dtype=ENTRY)
            entries["gram"] = ((gram // np.uint64(self.buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for name in ("key", "doc", "start", "width"):
                entries[name] = all_[name][at]
            entries["open"] = opened
            rows += _packed(ENTRIES, did, digest, entries, (gram % np.uint64(self.buckets)).astype(np.int64))
            self.clear()
            yield from _rows(rows)


def _kind(group: pa.Table, kind: int) -> pa.Table:
    return group.filter(pa.compute.equal(group["kind"], kind))


def _bucket_task(buckets: int, split: bool):
    """Group function: settles the entries of one bucket and passes on the marks that travel with it."""

    def run(group: pa.Table) -> pa.Table:
        did, digest, own = _unpacked(_kind(group, ENTRIES), ENTRY)
        rows: list[tuple] = []
        if len(own):
            start, doc = own["start"].astype(np.int64), own["doc"].astype(np.int64)
            end = start + own["width"]
            later, first = _later([own["gram"], own["key"]], _ranks(did, digest)[doc], start)
            rows += _marks(REPEAT, did, digest, doc[later], start[later], end[later], buckets)
            if split:
                _, which, counts = np.unique(own["gram"], return_inverse=True, return_counts=True)
                classes = np.bincount(which, weights=first, minlength=len(counts))
                opened = np.bincount(which, weights=own["open"], minlength=len(counts))
                # The first of a class may be the one that its task has opened already.
                still = first & (own["open"] == 0) & ((classes[which] > 1) | (opened[which] > 0))
                rows += _marks(OPEN, did, digest, doc[still], start[still], end[still], buckets)
        passed = group.filter(pa.compute.not_equal(group["kind"], ENTRIES)).select(SENT_ARROW.names).cast(SENT_ARROW)
        return pa.concat_tables([passed, pa.Table.from_batches(_rows(rows), schema=SENT_ARROW)])

    return run


def _document_task(group: pa.Table) -> pa.Table:
    """Group function: the runs of each document of a group of documents."""
    found: dict[tuple[int, int], list[bytes | None]] = {}
    for slot, kind in enumerate((REPEAT, OPEN)):
        did, digest, places = _unpacked(_kind(group, kind), PLACE)
        if not len(places):
            continue
        rank = _ranks(did, digest)
        doc, start, end = rank[places["doc"]], places["start"].astype(np.int64), places["end"].astype(np.int64)
        if kind == REPEAT:
            doc, start, end = _joined(doc, start, end)
        else:
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
        runs = np.empty(len(doc), dtype=RUN)
        runs["start"], runs["end"] = start, end
        one = np.zeros(rank.max() + 1, dtype=np.int64)
        one[rank] = np.arange(len(rank))
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = one[doc[a]]
            found.setdefault((int(did[key]), int(digest[key])), [None, None])[slot] = runs[a:b].tobytes()
    rows = [(*key, *data) for key, data in found.items()]
    return pa.Table.from_batches(_rows(rows, MARKED_ARROW), schema=MARKED_ARROW)


def _marked(sent: DataFrame, buckets: int, split: bool) -> DataFrame:
    """What tasks have sent, settled by bucket and brought together by document."""
    settled = sent.groupBy("bucket").applyInArrow(_bucket_task(buckets, split), SENT)
    return settled.groupBy("bucket").applyInArrow(_document_task, MARKED)


def _keyed(docs: DataFrame, text: str, doc_id: str, row: bool = False) -> DataFrame:
    """Text as binary with the key of its document; with ``row`` all columns too."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    columns = [
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(body).alias("digest"),
        body.cast("binary").alias("body"),
    ]
    if row:
        columns.append(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    return docs.select(*columns)


def _texts(batch: pa.RecordBatch, limit: int = SEGMENT_BYTES) -> Iterator[tuple[list[int], list[int], list[bytes], int, int]]:
    """(ids, digests, texts, first row, past row) of slices of a batch."""
    did, digest = batch.column("did").to_pylist(), batch.column("digest").to_pylist()
    body = batch.column("body")
    sizes = pa.compute.binary_length(body).to_pylist()
    a = 0
    while a < len(did):
        b, total = a, 0
        while b < len(did) and (b == a or total + sizes[b] <= limit):
            total += sizes[b]
            b += 1
        yield did[a:b], digest[a:b], body.slice(a, b - a).to_pylist(), a, b
        a = b


def _find_stretches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, sender = Grams(), _Sender(buckets)
        for batch in batches:
            for did, digest, texts, _, _ in _texts(batch):
                sender.add(did, digest, stretches(maker, texts))
                if sender.size > FLUSH_ENTRIES:
                    yield from sender.flush(True)
        yield from sender.flush(True)

    return run


def _open_windows(buckets: int):
    """Windows of the open stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, sender = Grams(), _Sender(buckets)
        for batch in batches:
            for did, digest, texts, a, b in _texts(batch):
                found: dict[str, list[np.ndarray]] = {"key": [], "doc": [], "start": []}
                for k, (text, data) in enumerate(zip(texts, batch.column("opened").slice(a, b - a).to_pylist(), strict=True)):
                    runs = np.unique(np.frombuffer(data, dtype=RUN))
                    body = np.frombuffer(text, dtype=np.uint8)
                    # Long texts segment by segment, each with the stretches that begin in it.
                    for offset in range(0, len(body), SEGMENT_BYTES):
                        own = runs[(runs["start"] >= offset) & (runs["start"] < offset + SEGMENT_BYTES)]
                        if not len(own):
                            continue
                        grams = maker.of(body[offset : offset + SEGMENT_BYTES + 2 * LENGTH])
                        counts = own["end"] - own["start"] + 1
                        at = np.arange(counts.sum()) + np.repeat(own["start"] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
                        found["key"].append(windows(grams, at - offset))
                        found["doc"].append(np.full(len(at), k))
                        found["start"].append(at)
                if found["key"]:
                    joined = {name: np.concatenate(values) for name, values in found.items()}
                    sender.add(did, digest, {**joined, "gram": joined["key"], "width": np.zeros(len(joined["key"]), dtype=np.int64)})
                if sender.size > FLUSH_ENTRIES:
                    yield from sender.flush(False)
        yield from sender.flush(False)

    return run


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(did, digest, runs): per document the runs of window starts that begin earlier elsewhere or in itself."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text, doc_id)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first()["n"]
    buckets = max(least, -(-total // (BUCKET_ENTRIES * (LENGTH - GRAM) // 2)))
    first = stage(_marked(keyed.mapInArrow(_find_stretches(buckets), SENT), buckets, True), "stretches")
    opened = first.where("opened is not null").select("did", "digest", "opened")
    # About half a window span per open stretch; each run is 16 bytes.
    size = opened.agg(F.coalesce(F.sum(F.octet_length("opened")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(least, -(-(size // RUN.itemsize * SPAN // 2) // BUCKET_ENTRIES))
    texts = keyed.join(opened.hint("shuffle_hash"), ["did", "digest"]).select("did", "digest", "body", "opened")
    second = stage(_marked(texts.mapInArrow(_open_windows(buckets), SENT), buckets, False), "windows")
    marks = first.select("did", "digest", "repeats").unionByName(second.select("did", "digest", "repeats"))
    return marks.where("repeats is not null").groupBy("did", "digest").agg(F.collect_list("repeats").alias("runs"))


def removed_spans(runs: Sequence[bytes] | None) -> list[tuple[int, int]]:
    """Maximal removed byte ranges [start, end) of one document."""
    if not runs:
        return []
    all_ = np.sort(np.concatenate([np.frombuffer(part, dtype=RUN) for part in runs]), order=["start", "end"])
    start, end = all_["start"], np.maximum.accumulate(all_["end"] + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist(), strict=True))


def cut_spans(body: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in spans:
        parts.append(body[at:start])
        at = end
    return b"".join([*parts, body[at:]])


def _with_runs(docs: DataFrame, text: str, doc_id: str, row: bool) -> DataFrame:
    runs = repeated_windows(docs, text, doc_id)
    return _keyed(docs, text, doc_id, row).join(runs.hint("shuffle_hash"), ["did", "digest"], "left")


RESULT = T.StructType(
    [
        T.StructField("did", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def repeat_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Earlier is the smaller id (NULL last, equal ids by a hash of the text), then the earlier start. Of rows that repeat
    id and text one is the first and the others lose all if they have 100 bytes. A null text is empty; texts of fewer
    than 100 bytes lose nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, digest, body, runs in zip(*[batch.column(name) for name in ("did", "digest", "body", "runs")], strict=True):
                text, spans = body.as_py(), removed_spans(runs.as_py())
                lost = sum(end - start for start, end in spans)
                rows.append((did.as_py(), digest.as_py(), len(text), lost, len(spans), hashlib.sha256(cut_spans(text, spans)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=RESULT.names), preserve_index=False)

    made = _with_runs(docs, text, doc_id, False).mapInArrow(run, RESULT)
    rows = made.groupBy(*RESULT.names).agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    gone = (F.col("nth") > 1) & (F.col("n_bytes") >= LENGTH)

    def either(name: str, other: Column) -> Column:
        return F.when(gone, other).otherwise(F.col(name)).alias(name)

    return rows.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"),
        "n_bytes",
        either("n_removed", F.col("n_bytes")),
        either("n_spans", F.lit(1).cast("long")),
        either("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
    )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated bytes cut out of the text, and ``chars`` (if there is such a column) counted anew.

    Bytes of a character that is cut in two go with it. No row is dropped; texts without repeats stay as they are.
    """
    joined = _with_runs(docs, text, doc_id, True).select("row", "body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for body, runs in zip(batch.column("body"), batch.column("runs"), strict=True):
                spans = removed_spans(runs.as_py())
                new.append(cut_spans(body.as_py(), spans).decode(errors="ignore") if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "cut"])

    cut = joined.mapInArrow(run, joined.select("row").withColumn("cut", F.lit(None).cast("string")).schema)
    changed = F.col("cut").isNotNull()
    out = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        if name == text:
            out.append(F.when(changed, F.col("cut")).otherwise(old).alias(name))
        elif name == chars:
            out.append(F.when(changed, F.length("cut")).otherwise(old).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(old.alias(name))
    return cut.select(*out)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from every document."""
    return repeat_report(table(spark, sf_dir, "documents"))


__all__ = ["remove_repeats", "repeat_report", "repeated_windows"]
