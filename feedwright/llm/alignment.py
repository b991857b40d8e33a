"""Cross-tokenizer alignment: byte-exact links between two tokenizations and their corpus-wide counts.

Two tokenizers cut the same bytes. Where both end a token a group ends, and each stretch between two neighbouring token
ends of either side lies in exactly one token of both: it is one link. A corpus-wide count of every linked id pair needs
records (pair, document), far more than fit in memory, so they are counted externally:

* each task radix-partitions its records by the low bits of the second side's id and writes them, sorted by second id,
  first id and document, as Zstandard blocks: a *run*;
* runs of one bucket and a few tasks meet and a k-way heap merge by blocks counts each pair; the partial counts of all
  tasks are added, and the order by second side gives each id's highest count;
* the runs are streamed once more against the counts of their bucket, and what each record contributes goes back to its
  document.

A merge holds one block of each of its runs. How many tasks meet is fixed, so no group grows with the corpus, whatever
share of all links one id has; what grows is the number of groups.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from feedwright.llm.common import chunks, query, table
from feedwright.llm.packing import public_tokenizer
from feedwright.llm.word_units import UnitCache, ragged, split_units, sums
from feedwright.staging import stage

RADIX_BITS = 4
FIRST_BITS = 16  # ids of the first side are below 2**16, of the second below 2**15
SECOND_BITS = 15
BUFFER_LINKS = 4 << 20
BLOCK_RECORDS = 1 << 16
TASKS_PER_GROUP = 4
ENCODE_BYTES = 256 << 10
DOC_BITS = 32


def public_piece_model() -> str:
    """Place of the piece model of the production query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bucket (low bits of the second id), rest of the second id, first id, in one number of 31 bits."""
    bucket, rest = second & ((1 << RADIX_BITS) - 1), second >> RADIX_BITS
    return (((bucket << (SECOND_BITS - RADIX_BITS)) | rest) << FIRST_BITS) | first


def pair_ids(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) ids of packed pairs."""
    second = pairs >> FIRST_BITS
    bucket, rest = second >> (SECOND_BITS - RADIX_BITS), second & ((1 << (SECOND_BITS - RADIX_BITS)) - 1)
    return pairs & ((1 << FIRST_BITS) - 1), (rest << RADIX_BITS) | bucket


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [value for value in range(256) if value not in plain]
    return {chr(value): value for value in plain} | {chr(256 + k): value for k, value in enumerate(rest)}


class Links:
    """What an alignment of consecutive texts gives: per text numbers, group strings, and packed pairs with offsets."""

    def __init__(self, n_first, n_second, n_groups, strings, pairs, offsets):
        self.n_first, self.n_second, self.n_groups = n_first, n_second, n_groups
        self.strings, self.pairs, self.offsets = strings, pairs, offsets


def _joined(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Decimal ids between offsets, comma-joined."""
    text = pa.array(ids, pa.int32()).cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), ",")


def _content(values: pa.Array) -> memoryview:
    """The bytes of a binary or string array without offsets, one value after the other."""
    ends, data = np.frombuffer(values.buffers()[1], "<i4")[values.offset :], values.buffers()[2]
    return memoryview(data or b"").cast("B")[ends[0] : ends[len(values)]]


class Aligner:
    """Both tokenizers with the bytes of their tokens; texts are bytes that begin with a space."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(definition)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet, size = byte_alphabet(), self.first.get_vocab_size()
        names = [self.first.id_to_token(k) or "" for k in range(size)]
        self.first_bytes = pa.array([bytes(alphabet[c] for c in name if c in alphabet) for name in names], pa.binary())
        pieces = []
        for k in range(len(self.second)):
            piece = self.second.id_to_piece(k)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(k) else piece.replace("▁", " ").encode())
        self.second_bytes = pa.array(pieces, pa.binary())
        if size > 1 << FIRST_BITS or len(pieces) > 1 << SECOND_BITS:
            raise ValueError("a vocabulary is too large for the packed pairs")
        self.first_sizes = pc.binary_length(self.first_bytes).to_numpy().astype(np.int64)
        self.second_sizes = pc.binary_length(self.second_bytes).to_numpy().astype(np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a space and the text, or None where the bytes of either side differ from it."""
        want = b" " + text.encode()
        first = np.array(self.first.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)
        second = np.array(self.second.encode(text), dtype=np.int64)
        for ids, tokens in ((first, self.first_bytes), (second, self.second_bytes)):
            if _content(tokens.take(pa.array(ids))) != want:
                return None
        return first, second

    def align(self, first: np.ndarray, second: np.ndarray, sizes: Sequence[int]) -> Links:
        """Alignment of texts of the given sizes in bytes whose ids are concatenated."""
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        first_ends, second_ends = np.cumsum(self.first_sizes[first]), np.cumsum(self.second_sizes[second])
        common = np.intersect1d(first_ends, second_ends, assume_unique=True)
        links = np.union1d(first_ends, second_ends)
        pairs = packed_pair(first[np.searchsorted(first_ends, links)], second[np.searchsorted(second_ends, links)])

        def offsets(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.searchsorted(values, bounds, side="right")])

        groups = pc.binary_join_element_wise(
            _joined(first, offsets(first_ends, common)), _joined(second, offsets(second_ends, common)), "|"
        )
        per_text = offsets(common, ends)
        strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), groups), ";")
        counts = [np.diff(offsets(values, ends)) for values in (first_ends, second_ends)]
        return Links(*counts, np.diff(per_text), strings, pairs, offsets(links, ends))


class UnitTable:
    """Alignments of the distinct units of a task, by number."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.cache = UnitCache(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        empty = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros((3, 0), dtype=np.int64)
        self.strings, self.pairs, self.offsets = pa.array([], pa.string()), empty, np.zeros(1, dtype=np.int64)
        self.bad: set[int] = set()

    def _learn(self, units: list[str]) -> None:
        """Encode the units joined behind one letter, in blocks; every unit is as it stands in a text."""
        marked = [unit if unit[0] == "\n" else " " + unit for unit in units]
        sizes = np.array([len(text.encode()) for text in marked], dtype=np.int64)
        block = np.cumsum(sizes) // ENCODE_BYTES
        for number in np.unique(block):
            mine = np.flatnonzero(block == number)
            found = self._encoded([marked[k] for k in mine], sizes[mine])
            self.counts = np.concatenate([self.counts, [found.n_first, found.n_second, found.n_groups]], axis=1)
            self.strings = pa.concat_arrays([self.strings, found.strings])
            self.pairs = np.concatenate([self.pairs, found.pairs])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + found.offsets[1:]])

    def _encoded(self, marked: list[str], sizes: np.ndarray) -> Links:
        """The units' alignment without that of the letter in front."""
        ids = self.aligner.encode("x" + "".join(marked))
        if ids is None:
            raise ValueError("a tokenizer changes the bytes of plain words")
        found = self.aligner.align(*ids, [2, *sizes])
        skipped = found.offsets[1]
        return Links(found.n_first[1:], found.n_second[1:], found.n_groups[1:], found.strings[1:], found.pairs[skipped:], found.offsets[1:] - skipped)


class TextAligner:
    """Alignment of whole texts: plain ones from their units, odd ones encoded as they are."""

    def __init__(self, definition: str, model: bytes):
        self.aligner = Aligner(definition, model)
        self.units = UnitTable(self.aligner)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(numbers of tokens of both sides, groups and links per text; digests; packed pairs; their offsets)."""
        n = len(texts)
        offsets, units, index = split_units(pc.fill_null(texts, ""))
        number = self.units.cache.numbers(units)[index] if len(index) else np.zeros(0, dtype=np.int64)
        plain = (sums(number < 0, offsets) == 0) & (np.diff(offsets) > 0)
        numbers = np.zeros((4, n), dtype=np.int64)
        digests = [""] * n
        own = number[ragged(offsets[:-1][plain], np.diff(offsets)[plain])]
        bounds = np.concatenate([[0], np.cumsum(np.diff(offsets)[plain])])
        rows = np.flatnonzero(plain)
        for k in range(3):
            numbers[k, rows] = sums(self.units.counts[k][own], bounds)
        starts, lengths = self.units.offsets[own], np.diff(self.units.offsets)[own]
        numbers[3, rows] = sums(lengths, bounds)
        parts = [self.units.pairs[ragged(starts, lengths)]]
        order = [*rows]
        strings = self.units.strings.take(pa.array(own))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), strings), ";")
        content, ends = _content(joined), np.frombuffer(joined.buffers()[1], "<i4")
        for k, row in enumerate(rows):
            digests[row] = hashlib.sha256(content[ends[k] : ends[k + 1]]).hexdigest()
        for row in np.flatnonzero(~plain):
            text = texts[int(row)].as_py() or ""
            ids = self.aligner.encode(text) if text else None
            if ids is None:
                continue
            found = self.aligner.align(*ids, [len(text.encode()) + 1])
            numbers[:, row] = (len(ids[0]), len(ids[1]), found.n_groups[0], len(found.pairs))
            digests[row] = hashlib.sha256(_content(found.strings)).hexdigest()
            parts.append(found.pairs)
            order.append(row)
        pairs = np.concatenate(parts)
        return numbers, digests, pairs, np.repeat(np.array(order, dtype=np.int64), numbers[3, order])


def write_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys (packed pair, document) with their counts as length-prefixed Zstandard blocks."""
    import zstandard

    press, out = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(keys), BLOCK_RECORDS):
        own, n = keys[at : at + BLOCK_RECORDS], counts[at : at + BLOCK_RECORDS]
        pairs, first = np.unique(own >> DOC_BITS, return_index=True)
        sizes = np.diff(np.append(first, len(own)))
        docs = np.diff((own & 0xFFFFFFFF).astype(np.uint32), prepend=np.uint32(0))
        columns = [pairs.astype("<u4"), sizes.astype("<u4"), docs.astype("<u4"), n.astype("<u4")]
        planes = [np.ascontiguousarray(column.view(np.uint8).reshape(-1, 4).T).tobytes() for column in columns]
        block = press.compress(struct.pack("<II", len(pairs), len(own)) + b"".join(planes))
        out.append(struct.pack("<I", len(block)) + block)
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(packed pairs, documents, counts) of each block of a run, one record each, sorted."""
    import zstandard

    press, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        (size,) = struct.unpack_from("<I", run, at)
        data = press.decompress(run[at + 4 : at + 4 + size])
        at += 4 + size
        n_pairs, n = struct.unpack_from("<II", data)
        place, columns = 8, []
        for length in (n_pairs, n_pairs, n, n):
            planes = np.frombuffer(data, dtype=np.uint8, count=4 * length, offset=place).reshape(4, length)
            columns.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
            place += 4 * length
        pairs, sizes, docs, counts = columns
        yield np.repeat(pairs, sizes).astype(np.int64), np.cumsum(docs, dtype=np.uint32).astype(np.int64), counts.astype(np.int64)


def merged_counts(runs: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed pairs, link counts) in order of the pairs: a k-way heap merge that holds one block of each run.

    The heap is keyed by the last pair of each run's block. What all runs hold up to the least of these is complete but
    for that pair itself, whose count waits for the next step.
    """
    readers = [read_run(run) for run in runs]
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    heap: list[tuple[int, int]] = []

    def refill(k: int) -> None:
        for pairs, _, counts in readers[k]:
            own, first = np.unique(pairs, return_index=True)
            blocks[k] = own, np.add.reduceat(counts, first)
            heapq.heappush(heap, (int(own[-1]), k))
            return
        blocks[k] = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    for k in range(len(readers)):
        blocks.append(None)
        refill(k)
    wait_pair, wait_count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    while heap:
        last, k = heapq.heappop(heap)
        cut = [int(np.searchsorted(pairs, last, side="right")) for pairs, _ in blocks]
        pairs = np.concatenate([wait_pair, *[own[:n] for (own, _), n in zip(blocks, cut)]])
        counts = np.concatenate([wait_count, *[own[:n] for (_, own), n in zip(blocks, cut)]])
        for j, n in enumerate(cut):
            blocks[j] = blocks[j][0][n:], blocks[j][1][n:]
        own, place = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, place, counts)
        wait_pair, wait_count = own[-1:], total[-1:]
        if len(own) > 1:
            yield own[:-1], total[:-1]
        refill(k)
        while heap and not len(blocks[heap[0][1]][0]):  # used up by this step
            refill(heapq.heappop(heap)[1])
    if len(wait_pair):
        yield wait_pair, wait_count


class RunWriter:
    """Gathers links of a task and flushes them as one run per bucket."""

    def __init__(self):
        self.keys = np.empty(BUFFER_LINKS, dtype=np.int64)
        self.used = 0

    def add(self, pairs: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at < len(pairs):
            n = min(len(pairs) - at, len(self.keys) - self.used)
            self.keys[self.used : self.used + n] = (pairs[at : at + n] << DOC_BITS) | docs[at : at + n]
            self.used, at = self.used + n, at + n
            if self.used == len(self.keys):
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        keys = self.keys[: self.used]
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        own, counts = keys[first], np.diff(np.append(first, len(keys)))
        shift = SECOND_BITS - RADIX_BITS + FIRST_BITS + DOC_BITS
        bounds = np.append(np.searchsorted(own, np.arange(1 << RADIX_BITS, dtype=np.int64) << shift), len(own))
        for bucket, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if high > low:
                yield bucket, write_run(own[low:high], counts[low:high])
        self.used = 0


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_DOC = [T.StructField("task", T.LongType()), T.StructField("nth", T.LongType())]
_DOC += [T.StructField(name, T.LongType()) for name in NUMBERS] + [T.StructField("groups_sha256", T.StringType())]
_RUN = [T.StructField("bucket", T.IntegerType()), T.StructField("salt", T.LongType()), T.StructField("run", T.BinaryType())]


def aligned_runs(docs: DataFrame, tokenizer: str, model: str, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per document (``row``, task, nth, numbers, digest) and, with a bucket, one per run; staged."""
    context = docs.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as source:
        definition = context.broadcast(source.read())  # one vocabulary file each
    with open(model, "rb") as source:
        pieces = context.broadcast(source.read())
    given = docs.select(F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *_DOC, *_RUN])
    names = schema.names

    def run_rows(found: Iterator[tuple[int, bytes]], kind: pa.DataType, task: int) -> Iterator[pa.RecordBatch]:
        for bucket, data in found:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.array([task]), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.array([bucket], pa.int32()), pa.array([task // TASKS_PER_GROUP]), pa.array([data], pa.binary())],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, writer, seen = TextAligner(definition.value, pieces.value), RunWriter(), 0
        task, kind = TaskContext.get().partitionId(), None
        for batch in batches:
            for chunk in chunks(batch, "_text"):
                kind, n = chunk.column("row").type, chunk.num_rows
                numbers, digests, pairs, owners = aligner.align(chunk.column("_text"))
                yield from run_rows(writer.add(pairs, owners + seen), kind, task)
                arrays = [chunk.column("row"), pa.array(np.full(n, task)), pa.array(np.arange(seen, seen + n))]
                arrays += [*map(pa.array, numbers), pa.array(digests, pa.string())]
                arrays += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                seen += n
        if kind is not None:
            yield from run_rows(writer.flush(), kind, task)

    return stage(given.mapInArrow(run, schema), "alignment")


def link_counts(staged: DataFrame) -> DataFrame:
    """(pair, n, best) of every id pair that is linked anywhere: its links, and whether no pair of its second id has more."""

    def count(group: pa.Table) -> pa.Table:
        found = [*merged_counts(group.column("run").to_pylist())]
        pairs, counts = (np.concatenate([part[k] for part in found]) for k in (0, 1))
        return pa.table({"pair": pairs, "n": counts})

    runs = staged.where("bucket is not null").select("bucket", "salt", "run")
    partial = runs.groupBy("bucket", "salt").applyInArrow(count, "pair long, n long")
    second = F.shiftright("pair", FIRST_BITS)
    counts = partial.groupBy(second.alias("second"), "pair").agg(F.sum("n").alias("n"))
    # At most as many rows per second id as the first vocabulary has ids.
    best = F.max("n").over(Window.partitionBy("second"))
    return counts.select("second", "pair", "n", (F.col("n") == best).alias("best")).drop("second")


def _contributions(staged: DataFrame, counts: DataFrame) -> DataFrame:
    """(task, nth, n_best, count_sum): what the records of each bucket give each document."""
    runs = staged.where("bucket is not null").select("bucket", "salt", "task", "run")

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("pair").to_numpy(), kind="stable")
        data = [group.column(name).to_numpy()[order].astype(kind).tobytes() for name, kind in (("pair", "<i8"), ("n", "<i8"), ("best", "u1"))]
        return pa.table({"bucket": group.column("bucket").slice(0, 1), **{name: pa.array([value], pa.binary()) for name, value in zip(("pairs", "counts", "bests"), data)}})

    bucket = F.shiftright("pair", SECOND_BITS - RADIX_BITS + FIRST_BITS).cast("int").alias("bucket")
    # A bucket's counts: as many as id pairs occur, bounded by the vocabularies, not by the corpus.
    packed = counts.select(bucket, "*").groupBy("bucket").applyInArrow(pack, "bucket int, pairs binary, counts binary, bests binary")
    spread = runs.select("bucket", "salt").distinct().join(packed, "bucket").withColumnsRenamed({"bucket": "of_bucket", "salt": "of_salt"})

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[int, np.ndarray] = {}
        if right.num_rows:
            known = np.frombuffer(right.column("pairs")[0].as_py(), "<i8")
            n, best = np.frombuffer(right.column("counts")[0].as_py(), "<i8"), np.frombuffer(right.column("bests")[0].as_py(), "u1").astype(np.int64)
        for task, data in zip(left.column("task").to_pylist(), left.column("run")):
            for pairs, docs, times in read_run(data.as_py()):
                place = np.searchsorted(known, pairs)
                least = int(docs.max()) + 1
                had = out.get(task, np.zeros((2, 0), dtype=np.int64))
                if had.shape[1] < least:
                    had = out[task] = np.concatenate([had, np.zeros((2, max(least, 2 * had.shape[1]) - had.shape[1]), dtype=np.int64)], axis=1)
                np.add.at(had[0], docs, times * best[place])
                np.add.at(had[1], docs, times * n[place])
        parts = [(task, np.flatnonzero(had[1]), had) for task, had in out.items()]
        whole = [np.concatenate([np.zeros(0, dtype=np.int64), *part]) for part in (
            [np.full(len(rows), task) for task, rows, _ in parts], [rows for _, rows, _ in parts], [had[0][rows] for _, rows, had in parts], [had[1][rows] for _, rows, had in parts])]
        return pa.table(whole, names=["task", "nth", "n_best", "count_sum"])

    return runs.groupBy("bucket", "salt").cogroup(spread.groupBy("of_bucket", "of_salt")).applyInArrow(stream, "task long, nth long, n_best long, count_sum long")


def align_tokens(docs: DataFrame, tokenizer: str, model: str, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns to ``keep``, default all), n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    ``tokenizer`` is a byte-level BPE file (side A, given a space and the text), ``model`` a piece model (side B, which adds
    the space). ``n_best`` counts links whose pair is the most frequent of its B id (ties included), ``count_sum`` adds up the
    corpus-wide counts of the links' pairs. A text that is null, empty, or not given back byte for byte by either side
    (one with a literal space mark) has zeros and an empty digest. Repeated rows count, and are returned, each; a very
    long text is encoded whole and its links go out in several runs; columns of any name are kept in ``row``.
    """
    staged = aligned_runs(docs, tokenizer, model, text, docs.columns if keep is None else keep)
    given = _contributions(staged, link_counts(staged))
    lines = staged.where("bucket is null").select("task", "nth", F.struct("row", *NUMBERS, "groups_sha256").alias("line"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    lost = F.lit(None).cast(lines.schema["line"].dataType)
    both = lines.unionByName(given.select("task", "nth", lost.alias("line"), "n_best", "count_sum"))
    whole = both.groupBy("task", "nth").agg(F.max_by("line", F.col("line").isNotNull()).alias("line"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select("line.row", *[f"line.{name}" for name in NUMBERS], "n_best", "count_sum", "line.groups_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's links between the two public tokenizers with their corpus-wide counts."""
    found = align_tokens(table(spark, sf_dir, "documents"), public_tokenizer(), public_piece_model(), keep=["doc_id"])
    return found.select("row.doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
