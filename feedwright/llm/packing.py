"""Best-fit packing of token sequences under several capacities at once.

Documents are tokenised and cut into pieces where they are. Pieces of one length are interchangeable, so only the
histogram of lengths (one row per length up to the capacity, whatever the corpus) is needed to plan: bins with equal
contents form a group with a count, and vector best-fit, longest pieces first, picks for each length the group whose
residual capacities (tokens, documents, attention cost) suit best, by weighted residual norm or dot product. The plan is
a small table of slots; each piece finds its own by its rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from feedwright.llm.common import chunks, query, table
from feedwright.llm.word_units import odd_units, ragged, split_units, sums
from feedwright.staging import stage

CAPACITY = 2048
END_ID = 0
# Stems whose ids a task remembers at a time.
CACHE_WORDS = 600_000
PUNCTUATION = ".,;:!?#$%&*|"


def public_tokenizer() -> str:
    """Place of the tokenizer file of the production query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE tokenizer file, each distinct word encoded once.

    Texts are cut into units (see ``word_units``), and a unit into its stem and the punctuation behind a last letter or
    digit, which the pre-tokenizer keeps apart too. New stems are encoded in one go, joined as they stand in a text; the ids
    of all texts are then gathered from those of the stems and marks. Texts with other white space, or with the string of an
    added token, are encoded whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(definition)
        self.added = [token.content for token in self.encoder.get_added_tokens_decoder().values()]
        # A byte-level token has one character for each of its bytes.
        self.sizes = np.array([len(self.encoder.id_to_token(k) or "") for k in range(self.encoder.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.atoms: dict[str, int] = {}  # stems with what stands before them, and marks
        self.ids, self.ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _encoded(self, texts: Sequence[str]) -> list[bytes]:
        found = self.encoder.encode_batch_fast(list(texts), add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in found]

    def _numbers(self, texts: pa.Array, learn: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Number of each atom; ``learn`` gives the ids of new ones, one after the other, and how many each has."""
        encoded = texts.dictionary_encode()
        names = encoded.dictionary.to_pylist()
        found = np.fromiter(map(self.atoms.get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [names[k] for k in missing]
            found[missing] = np.arange(len(missing)) + len(self.ends) - 1
            self.atoms.update(zip(new, found[missing].tolist(), strict=True))
            ids, lengths = learn(new, pc.binary_length(encoded.dictionary).to_numpy()[missing])
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        return found[encoded.indices.to_numpy()]

    def _stem_ids(self, stems: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Joined behind one letter, so that the first stem too stands as in a text.
        whole = np.array(self.encoder.encode("x" + "".join(stems), add_special_tokens=False).ids, dtype="<u4")
        bounds = np.searchsorted(np.cumsum(self.sizes[whole]), 1 + np.concatenate([[0], np.cumsum(sizes)]), side="right")
        return whole[bounds[0] :], np.diff(bounds)

    def _mark_ids(self, marks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(data, dtype="<u4") for data in self._encoded(marks)]
        return np.concatenate(found), np.array([len(one) for one in found], dtype=np.int64)

    def _parts(self, units: pa.Array) -> np.ndarray:
        """Numbers of the stem and the mark of each unit, for units that are not odd."""
        if len(self.atoms) > CACHE_WORDS:
            self._forget()
        stems = pc.utf8_rtrim(units, PUNCTUATION)
        apart = pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1))
        stems = pc.if_else(apart, stems, units)
        marks = pc.if_else(apart, pc.replace_substring_regex(units, f"(?s)^.*[^{PUNCTUATION}]", ""), "")
        stems = pc.if_else(pc.starts_with(units, "\n"), stems, pc.binary_join_element_wise("", stems, " "))
        return np.column_stack([self._numbers(stems, self._stem_ids), self._numbers(marks, self._mark_ids)])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if not texts:
            return []
        given = pa.array(texts, pa.string())
        offsets, units, index = split_units(given)
        odd = odd_units(units)
        plain = sums(odd[index], offsets) == 0
        for content in self.added:
            plain &= ~pc.match_substring(given, content).to_numpy(zero_copy_only=False)
        rows, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        # The first unit of a text has no space in front of it.
        heads = self._encoded([units[int(index[offsets[k]])].as_py() for k in rows])
        counts = np.diff(offsets)[rows] - 1
        # Odd units stand in other texts only.
        parts = np.zeros((len(units), 2), dtype=np.int64)
        parts[~odd] = self._parts(units.filter(pa.array(~odd)))
        own = parts[index[ragged(offsets[:-1][rows] + 1, counts)]].reshape(-1)
        starts, lengths = self.ends[:-1][own], np.diff(self.ends)[own]
        ids = self.ids[ragged(starts, lengths)]
        bounds = np.concatenate([[0], np.cumsum(sums(lengths, 2 * np.concatenate([[0], np.cumsum(counts)])))])
        out: list[np.ndarray] = [None] * len(texts)
        for k, row in enumerate(rows):
            out[row] = np.concatenate([np.frombuffer(heads[k], dtype="<u4"), ids[bounds[k] : bounds[k + 1]]])
        for row, data in zip(others, self._encoded([texts[k] for k in others]), strict=True):
            out[row] = np.frombuffer(data, dtype="<u4")
        return out


PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(start, capacity) for start in range(first, n, capacity)]]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``keep`` columns and one row per piece: piece, start, length, ids_crc32, ids (or NULL), part, nth.

    ``part`` and ``nth`` number the pieces of one length within a task; the frame must be staged before they are used.
    A null text is empty, so it is one piece with the end id alone. Columns named like those added are replaced.
    """
    with open(tokenizer, encoding="utf-8") as source:
        definition = docs.sparkSession.sparkContext.broadcast(source.read())  # one vocabulary file
    keep = [name for name in keep if name not in PIECE.names]
    given = docs.select(*[F.col(f"`{name}`") for name in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*given.drop("_text").schema.fields, *PIECE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = WordTokenizer(definition.value), Counter()
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for chunk in chunks(batch, "_text"):
                rows, pieces = [], []
                texts = [value or "" for value in chunk.column("_text").to_pylist()]
                for k, ids in enumerate(encoder.encode(texts)):
                    ids = np.concatenate([ids, end])
                    for number, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append(k)
                        pieces.append(
                            (number, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None, part, seen[length])
                        )
                        seen[length] += 1
                kept = chunk.drop_columns(["_text"]).take(pa.array(rows, pa.int64()))
                arrays = [*kept.columns]
                for values, field_ in zip(zip(*pieces, strict=True), PIECE.fields, strict=True):
                    kind = {"int": pa.int32(), "bigint": pa.int64()}.get(field_.dataType.simpleString(), pa.list_(pa.int32()))
                    arrays.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return given.mapInArrow(run, schema)


@dataclass
class Plan:
    """Slots of a packing: pieces of ``length`` ranked ``first_rank`` and on fill ``bins`` bins, ``per_bin`` in each."""

    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first_rank, per_bin, first_bin, offset
    bins: int = 0


def vector_best_fit(
    histogram: dict[int, int],
    *,
    capacity: int = CAPACITY,
    max_docs: int = CAPACITY,
    max_cost: int = CAPACITY * CAPACITY,
    score: str = "residual",
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> Plan:
    """Pack pieces, given by length and count, into bins under every capacity.

    ``max_cost`` bounds the sum of squared lengths in a bin. ``score`` is ``residual`` (smallest weighted norm of what
    would be left) or ``dot`` (largest weighted dot product of piece and residual). The work depends on the number of
    different lengths and groups, not on the counts.
    """
    limits = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    weight = np.array(weights)
    size = 1024
    left = np.zeros((size, 3), dtype=np.int64)
    count = np.zeros(size, dtype=np.int64)
    contents: list[tuple[tuple[int, int, int], ...]] = []  # per group: (length, per bin, offset)

    def add(residual: Sequence[int], bins: int, inside: tuple) -> None:
        nonlocal left, count
        if len(contents) == len(count):
            left, count = np.concatenate([left, np.zeros_like(left)]), np.concatenate([count, np.zeros_like(count)])
        left[len(contents)], count[len(contents)] = residual, bins
        contents.append(inside)

    def fill(group: int, length: int, each: int) -> None:
        offset = capacity - int(left[group, 0])
        left[group] -= (each * length, each, each * length * length)
        contents[group] = (*contents[group], (length, each, offset))

    for length in sorted(histogram, reverse=True):
        piece = np.array([length, 1, length * length])
        if (piece > limits).any():
            raise ValueError(f"a piece of {length} tokens does not fit into an empty sequence")
        rest = histogram[length]
        while rest:
            n = len(contents)
            fits = np.flatnonzero((left[:n] >= piece).all(axis=1))
            if len(fits):
                if score == "dot":
                    value = -((left[fits] / limits) * (piece / limits) * weight).sum(axis=1)
                else:
                    value = ((((left[fits] - piece) / limits) ** 2) * weight).sum(axis=1)
                group = int(fits[np.argmin(value)])
                each = int((left[group] // piece).min())
            else:
                each = int((limits // piece).min())
                add((capacity, max_docs, max_cost), max(1, rest // each), ())
                group = n
            each = min(each, rest)
            bins = min(int(count[group]), rest // each)
            if bins < count[group]:
                add(left[group].tolist(), int(count[group]) - bins, contents[group])
                count[group] = bins
            fill(group, length, each)
            rest -= bins * each
    plan, ranks = Plan(), Counter()
    for group, inside in enumerate(contents):
        for length, each, offset in inside:
            plan.slots.append((length, ranks[length], each, plan.bins, offset))
            ranks[length] += each * int(count[group])
        plan.bins += int(count[group])
    return plan


def pack(pieces: DataFrame, **capacities) -> DataFrame:
    """Staged pieces (of ``token_pieces``) with ``sequence_id`` and ``offset`` in place of ``part`` and ``nth``."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row per length: at most ``capacity`` of them.
    histogram = {line["length"]: line["n"] for line in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = vector_best_fit(histogram, **capacities)
    slots = sorted(plan.slots)
    shared = spark.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        keys = (slot[:, 0] << 48) | slot[:, 1]  # length and first rank
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            mine = slot[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            nth = rank - mine[:, 1]
            batch = batch.drop_columns(["_rank"])
            batch = batch.append_column("sequence_id", pa.array(mine[:, 3] + nth // mine[:, 2]))
            yield batch.append_column("offset", pa.array(mine[:, 4] + (nth % mine[:, 2]) * length))

    ranked = (
        pieces.join(ranks.drop("n"), ["part", "length"])
        .withColumn("_rank", F.col("nth") + F.col("_before"))
        .select(*[c for c in pieces.columns if c not in ("part", "nth")], "_rank")
    )
    schema = ranked.drop("_rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place."""
    return pack(stage(token_pieces(docs, tokenizer, **options), "pieces"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer()).drop("ids")
