"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The symbols of the search are words. Test strings are all runs of ``window`` consecutive words of an item (an item with
fewer words is one string). Strings of one length share three tables: the shift table says for the block of the last two
words how far the search may jump, zero-shift blocks name a bucket of strings by that suffix, and comparing the words
themselves confirms an occurrence. Documents are scanned where they are, without a shuffle.

The benchmark is not assumed to be small: its strings are cut into blocks of bounded size, and each block is one scan of
the documents with a broadcast of that block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedwright.llm.common import lower_words_sql, packed, query, table, unpacked
from feedwright.staging import stage

WINDOW = 13
BLOCK_WORDS = 2
# Bytes of test strings and item ids in one broadcast; more strings make more scans.
STRING_BYTES = 16 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A-Z to lower case, every byte that is no word byte to a space; UTF-8 bytes above 0x7F stay.
FOLD = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte > 127 else 32
    for byte in range(256)
)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Shift table and suffix buckets for strings of one length in words."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(strings)))
        self.block = min(BLOCK_WORDS, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = {}
        for string, items in strings.items():
            for end in range(self.block, self.length + 1):
                key = string[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
            self.buckets.setdefault(string[-self.block :], {})[string] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of every occurrence, by start."""
        shift, far, block, length = self.shift, self.far, self.block, self.length
        end, last = length, len(words)
        while end <= last:
            key = tuple(words[end - block : end])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            items = self.buckets[key].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def test_strings(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct test strings (string, item_ids); items without an id, or without words, have none."""
    words = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.expr(lower_words_sql(f"`{text}`", WORD, "spark")).alias("words")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    strings = words.where(F.size("words") > 0).select(
        "item", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("words", at, window), " "))).alias("string")
    )
    return strings.groupBy("string").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _scanner(tables, text: str, last: bool):
    """Batch function that adds the occurrences of the broadcast strings to those found before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = batch.schema.field("found").type
            before = batch.column("found").to_pylist()
            found = []
            for value, old in zip(batch.column(text).cast(pa.large_binary()), before, strict=True):
                words = words_of(value.as_py() or b"")
                spans = [(span["start"], span["end"]) for span in old["spans"]] if old else []
                items = set(old["item_ids"]) if old else set()
                for matcher in tables.value:
                    for start, ids in matcher.search(words):
                        spans.append((start, start + matcher.length))
                        items.update(ids)
                found.append({"n_words": len(words), "spans": _merged(spans), "item_ids": sorted(items)})
            at = batch.schema.get_field_index("found")
            batch = batch.set_column(at, batch.schema.field("found"), pa.array(found, kind))
            yield batch.drop_columns([text]) if last else batch

    return scan


def find_test_strings(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    string_bytes: int = STRING_BYTES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns to ``keep``, default all) and ``found`` (n_words, spans, item_ids).

    A span is a maximal run [start, end) of document words covered by occurrences, in words. Every row is judged by
    itself, repeated ones too. A null or empty text has no words; items without an id or without words are no test
    strings; repeated items count once per id. Without test strings nothing is found.
    """
    spark = docs.sparkSession
    strings = stage(test_strings(items, item_id, item_text, window), "test-strings")
    size = F.octet_length("string") + F.octet_length(F.array_join("item_ids", ","))
    total = strings.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total")).first()["total"]
    n_blocks = max(1, math.ceil(total / string_bytes))
    result = packed(docs, text, keep=keep).withColumn("found", F.lit(None).cast(FOUND))
    for number in range(n_blocks):
        mine = strings.where(F.pmod(F.xxhash64("string"), F.lit(n_blocks)) == number)
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for line in mine.toLocalIterator():
            string = tuple(line["string"].encode().split(b" "))
            by_length.setdefault(len(string), {})[string] = line["item_ids"]
        tables = spark.sparkContext.broadcast([WuManber(group) for _, group in sorted(by_length.items())])
        last = number + 1 == n_blocks
        schema = result.drop(f"in_{text}").schema if last else result.schema
        result = result.mapInArrow(_scanner(tables, f"in_{text}", last), schema)
        if not last:
            result = stage(result, "scanned")
    return result


def n_hit() -> F.Column:
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


def contaminated(share: int = 20) -> F.Column:
    """At least one word hit, and at least one in ``share`` words."""
    return (n_hit() > 0) & (F.lit(share) * n_hit() >= F.col("found.n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return unpacked(find_test_strings(docs, items, **options).where(~contaminated()), docs.columns)


ORACLE = f"""
with dw as (
    select doc_id, row_number() over () as rid, {lower_words_sql('text', WORD, 'duckdb')} as w from documents),
iw as (
    select cast(item_id as varchar) as item, {lower_words_sql('text', WORD, 'duckdb')} as w from benchmark
    where item_id is not null),
pat as (
    select distinct item, array_to_string(w[p : p + {WINDOW - 1}], ' ') as s, least(len(w), {WINDOW}) as len
    from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as p from iw where len(w) > 0)),
lens as (select distinct len from pat),
win as (
    select rid, p, len, array_to_string(w[p : p + len - 1], ' ') as s
    from (select rid, w, len, unnest(range(1, len(w) - len + 2)) as p from dw, lens where len(w) >= len)),
hits as (select rid, p, win.len, item from win join pat using (s, len)),
covered as (
    select rid, count(distinct q) as n_hit
    from (select rid, unnest(range(p, p + len)) as q from (select distinct rid, p, len from hits)) group by rid),
named as (
    select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
    from hits group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered using (rid) left join named using (rid)
"""


@query("op2_decontamination", ORACLE)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows in every document."""
    found = find_test_strings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "found.n_words",
        n_hit().alias("n_hit"),
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


__all__ = ["WuManber", "contaminated", "decontaminate", "find_test_strings", "test_strings", "words_of"]
