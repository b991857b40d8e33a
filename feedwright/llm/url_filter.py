"""URL filter over a sorted digest array.

The block list (hosts or host/path prefixes) is turned into an index: 64-bit XXH64 keys in ascending order, the place of
every full string, and the strings themselves. The index is built by Spark in key ranges, one shard of three files per
range, in the shared folder. Tasks memory-map the shards, probe all candidate strings of a batch of URLs at once by
binary search, and confirm every key that is found against the stored string, so a collision decides nothing.

Rules (host, path, action) come first: a rule fits its host and all subdomains if the path starts with the rule's path,
and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedwright.llm.common import packed, query, table
from feedwright.staging import scratch_path

# Rules of the contract, as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Listed domains of the production query; a domain covers its subdomains.
BLOCKED = (
    "ads-track.example.com",
    "adult-x.example.net",
    "casino-win.example.com",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "free-bets.example.net",
    "spam-farm.example.com",
    "spam-farm.example.org",
)
# Entries of one shard of the index.
SHARD_ENTRIES = 4_000_000

URL_HOST = r"(?s)^.*?://([^/?#]*)"
URL_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, URL_HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, URL_PATH, 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule like ``net/``, action) of the longest fitting rule, else NULL; of equal length the first by text."""
    rule = action = F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, action = F.when(fits, name + start).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def build_index(entries: DataFrame, column: str, spark: SparkSession) -> list[str]:
    """Write the sorted digest array of a column of strings to the shared folder; returns the shards in key order.

    NULL and empty strings are left out, repeated ones are stored once.
    """
    path = scratch_path(spark, "digest-array")
    keyed = (
        entries.select(F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("entry"))
        .where("entry <> ''")
        .distinct()
        .select("entry", F.xxhash64("entry").alias("key"))
    )
    shards = max(1, -(-keyed.count() // SHARD_ENTRIES))
    ranged = keyed.repartitionByRange(shards, "key", "entry").sortWithinPartitions("key", "entry")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        rows = pa.Table.from_batches(list(batches)) if batches else None
        if rows is None or not rows.num_rows:
            return
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        name = f"shard-{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{name}", recursive=True)
        texts = [text.encode() for text in rows["entry"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype("<i8")
        keys = rows["key"].to_numpy().astype("<i8")
        for part, data in (("keys", keys.tobytes()), ("ends", ends.tobytes()), ("texts", b"".join(texts))):
            with fs.open_output_stream(f"{root}/{name}/{part}") as out:
                out.write(data)
        yield pa.RecordBatch.from_pydict({"first": [int(keys[0])], "shard": [f"{path}/{name}"]})

    made = ranged.mapInArrow(write, "first long, shard string").collect()  # one row per shard
    return [row["shard"] for row in sorted(made, key=lambda row: row["first"])]


def _mapped(shard: str, part: str, kind) -> np.ndarray:
    """One file of a shard: memory-mapped if the shared folder is mounted, else read through its file system."""
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{shard}/{part}")
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(root, dtype=kind, mode="r")
    with fs.open_input_file(root) as source:
        return np.frombuffer(source.read(), dtype=kind)


class DigestArray:
    """Vectorised exact lookup in a sorted digest array; shards are opened once per task."""

    def __init__(self, shards: Sequence[str]):
        self.parts = [tuple(_mapped(s, part, kind) for part, kind in (("keys", "<i8"), ("ends", "<i8"), ("texts", "u1"))) for s in shards]

    def contains(self, texts: list[bytes]) -> np.ndarray:
        import xxhash

        wanted = np.fromiter((xxhash.xxh64_intdigest(text, 42) for text in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
        found = np.zeros(len(texts), dtype=bool)
        for keys, ends, stored in self.parts:
            at = np.searchsorted(keys, wanted, side="left")
            while True:
                inside = at < len(keys)
                hit = np.flatnonzero(inside & (keys[np.minimum(at, len(keys) - 1)] == wanted) & ~found)
                for k in hit:
                    found[k] = stored[ends[at[k]] : ends[at[k] + 1]].tobytes() == texts[k]
                more = hit[~found[hit]]  # same key, other string: look at the next entry
                if not len(more):
                    break
                moved = np.full(len(texts), len(keys))
                moved[more] = at[more] + 1
                at = moved
        return found


def candidates(host: str, path: str) -> list[bytes]:
    """Strings whose listing blocks a URL: its host, every parent domain, and its host with every folder of its path."""
    labels = host.split(".")
    domains = [".".join(labels[k:]) for k in range(len(labels))]
    folders = path.split("/")
    prefixes = ["/".join(folders[:k]) for k in range(2, len(folders) + 1)] if path else []
    return [text.encode() for text in [*domains, *[host + prefix for prefix in prefixes]] if text]


def listed(pages: DataFrame, shards: Sequence[str], host: str, path: str) -> DataFrame:
    """``pages`` with a boolean ``listed``: whether any candidate string of its URL is in the digest array."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(shards)
        for batch in batches:
            rows = pd.DataFrame({"host": batch.column(host).to_pylist(), "path": batch.column(path).to_pylist()}).fillna("")
            strings = [candidates(h, p) for h, p in zip(rows["host"], rows["path"], strict=True)]
            counts = np.array([len(group) for group in strings], dtype=np.int64)
            hit = index.contains([text for group in strings for text in group])
            owner = np.repeat(np.arange(len(strings)), counts)
            yes = np.zeros(len(strings), dtype=bool)
            yes[owner[hit]] = True
            yield batch.append_column("listed", pa.array(yes))

    schema = pages.withColumn("listed", F.lit(True)).schema
    return pages.mapInArrow(probe, schema)


def filter_urls(
    pages: DataFrame,
    blocked: DataFrame,
    column: str,
    *,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Per row of ``pages``: ``row`` (the columns to ``keep``, default all), host, path, rule, listed and verdict.

    The verdict is the rule's action, else ``block`` for a listed URL and ``allow`` otherwise. A null URL, or one
    without ``://``, has an empty host and path and is allowed; repeated rows are judged each.
    """
    shards = build_index(blocked, column, pages.sparkSession)
    host, path = url_parts(F.col(f"in_{url}"))
    parts = packed(pages, url, keep=keep).select("row", host.alias("host"), path.alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    judged = listed(parts, shards, "host", "path").withColumns({"rule": rule, "action": action})
    return judged.select("row", "host", "path", "rule", "listed", verdict.alias("verdict"))


def _oracle() -> str:
    names = ", ".join(f"('{name}')" for name in BLOCKED)
    rules = ", ".join(f"('{act}', '{host}', '{path}')" for act, host, path in RULES)
    return f"""
with parts as (
    select page_id, row_number() over () as rid,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
    from pages),
rules(action, h, p) as (values {rules}),
names(name) as (values {names}),
fits as (
    select rid, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as action
    from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid),
bad as (select distinct rid from parts join names on host = name or ends_with(host, '.' || name))
select page_id, host, path, rule,
       coalesce(action, case when bad.rid is not null then 'block' else 'allow' end) as verdict
from parts left join fits using (rid) left join bad using (rid)
"""


@query("op10_url_filter", _oracle())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL judged by the rules and, where none fits, by the list of domains."""
    blocked = spark.createDataFrame([(name,) for name in BLOCKED], "name string")
    judged = filter_urls(table(spark, sf_dir, "pages"), blocked, "name", keep=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")
