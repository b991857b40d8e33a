"""Near-duplicate texts by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most three bits exactly if some word lies within one bit of the one and two bits of
the other. So fingerprints send out the variants within half the radius: all of them those within one bit, and those of
even parity also those within two bits (at an odd distance one of the two is even; at distance two the one-bit balls
meet). Whoever meets in a variant with a one-bit sender is a verified link, and linking every sender of a variant to its
smallest one-bit sender keeps components whole with as many links as senders: no pairs within a group.

Variants are shuffled by prefix: a fingerprint goes to every cell that holds one of its variants, and the cell's task
makes the variants there, in blocks. Cells that texts of one template fill get longer prefixes. Only distinct
fingerprints take part, so exact copies cost one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedwright.llm.common import query, table, unpacked
from feedwright.llm.components import components
from feedwright.staging import stage

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints per cell that the number of prefix bits aims at.
CELL_FINGERPRINTS = 1024
# Variants made at a time in a cell's task, and the most one-bit variants of a cell.
BLOCK_VARIANTS = 1 << 20
# Bits by which the prefix of a cell above that grows at a time.
SPLIT_BITS = 4


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    import xxhash

    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones, block = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), 1 << 15
    for at in range(0, len(starts), block):
        hashes = b"".join([digest(text[s:e], SEED) for s, e in zip(starts[at : at + block], ends[at : at + block], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to ``keep`` with ``digest`` (XXH64 of the text) and ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                fingerprint((value.as_py() or b"").lower().split(), shingle)
                for value in batch.column("in_text").cast(pa.large_binary())
            ]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield batch.drop_columns(["in_text"]).append_column("fp", fp)

    columns = [F.col(f"`{name}`") for name in keep]
    given = docs.select(*columns, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"), F.col(f"`{text}`").alias("in_text"))
    return given.mapInArrow(run, given.drop("in_text").withColumn("fp", F.lit(0).cast("long")).schema)


def cells(prefix_bits: int) -> Column:
    """Cells, by prefix, that hold variants of ``fp``: within one bit of its prefix, within two if its parity is even."""
    flips = [0, *[1 << k for k in range(prefix_bits)]]
    pairs = [(1 << k) | (1 << m) for k in range(prefix_bits) for m in range(k)]
    prefix = F.shiftrightunsigned("fp", 64 - prefix_bits)
    near = F.array(*[F.lit(flip).cast("long") for flip in flips])
    wide = F.array(*[F.lit(flip).cast("long") for flip in [*flips, *pairs]])
    return F.transform(F.when(F.bit_count("fp") % 2 == 0, wide).otherwise(near), lambda flip: flip.bitwiseXOR(prefix))


def _flips(low_bits: int, most: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(low_bits, dtype=np.uint64)
    if most == 0:
        return np.zeros(1, dtype=np.uint64)
    if most == 1:
        return np.concatenate([np.zeros(1, dtype=np.uint64), one])
    a, b = np.triu_indices(low_bits, 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), one, one[a] | one[b]])


def links_in_cell(fps: np.ndarray, cell: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest linked fingerprint) for what meets in the variants of one cell: a spanning forest."""
    low_bits = 64 - prefix_bits
    fps = np.unique(fps)
    off = (fps >> np.uint64(low_bits)) ^ np.uint64(cell)
    distance = np.bitwise_count(off)
    inside = fps ^ (off << np.uint64(low_bits))  # the fingerprint moved into the cell
    even = np.bitwise_count(fps) % 2 == 0

    # One-bit senders.
    keys, owners = [], []
    for apart, most in ((0, 1), (1, 0)):
        who = np.flatnonzero(distance == apart)
        flips = _flips(low_bits, most)
        keys.append((inside[who][:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(who, len(flips)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))  # owners are in order of fingerprints
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    variant, centre = key[first], owner[first]
    centre_of = np.repeat(centre, np.diff(np.append(first, len(key))))
    pairs = [np.unique(owner[owner != centre_of].astype(np.int64) * len(fps) + centre_of[owner != centre_of])]

    # Two-bit senders of even parity, in blocks; a bitmap of the variants passes by most of what nobody else sent.
    if len(variant):
        shift = np.uint64(64 - min(24, max(10, int(len(variant)).bit_length() + 5)))
        mix = np.uint64(0x9E3779B97F4A7C15)
        seen = np.zeros(1 << int(64 - shift), dtype=bool)
        seen[(variant * mix) >> shift] = True
        for apart in (0, 1, 2):
            flips = _flips(low_bits, 2 - apart)
            who = np.flatnonzero(even & (distance == apart))
            step = max(1, BLOCK_VARIANTS // len(flips))
            for at in range(0, len(who), step):
                mine = who[at : at + step]
                made = (inside[mine][:, None] ^ flips[None, :]).ravel()
                maybe = np.flatnonzero(seen[(made * mix) >> shift])
                place = np.minimum(np.searchsorted(variant, made[maybe]), len(variant) - 1)
                hit = variant[place] == made[maybe]
                a, b = mine[maybe[hit] // len(flips)], centre[place[hit]]
                pairs.append(np.unique(a[a != b].astype(np.int64) * len(fps) + b[a != b]))
    linked = np.unique(np.concatenate(pairs))
    a, b = linked // max(1, len(fps)), linked % max(1, len(fps))
    true = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a[true].tolist(), b[true].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    touched = np.unique(np.concatenate([a[true], b[true]]))
    roots = np.array([root(x) for x in touched.tolist()], dtype=np.int64)
    moved = roots != touched
    return fps[touched[moved]], fps[roots[moved]]


def cell_members(distinct: DataFrame, prefix_bits: int) -> DataFrame:
    """(fp, cell, bits): the cells that each fingerprint goes to, none with more than ``BLOCK_VARIANTS`` one-bit variants.

    A cell above that is taken apart by further bits of the prefix under the same rule: a fingerprint goes to those parts
    that hold one of its variants. A cell of all 64 bits is one variant, so this ends however alike fingerprints are.
    """
    bits, parts = prefix_bits, []
    pending = distinct.select("fp", F.explode(cells(bits)).alias("cell"))
    while bits < 64:
        own = F.shiftrightunsigned("fp", 64 - bits) == F.col("cell")
        sizes = pending.groupBy("cell").agg(F.sum(F.when(own, 64 - bits + 1).otherwise(1)).alias("n"))
        hot = stage(sizes.where(F.col("n") > BLOCK_VARIANTS).select("cell"), "hot-cells")
        if hot.isEmpty():
            break
        parts.append(pending.join(hot, "cell", "left_anti").select("fp", "cell", F.lit(bits).alias("bits")))
        step = min(SPLIT_BITS, 64 - bits)
        mask = (1 << step) - 1
        apart = F.bit_count(F.col("cell").bitwiseXOR(F.shiftrightunsigned("fp", 64 - bits)))
        left = F.when(F.bit_count("fp") % 2 == 0, 2).otherwise(1) - apart
        following = F.shiftrightunsigned("fp", 64 - bits - step).bitwiseAND(F.lit(mask).cast("long"))
        ways = F.array(*[F.lit(k).cast("long") for k in range(mask + 1)])
        near = F.filter(ways, lambda way: F.bit_count(way.bitwiseXOR(following)) <= left)
        inner = F.transform(near, lambda way: F.shiftleft("cell", step).bitwiseOR(way))
        pending = stage(pending.join(hot, "cell", "left_semi").select("fp", F.explode(inner).alias("cell")), "cells")
        bits += step
    parts.append(pending.select("fp", "cell", F.lit(bits).alias("bits")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between the fingerprints ``fp`` of a table of distinct ones that keep components at radius 3 whole."""
    prefix_bits = min(24, max(4, math.ceil(math.log2(max(1, distinct.count()) / CELL_FINGERPRINTS + 1))))

    def run(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy().view(np.uint64)
        u, v = links_in_cell(fps, group["cell"][0].as_py() & ((1 << 64) - 1), group["bits"][0].as_py())
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return cell_members(distinct, prefix_bits).groupBy("cell", "bits").applyInArrow(run, "u long, v long")


def near_duplicates(fps: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``fps`` (with ``fp``) and ``component_id``, the smallest id reachable over links of at most three bits.

    NULL ids name no component; one that has no other id has NULL. Texts without words have fingerprint zero and link
    like any other. Repeated rows share a component.
    """
    groups = stage(fps.groupBy("fp").agg(F.min(doc_id).alias("least")), "fingerprints")
    found = components(stage(near_links(groups.select("fp")), "links"))
    roots = groups.join(found, groups["fp"] == found["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least"
    )
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    members = roots.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(members, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one per id and text.

    Rows without an id stay only where their component has no id, exact repeats once.
    """
    fps = stage(fingerprints(docs, text, keep=(doc_id,)), "fingerprints")
    judged = near_duplicates(fps, doc_id)
    dropped = (
        judged.where(~F.col(doc_id).eqNullSafe(F.col("component_id")))
        .select(F.col(doc_id).alias("_id"), F.col("digest").alias("_other"))
        .distinct()
    )
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("digest")
    )
    kept = given.join(dropped, (F.col("digest") == F.col("_other")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    return unpacked(kept.dropDuplicates(["id", "digest"]), docs.columns)


@query("op8_simhash_near_duplicates")
def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    fps = stage(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return near_duplicates(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
