"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are lower-cased runs of letters and digits. Texts are cut into segments of ``SEGMENT`` shingle places; a window is
two neighbouring segments, so windows overlap by half. MinHash values are taken once per segment and merged per window.
Templates are cut into passages of at most ``SEGMENT + 1`` shingles: wherever a passage stands, it lies in one window.

A band is one MinHash value (one row per band). A window of 2s places that holds a passage of t shingles meets it in a
band with probability t / 2s at least, so ``bands_for`` bands miss it with at most the given probability; a collision is
only a candidate. Once a passage of a license is met, all its passages are counted in all windows of that document by their
exact shingles, so bands only retrieve: a passage that an edit or a cut has left too few shingles for them still counts.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedwright.llm.common import lower_words_sql, query, table
from feedwright.llm.quality_rules import let
from feedwright.staging import stage

SHINGLE = 3
SEGMENT = 6
CONTAINMENT = 0.8
MISS = 1e-3
# Fewest shingles of a passage that bands are set for.
LEAST_SHINGLES = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Passages whose band values one scan of the texts looks for.
BLOCK_PASSAGES = 1000

# Statements of well-known licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
)


def bands_for(places: int = 2 * SEGMENT, shingles: int = LEAST_SHINGLES, miss: float = MISS) -> int:
    """Bands after which a passage of ``shingles`` in a window of ``places`` is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - shingles / places))


def seeds(bands: int) -> list[int]:
    """One permutation of 64-bit hashes per band: exclusive or with a fixed random number."""
    import hashlib

    return [int.from_bytes(hashlib.sha256(f"band {k}".encode()).digest()[:8], "big", signed=True) for k in range(bands)]


def words(text: str) -> Column:
    return F.expr(lower_words_sql(text, WORD, "spark"))


def shingle_hashes(of: Column) -> Column:
    """Hash of the shingle at each place; a text shorter than a shingle has the one it is, an empty one none."""
    n = F.greatest(F.size(of) - SHINGLE + 1, F.lit(1))
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.coalesce(F.get(of, i + k), F.lit("")) for k in range(SHINGLE)]))
    return F.when(F.size(of) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def shingles(of: Column) -> Column:
    n = F.greatest(F.size(of) - SHINGLE + 1, F.lit(1))
    found = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(of, i, SHINGLE), " "))
    return F.when(F.size(of) == 0, F.array().cast("array<string>")).otherwise(found)


def passages(templates: DataFrame) -> DataFrame:
    """(license, total, passage, shingles) of templates (license, text), cut evenly; those without id or words are left out."""
    given = templates.where("license is not null").select("license", F.array_distinct(let(words("text"), shingles)).alias("all"))
    given = given.where(F.size("all") > 0).select("license", "all", F.size("all").alias("total"))
    count = F.ceil(F.col("total") / (SEGMENT + 1)).cast("int")
    size = F.ceil(F.col("total") / count).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("all", k * size + 1, size))
    return given.select("license", "total", F.posexplode(cut)).toDF("license", "total", "passage", "shingles").where(F.size("shingles") > 0)


def _segments(hashes: Column) -> Column:
    """Shingle hashes by segment; the last one may be shorter."""
    last = F.ceil(F.size(hashes) / SEGMENT).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(hashes, k * SEGMENT + 1, SEGMENT))


def _least(hashes: Column | str, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(seed))))


def _least_by(seed: int):
    return lambda segment: _least(segment, seed)


def band_values(parts: DataFrame, bands: int) -> DataFrame:
    """(license, passage, values): MinHash of each passage per band."""

    def hashed(shingle: Column) -> Column:
        split = F.split(shingle, " ")
        return F.xxhash64(*[F.coalesce(F.get(split, F.lit(k)), F.lit("")) for k in range(SHINGLE)])

    given = parts.withColumn("h", F.transform("shingles", hashed))
    return given.select("license", "passage", F.array(*[_least("h", seed) for seed in seeds(bands)]).alias("values"))


def candidate_windows(docs: DataFrame, wanted: list[list[int]], text: str, doc_id: str) -> DataFrame:
    """(doc_id, digest, at, span, values) of the windows that meet a wanted value in some band."""
    bands = len(wanted)
    sets = [F.array(*[F.lit(value) for value in values]) for values in wanted]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("digest"), F.col(f"`{text}`"))

    def places(minima: Column) -> Column:
        """Windows with a hit, as structs, from the minima by band and segment; NULL for a text without any.

        The minimum of a window is that of one of its segments, so a text whose segments have no wanted value has no
        window with one, and its windows need not be made.
        """
        any_hit = F.lit(False)
        for k in range(bands):
            any_hit = any_hit | F.arrays_overlap(minima[k], sets[k])

        def values(i: Column) -> Column:
            return F.array(*[F.least(F.get(minima[k], i), F.get(minima[k], i + 1)) for k in range(bands)])

        def here(window: Column) -> Column:
            found = F.lit(False)
            for k in range(bands):
                found = found | F.array_contains(sets[k], window["values"][k])
            return found

        windows = F.transform(F.sequence(F.lit(0), F.size(minima[0]) - 1), lambda i: F.struct(i.alias("i"), values(i).alias("values")))
        return F.when(any_hit, F.filter(windows, here))

    def minima(segments: Column) -> Column:
        return F.array(*[F.transform(segments, _least_by(seed)) for seed in seeds(bands)])

    def spans(of: Column) -> Column:
        def span(window: Column) -> Column:
            at = window["i"] * SEGMENT
            return F.struct(at.alias("at"), F.slice(of, at + 1, 2 * SEGMENT + SHINGLE - 1).alias("span"), window["values"].alias("values"))

        found = let(let(let(shingle_hashes(of), _segments), minima), places)
        return F.when(F.size(of) > 0, F.transform(found, span))

    # Outer, since for an inner one Spark would evaluate the spans once more as a filter.
    found = given.select("doc_id", "digest", F.explode_outer(let(words(f"`{text}`"), spans)).alias("w"))
    return found.where("w is not null").select("doc_id", "digest", "w.*")


def common_shingles(docs: DataFrame, candidates: DataFrame, parts: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, digest, license, total, passage, common, at): the best window of each passage of candidate licenses.

    Counted from all shingles of the documents, whether or not a window meets the passage in a band.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(body).alias("_digest"), F.col(f"`{text}`").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    named = candidates.select("doc_id", "digest").distinct()
    chosen = stage(given.join(named, same, "left_semi").dropDuplicates(["_id", "_digest"]), "chosen")
    # Words are bound once per text; outer, since an inner explode would be evaluated once more as a filter.
    placed = chosen.select("_id", "_digest", F.posexplode_outer(let(words("_text"), shingles)).alias("p", "shingle"))
    wanted = parts.select("license", "total", "passage", F.explode("shingles").alias("shingle"))
    hits = placed.join(wanted, "shingle").join(candidates.withColumnRenamed("license", "_license"), same & (F.col("license") == F.col("_license")))
    segment = F.floor(F.col("p") / SEGMENT)
    shared = (
        hits.select("doc_id", "digest", "license", "total", "passage", "shingle", F.explode(F.array(segment, segment - 1)).alias("i"))
        .where("i >= 0")
        .groupBy("doc_id", "digest", "license", "total", "passage", "i")
        .agg(F.count_distinct("shingle").cast("int").alias("common"))
    )
    return (
        shared.groupBy("doc_id", "digest", "license", "total", "passage")
        .agg(F.max(F.struct("common", (-F.col("i")).alias("back"))).alias("best"))
        .select("doc_id", "digest", "license", "total", "passage", "best.common", (-F.col("best.back") * SEGMENT).alias("at"))
    )


def find_licenses(docs: DataFrame, templates: DataFrame, *, text: str = "text", doc_id: str = "doc_id", miss: float = MISS) -> DataFrame:
    """(doc_id, license, containment, n_shingles, first_word) of every template contained in a text to 0.8 or more.

    ``first_word`` is where the first of the best windows starts. A document is an id with its text: repeated rows give one
    result, and a NULL id is an id. Null and empty texts hold nothing, short ones what their words hold; without
    templates nothing is found. The bands are set for passages of three shingles; a template of fewer raises.
    """
    bands = bands_for(miss=miss)
    parts = stage(passages(templates), "passages")
    if parts.where(F.col("total") < LEAST_SHINGLES).count():
        raise ValueError(f"a template needs at least {LEAST_SHINGLES} different shingles")
    values = stage(band_values(parts, bands), "bands")
    total = values.count()
    blocks = max(1, -(-total // BLOCK_PASSAGES))
    found = None
    for number in range(blocks):
        mine = values.where(F.pmod(F.xxhash64("license", "passage"), F.lit(blocks)) == number)
        rows = mine.select("values").collect()  # at most about BLOCK_PASSAGES rows
        wanted = [sorted({row["values"][k] for row in rows}) for k in range(bands)]
        if not rows:
            continue
        windows = candidate_windows(docs, wanted, text, doc_id)
        keys = mine.select("license", "passage", F.posexplode("values").alias("band", "value"))
        met = (
            windows.select("doc_id", "digest", "at", "span", F.posexplode("values").alias("band", "value"))
            .join(F.broadcast(keys), ["band", "value"])  # BLOCK_PASSAGES x bands rows
            .select("doc_id", "digest", "at", "span", "license", "passage")
            .distinct()
        )
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = candidate_windows(docs.limit(0), [[0]] * bands, text, doc_id).select(
            "doc_id", "digest", "at", "span", F.lit("").alias("license"), F.lit(0).alias("passage")
        )
    # Only a passage that shares a shingle with its window makes a candidate.
    met = found.join(parts, ["license", "passage"]).where(F.arrays_overlap(let(F.col("span"), shingles), "shingles"))
    candidates = stage(met.select("doc_id", "digest", "license").distinct(), "candidates")
    best = common_shingles(docs, candidates, parts, text, doc_id)
    return (
        best.groupBy("doc_id", "digest", "license", "total")
        .agg(F.sum("common").alias("n_shingles"), F.min("at").cast("long").alias("first_word"))
        .withColumn("containment", F.col("n_shingles") / F.col("total"))
        .where(F.col("containment") >= CONTAINMENT)
        .select("doc_id", "license", "containment", "n_shingles", "first_word")
    )


def _oracle() -> str:
    given = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return f"""
with t(license, text) as (values {given}),
tw as (select license, {lower_words_sql('text', WORD, 'duckdb')} as w from t),
ts as (select license, p, array_to_string(w[p : p + 2], ' ') as s
       from (select license, w, unnest(range(1, len(w) - 1)) as p from tw)),
t1 as (select license, s, row_number() over (partition by license order by min(p)) - 1 as k from ts group by license, s),
t2 as (select license, s, k, count(*) over (partition by license) as total from t1),
t3 as (select license, s, k, total, cast(ceil(total / ceil(total / {SEGMENT + 1}.0)) as bigint) as size from t2),
parts as (select license, s, total, k // size as passage from t3),
d as (select doc_id, coalesce(text, '') as text, {lower_words_sql('text', WORD, 'duckdb')} as w from documents),
ds as (select doc_id, text, p - 1 as p, array_to_string(w[p : p + 2], ' ') as s
       from (select doc_id, text, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from d where len(w) > 0)),
hit as (select doc_id, text, p, s, license, passage, total from ds join parts using (s)),
windows as (
    select distinct doc_id, text, s, license, passage, total, unnest([p // {SEGMENT}, p // {SEGMENT} - 1]) as i from hit),
common as (
    select doc_id, text, license, passage, total, i, count(*) as common from windows where i >= 0 group by all),
best as (
    select doc_id, text, license, total, passage, max(common) as common,
           arg_max(i, row(common, -i)) * {SEGMENT} as place
    from common group by all)
select doc_id, license, cast(sum(common) as double) / total as containment, cast(sum(common) as bigint) as n_shingles,
       cast(min(place) as bigint) as first_word
from best group by doc_id, text, license, total having sum(common) >= {CONTAINMENT} * total
"""


@query("op9_license_scan", _oracle())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    templates = spark.createDataFrame(list(TEMPLATES), "license string, text string")
    return find_licenses(table(spark, sf_dir, "documents"), templates)
