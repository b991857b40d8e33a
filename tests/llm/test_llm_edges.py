"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import hashlib
import time

import pytest

pytest.importorskip("feedwright.llm")

from pyspark.sql import functions as F

from feedwright.llm import (
    components,
    decontaminate,
    language_model,
    license_scan,
    packing,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    url_filter,
    warc,
)
from feedwright.staging import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n_words", "found", "row", "digest", "fp", "component_id", "kept", "scores", "cut", "body", "stratum", "words", "spans", "id", "did", "_digest"]
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"w{k}" for k in range(60_000))
ROWS = [
    (1, "one two three " + PASSAGE, "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (None, "no id here", "xx", "b", 10),
    (None, None, None, None, None),
    (4, LONG, "de", "c", len(LONG)),
    (5, "same text twice " * 20, "en", "c", 3),
    (5, "same text twice " * 20, "en", "c", 3),
    (6, "same text twice " * 20, "fr", "c", 3),
    (7, " \t\n ", "en", "c", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *[F.lit(f"extra {name}").alias(name) for name in CLASHING])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, "three alpha"), (None, "one two"), (4, None), (5, ""), (6, "!!")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(frame):
    return sorted([r["doc_id"] for r in frame.collect()], key=repr)


def test_decontamination(docs, none, items):
    found = decontaminate.find_test_strings(docs, items)
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["found"] for r in found.collect()}
    assert len(got) == 9 and found.count() == 10
    first = got[(1, ROWS[0][1])]
    assert (first["n_words"], first["item_ids"]) == (23, ["1", "2"])
    assert [tuple(s) for s in first["spans"]] == [(2, 23)]
    assert got[(2, None)]["n_words"] == 0 and got[(7, " \t\n ")]["item_ids"] == []
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == 9 and 1 not in ids(clean)
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 10
    assert decontaminate.decontaminate(none, items).count() == 0


def test_decontamination_in_blocks(docs, items):
    whole = decontaminate.find_test_strings(docs, items, keep=["doc_id"])
    blocks = decontaminate.find_test_strings(docs, items, keep=["doc_id"], string_bytes=200)
    key = lambda frame: sorted(map(repr, frame.collect()))
    assert key(whole) == key(blocks)


def test_quality_rules(docs, none, labels):
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and ids(kept) == [4]
    assert quality_rules.keep_good(docs, labels.limit(0)).count() == 1
    assert quality_rules.keep_good(none, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    rows = [(k, n) for n in (0, 1, 10, 400) for k in range(0, min(n, 5) + 1)]
    frame = spark.createDataFrame(rows, "k long, n long")
    got = frame.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for row in got:
        want = sum(comb(row["n"], i) * 0.02**i * 0.98 ** (row["n"] - i) for i in range(row["k"] + 1))
        assert row["p"] == pytest.approx(1.0 if row["k"] > 0.02 * row["n"] else want, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    """Good documents score low, bad ones high: the cutoff between them is found where there are enough labels."""
    rows = [(k, "en", k, False, [0.01 * (k % 20), 0.0, 0.0, 0.0, 0.0]) for k in range(2000)]
    rows += [(k, "en", k, False, [0.9, 0.0, 0.0, 0.0, 0.0]) for k in range(2000, 2200)]
    rows += [(k, "de", k, False, [0.9, 0.0, 0.0, 0.0, 0.0]) for k in range(2200, 2250)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, digest long, base_failed boolean, scores array<double>")
    labels = spark.createDataFrame([(k, int(k < 2000)) for k in range(2250)], "doc_id long, quality int")
    cutoffs = {r["stratum"]: r["cutoffs"] for r in quality_rules.certified_cutoffs(measured, labels).collect()}
    assert cutoffs == {"en": {"symbols": 0.8}}


def test_sharding(docs, none):
    rows = sharding.shard_rows(docs, ["doc_id"]).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(10))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert max(map(len, by_shard.values())) - min(len(by_shard.get(k, [])) for k in range(8)) <= 1
    assert sharding.shard_rows(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(spark, size):
    network = sharding.Feistel(spark, size)
    got = [r[0] for r in spark.range(size).select(network.permute(F.col("id"))).collect()]
    assert sorted(got) == list(range(size)) and (size < 10 or got != sorted(got))


def test_warc(spark):
    big = "x" * 5_000_000
    rows = [
        (1, "http://a/ä%\r\n", "p" * 100),
        (2, None, "p" * 100),
        (2, None, "p" * 100),
        (3, "u", "short"),
        (4, "u", "short"),
        (5, "u", None),
        (6, "u", big),
        (None, "u", big),
        (None, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    back = warc.read_archives(warc.write_archives(pages, scratch_path(spark, "archives")), with_payload=True)
    got = back.collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"]) == [
        (1, "response", None, 100),
        (2, "revisit", 1, 100),
        (2, "revisit", 1, 100),
        (3, "response", None, 5),
        (4, "response", None, 5),
        (5, "response", None, 0),
        (6, "response", None, 5_000_000),
    ]
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://a/ä%\r\n"}
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in got if r["page_id"] is None) == [("response", 0), ("revisit", 6)]
    for r in got:
        if r["payload"] is not None:
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch_path(spark, "archives"))).count() == 0


def test_warc_rejects_broken_archives():
    import io

    out = io.BytesIO()
    record = warc.record_bytes(1, "u", b"payload", None, False)
    warc.write_archive(out, iter([record, record]))
    data = out.getvalue()
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 2
    for broken in (data[:-5], data[1:], data[:6], b""):
        with pytest.raises(Exception):
            list(warc.read_archive(io.BytesIO(broken)))
    for old, new in ((b"Length: 7", b"Length: 8"), (b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n", b"pAyload\r\n"), (b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(old, new, 1))


def test_language_model(docs, none):
    scored, tokens = language_model.score_corpus(docs, F.lit(True))
    got = {(r["row"]["doc_id"], r["n_tokens"]): r for r in scored.collect()}
    assert scored.count() == 10 and got[(2, 1)]["n_known"] == 1 and got[(4, 60_001)]["n_known"] == 60_001
    assert tokens == sum(r["n_tokens"] for r in scored.collect())
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in got.values())
    untrained, tokens = language_model.score_corpus(docs, F.lit(None).cast("boolean"))
    assert tokens == 0 and {(r["n_known"], r["score"]) for r in untrained.collect()} == {(0, 0.0)}
    nothing, tokens = language_model.score_corpus(none, F.lit(True))
    assert nothing.count() == 0 and tokens == 0


def test_language_model_keeps_rows_and_clashing_columns(spark, docs):
    frame = docs.drop("n_chars")
    for name in ["rid", "gid", "train", "parts", "n_tokens"]:
        frame = frame.withColumn(name, F.lit(name))
    scored, _ = language_model.score_corpus(frame, F.col("train") == "train", keep=frame.columns)
    assert {tuple(r["row"])[-5:] for r in scored.collect()} == {("rid", "gid", "train", "parts", "n_tokens")}
    twice = [(r["score"], r["n_tokens"]) for r in scored.where("row.doc_id = 5").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    required = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert [r["n_known"] for r in language_model.score_corpus(required, F.lit(True))[0].collect()] == [3, 3, 3]


def test_long_texts_are_scored_alike_in_blocks(spark, docs, monkeypatch):
    texts = spark.createDataFrame([(k, "a b c d " * 40 * (k + 1)) for k in range(4)], "doc_id long, text string")
    score = lambda: {r["row"]["doc_id"]: (r["n_tokens"], round(r["score"], 6)) for r in language_model.score_corpus(texts, F.lit(True))[0].collect()}
    whole = score()
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 100)
    monkeypatch.setattr(language_model, "GROUP_TOKENS", 50)
    assert score() == whole


def test_suffix_dedup(docs, none):
    rows = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeat_report(docs).collect()), key=repr)
    # The repeats inside the text go at its first occurrence too, and all of it at the others.
    assert [r for r in rows if r[0] == 5] == [(5, 320, 304), (5, 320, 320)] and (6, 320, 320) in rows
    assert len(rows) == 10 and (None, 0, 0) in rows and (2, 0, 0) in rows
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == 10
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}[6] == ("", 0)
    assert suffix_dedup.repeat_report(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, packing.public_tokenizer()).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) > 60_000
    assert packing.pack_documents(none, packing.public_tokenizer()).count() == 0


def test_simhash(docs, none):
    fps = simhash.fingerprints(docs)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(fps).collect()}
    assert {group for (name, _), group in got.items() if name in (5, 6)} == {5}
    assert {group for (_, fp), group in got.items() if fp == 0} == {2}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 2, 4, 5, None]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (200, 200), (100, 101)]
    got = dict(components.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_license_scan(spark, docs, none):
    templates = spark.createDataFrame(list(license_scan.TEMPLATES), "license string, text string")
    texts = [name_text[1] for name_text in license_scan.TEMPLATES]
    rows = [(k, f"some words before.\n{text.upper()}\nand after") for k, text in enumerate(texts)] + [(90, None), (91, ""), (None, texts[0]), (90, texts[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine"))
    got = {(r["doc_id"], r["license"]) for r in license_scan.find_licenses(frame, templates).collect()}
    assert {(k, name) for k, (name, _) in enumerate(license_scan.TEMPLATES)} <= got
    assert (None, license_scan.TEMPLATES[0][0]) in got and (90, license_scan.TEMPLATES[2][0]) in got
    assert license_scan.find_licenses(docs, templates).count() == 0
    assert license_scan.find_licenses(none, templates).count() == 0
    assert license_scan.find_licenses(frame, templates.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.find_licenses(frame, spark.createDataFrame([("x", "two words")], "license string, text string"))


def test_license_in_a_very_long_text(spark):
    """Work on a text with a license grows with its words: 60,000 of them end soon."""
    templates = spark.createDataFrame(list(license_scan.TEMPLATES), "license string, text string")
    name, body = license_scan.TEMPLATES[0]
    noise = [f"w{k % 977}" for k in range(60_000)]
    rows = [(1, " ".join([*noise[:40_000], body, *noise[40_000:]])), (2, " ".join(noise))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    found = license_scan.find_licenses(docs, templates).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in found] == [(1, name, 1.0)]
    assert time.time() - began < 100


def test_license_bands_meet_their_guarantee():
    bands = license_scan.bands_for()
    assert (1 - license_scan.LEAST_SHINGLES / (2 * license_scan.SEGMENT)) ** bands <= license_scan.MISS


def test_url_filter(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?q#f"),
        (2, "https://a.example.net/fr"),
        (3, "https://a.example.net"),
        (4, "http://example.com/de/"),
        (5, "http://notexample.com/de/"),
        (6, "http://x.org/fr/a"),
        (7, None),
        (8, "no scheme"),
        (9, "ftp://sub.bad.host:80/p://q"),
        (10, "http://bad.host/dir/page"),
        (11, "http://ok.host/dir/page"),
        (11, "http://ok.host/dir/page"),
        (12, "http://ok.host/listed/page?x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("mine"))
    blocked = spark.createDataFrame([("BAD.host",), ("bad.host",), (None,), ("",), ("ok.host/listed",), ("sub.bad.host:80",)], "name string")
    judged = url_filter.filter_urls(pages, blocked, "name")
    got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert judged.count() == 13 and judged.select("row.*").columns == pages.columns
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("a.example.net", "/fr", "net/", "block"),
        3: ("a.example.net", "", None, "allow"),
        4: ("example.com", "/de/", "example.com/de/", "block"),
        5: ("notexample.com", "/de/", None, "allow"),
        6: ("x.org", "/fr/a", "org/fr/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("sub.bad.host:80", "/p://q", None, "block"),
        10: ("bad.host", "/dir/page", None, "block"),
        11: ("ok.host", "/dir/page", None, "allow"),
        12: ("ok.host", "/listed/page", None, "block"),
    }
    assert url_filter.filter_urls(pages, blocked.limit(0), "name").where("listed").count() == 0
    assert url_filter.filter_urls(pages.limit(0), blocked, "name").count() == 0


def test_equal_keys_are_confirmed_by_text(tmp_path):
    """Two stored strings under one key: only the stored text itself is found."""
    import numpy as np
    import xxhash

    key = np.array([xxhash.xxh64_intdigest(b"wanted", 42)] * 2, dtype=np.uint64).view("<i8")
    (tmp_path / "keys").write_bytes(key.tobytes())
    (tmp_path / "ends").write_bytes(np.array([0, 5, 11], dtype="<i8").tobytes())
    (tmp_path / "texts").write_bytes(b"otherwanted")
    assert url_filter.DigestArray([str(tmp_path)]).contains([b"wanted", b"other"]).tolist() == [True, False]


def test_crowded_cells_get_longer_prefixes(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "BLOCK_VARIANTS", 2000)
    rng = np.random.default_rng(8)
    centre = 0xF123456789ABCDEF
    fps = {centre}
    while len(fps) < 300:  # texts of one template: a few bits around one fingerprint
        fp = centre
        for bit in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            fp ^= 1 << int(bit)
        fps.add(fp)
    fps = sorted(fps)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    distinct = spark.createDataFrame([(fp,) for fp in signed], "fp long")
    members = simhash.cell_members(distinct, 4).collect()
    sizes = {}
    for row in members:
        own = (row["fp"] % (1 << 64)) >> (64 - row["bits"]) == row["cell"] % (1 << row["bits"])
        key = (row["cell"], row["bits"])
        sizes[key] = sizes.get(key, 0) + (64 - row["bits"] + 1 if own else 1)
    assert max(sizes.values()) <= 2000 and len({bits for _, bits in sizes}) > 1

    def groups(links):
        parent = {fp: fp for fp in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            u, v = sorted((root(u), root(v)))
            parent[v] = u
        return [root(fp) for fp in signed]

    near = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert groups([(r["u"], r["v"]) for r in simhash.near_links(distinct).collect()]) == groups(near)


def test_license_passages_without_a_band_count(spark, monkeypatch):
    # One band meets few of the passages that are left in part; those that it does not meet count all the same.
    monkeypatch.setattr(license_scan, "bands_for", lambda *args, **named: 1)
    template = [f"t{k}" for k in range(102)]
    text = [word if k % 15 != 7 else f"x{k}" for k, word in enumerate(template)]
    rows = [(k, " ".join([f"n{k}x{j}" for j in range(k)] + text)) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    templates = spark.createDataFrame([("T", " ".join(template))], "license string, text string")
    whole = {" ".join(template[k : k + 3]) for k in range(100)}
    n = len(whole & {" ".join(text[k : k + 3]) for k in range(100)})
    monkeypatch.setattr(license_scan, "CONTAINMENT", 0.5)
    got = {r["doc_id"]: r["n_shingles"] for r in license_scan.find_licenses(docs, templates).collect()}
    assert got == {k: n for k in range(12)}
