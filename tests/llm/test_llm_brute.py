"""Operators that SQL cannot express, against brute force over small whole tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("feedwright.llm")

from feedwright.llm import packing, simhash, suffix_dedup
from feedwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            ones[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def brute_components(ids, fingerprints, radius=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, name in enumerate(ids):
        least[root(k)] = min(name, least.get(root(k), name))
    return [least[root(k)] for k in range(len(ids))]


def brute_repeats(rows):
    """Rows in order of id; byte strings of 100 seen before are covered."""
    seen, out = set(), []
    for name, text in rows:
        body = (text or "").encode()
        covered = bytearray(len(body))
        for k in range(len(body) - 99):
            window = body[k : k + 100]
            if window in seen:
                covered[k : k + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(value for value, gone in zip(body, covered) if not gone)
        spans = sum(1 for k, gone in enumerate(covered) if gone and (k == 0 or not covered[k - 1]))
        out.append((name, len(body), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_simhash_query(spark, docs):
    got = sorted(tuple(r) for r in QUERIES["op8_simhash_near_duplicates"](spark, SF_DIR).collect())
    prints = [brute_fingerprint(text) for _, text in docs]
    groups = brute_components([name for name, _ in docs], prints)
    assert got == [(name, f"{fp:016x}", group) for (name, _), fp, group in zip(docs, prints, groups)]


def test_cells_find_every_link_up_to_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    family = [base]
    for flips in (1, 2, 3, 3, 4):
        changed = base.copy()
        for k in range(len(base)):
            for bit in rng.choice(64, flips, replace=False):
                changed[k] ^= np.uint64(1) << np.uint64(bit)
        family.append(changed)
    fps = np.unique(np.concatenate(family))
    for prefix_bits in (4, 7):
        links = []
        for cell in range(1 << prefix_bits):
            prefix = fps >> np.uint64(64 - prefix_bits)
            apart = np.bitwise_count(prefix ^ np.uint64(cell))
            reach = np.where(np.bitwise_count(fps) % 2 == 0, 2, 1)
            links += zip(*simhash.links_in_cell(fps[apart <= reach], cell, prefix_bits))
        parent = {int(fp): int(fp) for fp in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            parent[root(int(u))] = root(int(v))
        want = brute_components(list(range(len(fps))), [int(fp) for fp in fps])
        mine = collections.defaultdict(set)
        for k, fp in enumerate(fps):
            mine[root(int(fp))].add(want[k])
        assert all(len(group) == 1 for group in mine.values()) and len(mine) == len(set(want))


def test_suffix_dedup_query(spark, docs):
    got = sorted(tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, SF_DIR).collect())
    assert got == brute_repeats(docs)


def test_suffix_dedup_hard_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "GRAM_ENTRIES", 3)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ENTRIES", 500)
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = noise(260)
    rows = [(k, noise(int(rng.integers(0, 150))) + shared[k % 3 :] + noise(int(rng.integers(0, 150)))) for k in range(40)]
    rows += [(100, "x" * 2500), (101, "ab" * 900), (102, None), (103, ""), (104, shared[:99]), (105, noise(3000) * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in suffix_dedup.repeat_report(frame).collect())
    assert got == brute_repeats(rows)


def test_marks_of_copies_spread_over_buckets():
    n, buckets = 4000, 16
    did, digest, doc = np.arange(n), np.full(n, 12345), np.arange(n)
    rows = list(suffix_dedup._marks(suffix_dedup.OPEN, did, digest, doc, np.zeros(n, dtype=np.int64), np.full(n, 9), buckets))
    sizes = collections.Counter({bucket: np.frombuffer(data, "<i8", 1)[0] for _, bucket, data in rows})
    assert len(sizes) == buckets and sum(sizes.values()) == n and max(sizes.values()) < 2 * n / buckets
    # Marks of one document stay together, whatever task sends them.
    alone = [list(suffix_dedup._marks(suffix_dedup.REPEAT, did[k : k + 1], digest[:1], doc[:1], doc[:1], doc[:1], buckets))[0][1] for k in range(50)]
    again = [list(suffix_dedup._marks(suffix_dedup.OPEN, did, digest, doc[k : k + 1], doc[:1], doc[:1], buckets))[0][1] for k in range(50)]
    assert alone == again


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    rows = QUERIES["op7_best_fit_packing"](spark, SF_DIR).collect()
    encoder = Tokenizer.from_file(packing.public_tokenizer())
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
        by_bin[row["sequence_id"]].append(row)
    for name, text in docs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for number, row in enumerate(sorted(by_doc.pop(name), key=lambda r: r["piece"])):
            own = np.array(ids[at : at + row["length"]], dtype="<u4")
            assert (row["piece"], row["start"], zlib.crc32(own.tobytes())) == (number, at, row["ids_crc32"])
            assert row["length"] == 2048 or number == 0
            at += row["length"]
        assert at == len(ids)
    assert not by_doc
    for group in by_bin.values():
        at = 0
        for row in sorted(group, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= 2048
    assert len(by_bin) <= 1.02 * math.ceil(sum(row["length"] for row in rows) / 2048) + 1


@pytest.mark.parametrize("score", ["residual", "dot"])
def test_vector_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(1)
    histogram = collections.Counter(rng.integers(1, 300, 4000).tolist())
    limits = dict(capacity=300, max_docs=4, max_cost=50_000)
    limits["max_cost"] = max(limits["max_cost"], 299**2)
    plan = packing.vector_best_fit(dict(histogram), score=score, **limits)
    bins = collections.defaultdict(list)
    ranks = collections.Counter()
    for length, first, each, first_bin, offset in sorted(plan.slots):
        assert first == ranks[length]
        later = [s[1] for s in plan.slots if s[0] == length and s[1] > first]
        count = (min(later) if later else histogram[length]) - first
        ranks[length] += count
        for nth in range(count):
            bins[first_bin + nth // each].append((offset + nth % each * length, length))
    assert ranks == histogram and len(bins) == plan.bins
    for inside in bins.values():
        assert len(inside) <= limits["max_docs"] and sum(n * n for _, n in inside) <= limits["max_cost"]
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= limits["capacity"]


def test_word_tokenizer_equals_whole_texts():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    with open(path, encoding="utf-8") as source:
        mine = packing.WordTokenizer(source.read())
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(2)
    parts = ["a", "b'", "'s", "it's", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "1", ".", ",", "!!", "###", " a", "don't", "日本", "😀", "\x1c", "\r\n", "x,y"]
    texts = ["", " ", "\n", "a ", " a", *["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]]
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_strings_of_added_tokens_have_their_ids():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    with open(path, encoding="utf-8") as source:
        mine = packing.WordTokenizer(source.read())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "a <|endoftext| b", "plain text"]
    whole = Tokenizer.from_file(path)
    for text, ids in zip(texts, mine.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_language_model_query(spark, docs):
    tokens = {name: [*(text or "").encode().lower().split(), b"\0end"] for name, text in docs}
    out = {name for name in tokens if zlib.crc32(str(name).encode()) % 7 == 2}
    counts = collections.Counter(word for name, words in tokens.items() if name not in out for word in words)
    n, types = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    rows = QUERIES["op5_backoff_automaton"](spark, SF_DIR).collect()
    assert len(rows) == len(tokens)
    for row in rows:
        words = tokens[row["doc_id"]]
        base = sum(math.log10((counts[word] + 1) / (n + types + 1)) for word in words)
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (row["doc_id"] in out, len(words), n)
        assert row["n_known"] == sum(counts[word] > 0 for word in words)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        if row["held_out"]:
            held[0] += row["base_score"]
            held[1] += row["score"]
    assert held[1] > held[0]


def test_model_probabilities_sum_to_one():
    import pyarrow as pa

    from feedwright.llm import language_model as lm

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 60, p=[0.4, 0.3, 0.2, 0.1])).encode() for _ in range(30)]
    block = next(iter(lm.token_blocks(texts)))
    group = lm.Group(lm.group_row(block.key, block.doc, 0, np.ones(30, dtype=bool)))
    answers = lm.count_grams(2)(lm._sent(group.ask_counts(0, 1))).to_pylist()
    tokens, types = len(block.key), sum(row["types"] for row in answers)
    assert (tokens, types) == (30 * 61, 5)
    group.learn_counts(answers)
    automaton = group.automaton(lm.sum_contexts(2)(lm._sent(group.ask_contexts(0, 1))).to_pylist(), tokens + types + 1)
    assert len(automaton.arcs) > 1 and max(automaton.target) > types  # contexts of two words
    unknown = 1 / (tokens + types + 1)
    for state in {0, *automaton.after, *automaton.target}:
        total, missing, at = 0.0, unknown, state
        for word in range(types):
            total += 10 ** automaton.walk([word], state)[0]
        while at:
            missing *= 10 ** automaton.back[at]
            at = automaton.fail[at]
        assert total + missing == pytest.approx(1, abs=1e-9)


def test_model_strands_equal_one_traversal(monkeypatch):
    from feedwright.llm import language_model as lm

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], n)).encode() for n in rng.integers(0, 40, 60)]
    block = next(iter(lm.token_blocks(texts)))
    group = lm.Group(lm.group_row(block.key, block.doc, 0, np.arange(60) % 3 > 0))
    answers = lm.count_grams(2)(lm._sent(group.ask_counts(0, 1))).to_pylist()
    group.learn_counts(answers)
    automaton = group.automaton(lm.sum_contexts(2)(lm._sent(group.ask_contexts(0, 1))).to_pylist(), 2000.0)
    fresh = np.concatenate([[False], group.doc[1:] != group.doc[:-1]])
    arcs = {key: k for k, key in enumerate(automaton.arcs.tolist())}
    state, expected = 0, []
    for word, new in zip(group.one.tolist(), fresh.tolist(), strict=True):
        state, p = 0 if new else state, 0.0
        while state and state * len(automaton.root) + word not in arcs:
            p, state = p + automaton.back[state], int(automaton.fail[state])
        arc = arcs.get(state * len(automaton.root) + word)
        p += automaton.root[word] if arc is None else automaton.log[arc]
        state = int(automaton.after[word] if arc is None else automaton.target[arc])
        expected.append(p)
    for strands in (1, 2, 7, 300, 5000):
        monkeypatch.setattr(lm, "STRANDS", strands)
        assert automaton.walk(group.one, 0, fresh) == pytest.approx(np.array(expected), abs=1e-12)
    assert len(automaton.walk([])) == 0


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from feedwright.llm.decontaminate import words_of

    labelled = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [r["doc_id"] for r in QUERIES["op1_quality_rules"](spark, SF_DIR).where("kept").collect()]
    rows = [(name, text) for name, text in docs if name in set(kept)]
    groups = brute_components([name for name, _ in rows], [brute_fingerprint(text) for _, text in rows])
    rows = [row for row, group in zip(rows, groups) if row[0] == group]
    seen, cut = set(), []
    for name, text in rows:
        body = (text or "").encode()
        covered = bytearray(len(body))
        for k in range(len(body) - 99):
            if body[k : k + 100] in seen:
                covered[k : k + 100] = b"\1" * 100
            seen.add(body[k : k + 100])
        cut.append((name, bytes(value for value, gone in zip(body, covered) if not gone).decode(errors="ignore")))
    windows = set()
    for item in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        words = words_of(item["text"].encode())
        windows |= {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12))}
    clean = []
    for name, text in cut:
        words = words_of(text.encode())
        hit = set()
        for length in {len(window) for window in windows}:
            for k in range(len(words) - length + 1):
                if tuple(words[k : k + length]) in windows:
                    hit.update(range(k, k + length))
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append((name, text))
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.public_tokenizer())
    want = sorted((name, len(encoder.encode(text, add_special_tokens=False).ids) + 1) for name, text in clean)
    got = collections.Counter()
    for row in pipeline.run(spark, SF_DIR).collect():
        got[row["doc_id"]] += row["length"]
    assert sorted(got.items()) == want
    assert labelled.count() > len(want)


def test_score_corpus_keeps_every_repeated_ngram(spark, monkeypatch):
    from feedwright.llm import language_model as lm

    monkeypatch.setattr(lm, "GROUP_TOKENS", 300)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice([f"w{j}" for j in range(30)], int(rng.integers(0, 60))))) for k in range(60)]
    rows += [(60, "a b c " * 700), (61, None), (62, "rare pair here"), (63, "rare pair here")]
    held = {k for k, _ in rows if k % 7 == 2}
    words = {k: [*(text or "").split(), "<end>"] for k, text in rows}
    counts = [collections.Counter(), collections.Counter(), collections.Counter()]
    for k, own in words.items():
        for order in () if k in held else (1, 2, 3):
            counts[order - 1].update(zip(*[own[j:] for j in range(order)]))
    tokens, types = sum(counts[0].values()), len(counts[0])
    kept = [counts[0], *[{gram: n for gram, n in level.items() if n >= 2} for level in counts[1:]]]

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (tokens + types + 1)
        return (kept[len(gram) - 1][gram] - 0.75) / kept[len(gram) - 2][gram[:-1]]

    follow = collections.defaultdict(list)
    for gram in [*kept[1], *kept[2]]:
        follow[gram[:-1]].append(gram)
    back = {context: math.log10((1 - sum(map(p, grams))) / max(1 - sum(p(gram[1:]) for gram in grams), 1e-12)) for context, grams in follow.items()}

    def log(gram):
        if len(gram) == 1 or gram in kept[len(gram) - 1]:
            return math.log10(p(gram))
        return back.get(gram[:-1], 0.0) + log(gram[1:])

    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored, n = lm.score_corpus(frame, F.col("doc_id") % 7 != 2)
    got = {r["row"]["doc_id"]: r for r in scored.collect()}
    assert n == tokens and set(got) == set(words)
    for k, own in words.items():
        want = sum(log(tuple(own[max(0, j - 2) : j + 1])) for j in range(len(own)))
        assert got[k]["n_tokens"] == len(own) and got[k]["n_known"] == sum(counts[0][(w,)] > 0 for w in own)
        assert got[k]["score"] == pytest.approx(want, rel=1e-9), k


def test_unlike_words_have_unlike_keys():
    from feedwright.llm import language_model as lm

    one = "a"
    for _ in range(9):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    key, counts = lm.word_keys([f" {one}  {other} ".encode(), b" ", f"{one} ".encode()])
    assert counts.tolist() == [2, 0, 1] and key[0] == key[2] != key[1]
