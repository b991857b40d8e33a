"""Token alignment against brute force over whole texts, and its edge cases."""

import collections
import hashlib

import numpy as np
import pytest

pytest.importorskip("feedwright.llm")

from pyspark.sql import functions as F

from feedwright.llm import alignment
from feedwright.llm.packing import public_tokenizer
from feedwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Rows in order of the texts, each encoded whole, links by comparing all byte ranges of both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizer())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.public_piece_model())
    alphabet = alignment.byte_alphabet()
    found, counts = [], collections.Counter()
    for text in texts:
        want = " " + (text or "")
        a = first.encode(want, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, second.id_to_piece(k)) for k in b)]
        if not text or b"".join(a_bytes) != want.encode() or b"".join(b_bytes) != want.encode():
            found.append(None)
            continue
        spans = lambda tokens: list(zip(np.cumsum([0, *map(len, tokens)])[:-1].tolist(), np.cumsum([*map(len, tokens)]).tolist()))
        at, bt = spans(a_bytes), spans(b_bytes)
        links, j = [], 0
        for k, (start, end) in enumerate(at):
            while bt[j][1] <= start:
                j += 1
            i = j
            while i < len(bt) and bt[i][0] < end:
                links.append((a[k], b[i]))
                i += 1
        ends = sorted({e for _, e in at} & {e for _, e in bt})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(k) for k, (s, e) in zip(a, at) if low <= s and e <= end) + "|" + ",".join(str(k) for k, (s, e) in zip(b, bt) if low <= s and e <= end)) if len(at) < 3000 else groups.append("")
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(at) < 3000 else None
        counts.update(links)
        found.append((len(a), len(b), len(ends), links, digest))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for one in found:
        if one is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, digest = one
            yield n_a, n_b, n_groups, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest


HARD = [
    None, "", " ", "a", "plain words here.\nNext line, of words", "  two  spaces ", "tab\tand\r\nreturn", "\nfirst newline", "last newline\n",
    "a \n b", "blank\n\nline", "mark ▁ inside", "▁", "end <|endoftext|> and <s> </s> <unk> <0x41> strings", "日本語 の 文章。", "é́ combining", "nul \x00 char",
    " hard space ", "soft​break   x", "🙂 emoji🙂s", "can't won't I'll", "x" * 5000, "same same same same", "same same same same", "123 4567 3.14", "\x1c\x1d sep",
    "don't\n't s", "a\n. b\n c", "...", " .", ".\n.", "\x85 next", "<0x0A>", "long " * 400,
]


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    got = QUERIES["op13_token_alignment"](spark, SF_DIR).orderBy("doc_id").collect()
    want = list(brute([text for _, text in docs]))
    assert [r["doc_id"] for r in got] == [name for name, _ in docs]
    for r, line in zip(got, want):
        mine = tuple(r[c] for c in COLUMNS)
        assert mine[:6] == line[:6] and (line[6] is None or mine[6] == line[6])


def test_hard_texts_in_small_buffers(spark, monkeypatch):
    """Many runs, tiny blocks, several groups of tasks, a cache that is forgotten."""
    monkeypatch.setattr(alignment, "BUFFER_LINKS", 50)
    monkeypatch.setattr(alignment, "BLOCK_RECORDS", 3)
    monkeypatch.setattr(alignment, "TASKS_PER_GROUP", 2)
    rows = [(k, text, "mine") for k, text in enumerate(HARD)] + [(None, "same same", None), (3, "a", "mine")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(7)
    got = alignment.align_tokens(frame, public_tokenizer(), alignment.public_piece_model())
    assert got.select("row.*").columns == frame.columns
    want = sorted(zip([(k, text) for k, text, _ in rows], brute([text for _, text, _ in rows])), key=repr)
    assert sorted((((r["row"]["doc_id"], r["row"]["text"]), tuple(r[c] for c in COLUMNS)) for r in got.collect()), key=repr) == want
    again = alignment.align_tokens(frame.limit(0), public_tokenizer(), alignment.public_piece_model())
    assert again.count() == 0


def test_one_very_long_text_and_counts(spark):
    text = "word " * 60_000 + "end"
    frame = spark.createDataFrame([(1, text), (2, "word word")], "doc_id long, text string")
    staged = alignment.aligned_runs(frame, public_tokenizer(), alignment.public_piece_model(), "text", ["doc_id"])
    counts = alignment.link_counts(staged).collect()
    first, second = alignment.pair_ids(np.array([r["pair"] for r in counts]))
    assert max(r["n"] for r in counts) == 60_002 and len(set(zip(first, second))) == len(counts)
    got = {r["row"]["doc_id"]: r for r in alignment.align_tokens(frame, public_tokenizer(), alignment.public_piece_model(), keep=["doc_id"]).collect()}
    assert got[1]["n_a"] == 60_001 and got[2]["count_sum"] == 2 * 60_002 and got[2]["n_best"] == 2


def test_merge_counts_pairs_over_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_RECORDS", 5)
    rng = np.random.default_rng(1)
    runs, want = [], collections.Counter()
    for _ in range(6):
        keys, counts = np.unique((rng.integers(0, 12, 60) << alignment.DOC_BITS) | rng.integers(0, 4, 60), return_counts=True)
        runs.append(alignment.write_run(keys, counts))
        for key, n in zip(keys.tolist(), counts.tolist()):
            want[key >> alignment.DOC_BITS] += n
    got = [(int(p), int(n)) for pairs, counts in alignment.merged_counts(runs) for p, n in zip(pairs, counts)]
    assert got == sorted(want.items())
    assert list(alignment.merged_counts([])) == []
