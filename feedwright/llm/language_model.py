"""Language-model scoring with a weighted backoff automaton.

N-grams up to three words are counted over the whole training part and those that occur ``LEAST`` times become the
automaton, whatever the size of the corpus: states are retained contexts, arcs carry discounted log probabilities, and
failure arcs carry backoff weights to the next shorter context; the root has every word with its add-one probability.

The automaton grows with the corpus, so it lies in buckets of hashed n-grams. Texts are taken in groups of bounded size.
A group first asks for the counts of its words and bigrams. A trigram can only be retained if both its bigrams are, so
the group then asks for those trigrams alone, at the buckets of their contexts; the buckets answer with counts and with
the sums that backoff weights are made of. From the answers a group builds its part of the automaton and walks it from
left to right, carrying the state; a text of several groups is walked on from its last two words.

The tokens of groups lie in files of the shared folder, one per task, and are read there in every round; only what groups
ask and what buckets answer is shuffled, and shuffle files of a round go when its answers are written.

Words are known by the upper 63 bits of their XXH64, n-grams by mixes of these; unequal ones share a key with a
probability of about 2**-63 per pair.

A NULL or empty text is an end token alone. Repeated rows are scored each, texts of any length whole, an empty table
gives no rows. With no training rows every word is unknown. The kept columns are in one struct, so no name can clash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedwright.llm.common import query, table
from feedwright.staging import scratch_path, stage

ORDER = 3
DISCOUNT = 0.75
# Least occurrences of a longer n-gram in the automaton.
LEAST = 2
FOLDS, HELD_OUT = 7, 2

BLOCK_BYTES = 2 << 20
# Tokens after which a group of texts ends, and bytes of text per bucket of n-grams that groups ask for.
GROUP_TOKENS = 300_000
GRAM_BUCKET_BYTES = 8 << 20
# Parts of the buckets of contexts, asked one after the other so that less lies on disk at once.
PASSES = 2
# Strands of a group that are walked side by side.
STRANDS = 2048

# A-Z to lower case, white space to a space.
FOLD = bytes(byte + 32 if 65 <= byte <= 90 else 32 if 9 <= byte <= 13 else byte for byte in range(256))
END = np.uint64(0x5EED0E7D0C5EED01)  # key of the end token
ONE = np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(32))


def word_keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(odd keys of all words of folded texts, number of words per text); each distinct word is hashed once."""
    lists = pc.split_pattern(pa.array(parts, pa.large_binary()), b" ")
    words = lists.flatten().dictionary_encode()
    names, index = words.dictionary.to_pylist(), words.indices.to_numpy()
    keys = np.array([xxhash.xxh64_intdigest(name) for name in names], dtype=np.uint64) | ONE
    real = np.array([len(name) > 0 for name in names], dtype=bool)[index]
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()])
    return keys[index[real]], counts


@dataclass
class Block:
    """Tokens of some texts: key and number of the text; the first ``context`` ones were in the block before."""

    key: np.ndarray
    doc: np.ndarray
    context: int = 0


def token_blocks(texts: Iterable[bytes], order: int = ORDER) -> Iterator[Block]:
    """Tokens of whole texts, an end after each. A text over ``BLOCK_BYTES`` is cut between words into several blocks,
    each with the last ``order - 1`` tokens before it as context."""
    parts, docs, size = [], [], 0

    def block(parts: list[bytes], docs: list[int], ended: bool, before: np.ndarray) -> Block:
        key, counts = word_keys(parts)
        doc = np.repeat(np.array(docs), counts + ended)
        if ended:
            key = np.insert(key, np.cumsum(counts), END)
        return Block(np.concatenate([before, key]), np.concatenate([np.full(len(before), docs[0]), doc]), len(before))

    nothing = np.zeros(0, dtype=np.uint64)
    for number, text in enumerate(texts):
        text = text.translate(FOLD) + b" "
        if parts and size + len(text) > BLOCK_BYTES:
            yield block(parts, docs, True, nothing)
            parts, docs, size = [], [], 0
        before = nothing
        while len(text) > 2 * BLOCK_BYTES:
            at = text.rfind(b" ", 0, BLOCK_BYTES) + 1 or text.index(b" ", BLOCK_BYTES) + 1
            made = block([text[:at]], [number], False, before)
            yield made
            before, text = made.key[max(0, len(made.key) - order + 1) :], text[at:]
        if len(before):
            yield block([text], [number], True, before)
            continue
        parts.append(text)
        docs.append(number)
        size += len(text)
    if parts:
        yield block(parts, docs, True, nothing)


def _press(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _values(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(kind).ravel()


def _press_sorted(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, "<u8"), dtype=np.uint64)


# What groups and buckets send each other: which round, the bucket, the group, arrays, and new words of a bucket.
SENT = "round int, bucket int, gid long, parts array<binary>, types long"
SENT_ARROW = pa.schema([("round", pa.int32()), ("bucket", pa.int32()), ("gid", pa.int64()), ("parts", pa.list_(pa.binary())), ("types", pa.int64())])


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(SENT_ARROW)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def _cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted keys; a bucket is a range of keys."""
    if len(keys):
        bucket = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        yield from zip(bucket[edge[:-1]].tolist(), edge[:-1], edge[1:], strict=True)


def _joined(rows: list[dict], part: int, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *[_values(row["parts"][part], kind) for row in rows]])


PACKS = ("words", "tokens", "lengths", "trained")


def group_row(key: np.ndarray, doc: np.ndarray, context: int, trained: np.ndarray) -> dict:
    """A group of tokens as stored: ``doc`` numbers texts from 0, the first ``context`` tokens belong to the group before."""
    words, index = np.unique(key, return_inverse=True)
    return {
        "context": context,
        "n": int(trained[doc][context:].sum()),
        "words": _press_sorted(words),
        "tokens": _press(index.astype("<u4")),
        "lengths": _press(np.bincount(doc).astype("<i8")),
        "trained": _press(trained.astype("u1")),
    }


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every field of its structs nullable, as the result schema has it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(field.name, _nullable(field.type)) for field in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def load_group(row: dict) -> Group:
    """A group from its range of a file."""
    fs, root = pyarrow.fs.FileSystem.from_uri(row["file"])
    with fs.open_input_file(root) as source:
        source.seek(row["at"])
        packs = {name: source.read(size) for name, size in zip(PACKS, row["sizes"], strict=True)}
    return Group({"context": row["context"], **packs})


def _groups(schema: T.StructType, path: str):
    """Map function: texts (row, train, body) as groups of tokens, written to a file of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            yield from write(batches, out, f"{path}/{name}")

    def write(batches: Iterator[pa.RecordBatch], out, file: str) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = made = at = 0
        keys, docs, rows, train, context, size = [], [], [], [], 0, 0

        def group() -> pa.RecordBatch:
            doc, given = np.concatenate(docs), pa.concat_arrays(rows)
            packed = group_row(np.concatenate(keys), doc - doc[0], context, np.concatenate(train))
            values = {"gid": part << 33 | made, "rid": part << 33 | int(doc[0]), "context": context, "n": packed["n"], "at": at}
            for name in PACKS:
                out.write(packed[name])
            arrays = [*[pa.array([value]) for value in values.values()], pa.array([file]), pa.array([[len(packed[name]) for name in PACKS]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(given)], pa.int32()), given)], names=schema.names)

        for batch in batches:
            row, trained = batch.column("row"), batch.column("train").to_numpy(zero_copy_only=False)
            row = row.cast(_nullable(row.type))
            for block in token_blocks(value.as_py() or b"" for value in batch.column("body")):
                lo, hi = int(block.doc[0]), int(block.doc[-1])
                skip = block.context if size else 0  # the group has these tokens already
                context = context if size else block.context
                if size and int(docs[-1][-1]) == base + lo:
                    lo += 1
                keys.append(block.key[skip:])
                docs.append(block.doc[skip:].astype(np.int64) + base)
                if lo <= hi:
                    rows.append(row.slice(lo, hi - lo + 1))
                    train.append(trained[lo : hi + 1])
                size += len(keys[-1])
                if size >= GROUP_TOKENS:
                    yield group()
                    at, made = out.tell(), made + 1
                    keys, docs, rows, train, context, size = [], [], [], [], 0, 0
            base += batch.num_rows
        if size:
            yield group()

    return run


class Automaton:
    """States: the root 0, words from 1, retained bigrams after them. Arcs are keyed by state * width + word; a state
    without an arc for a word is left by its failure arc, which adds its backoff weight."""

    def __init__(self, root: np.ndarray, after: np.ndarray, arcs: np.ndarray, log: np.ndarray, target: np.ndarray, back: np.ndarray, fail: np.ndarray):
        order = np.argsort(arcs)
        # A last key that no word has, so that every search ends at a key.
        self.arcs = np.concatenate([arcs[order], [np.iinfo(np.int64).max]])
        self.log, self.target = np.concatenate([log[order], [0.0]]), np.concatenate([target[order], [0]])
        self.root, self.after, self.back, self.fail = root, after, back, fail

    def walk(self, words: Sequence[int], state: int = 0, fresh: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each word, read from left to right after the state; where ``fresh`` holds a text begins
        at the root. The words are cut into strands that are walked side by side; a state is at most the last two words,
        so a strand finds the one it carries on from by walking the two words before it."""
        words, warm = np.asarray(words, dtype=np.int64), ORDER - 1
        length = max(-(-len(words) // STRANDS), warm)
        strands = -(-len(words) // length)
        place = np.arange(length + warm)[:, None] + np.arange(strands) * length
        ahead, behind = np.zeros(warm, dtype=np.int64), np.zeros(strands * length - len(words), dtype=np.int64)
        read = np.concatenate([ahead, words, behind])[place]
        begins = np.concatenate([ahead, np.zeros(len(words)) if fresh is None else fresh, behind]).astype(bool)[place]
        at, found = np.zeros(strands, dtype=np.int64), np.zeros(read.shape)
        for step, (word, new, total) in enumerate(zip(read, begins, found, strict=True)):
            if step == warm:
                at[:1] = state
            at[new] = 0
            self._step(word, at, total)
        return found[warm:].T.ravel()[: len(words)]

    def _step(self, word: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        """One word of every strand: failure arcs until a state has an arc for it or is the root."""
        width, going = len(self.root), np.arange(len(at))
        while len(going):
            state, next_ = at[going], word[going]
            if not state.all():
                ends, root = going[state == 0], next_[state == 0]
                total[ends] += self.root[root]
                at[ends] = self.after[root]
                going, next_, state = going[state > 0], next_[state > 0], state[state > 0]
            key = state * width + next_
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            ends, arc = going[hit], arc[hit]
            total[ends] += self.log[arc]
            at[ends] = self.target[arc]
            going, state = going[~hit], state[~hit]
            total[going] += self.back[state]
            at[going] = self.fail[state]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, number of each key's distinct one)."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(keys)]
    inverse = np.empty(len(keys), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], inverse


class Group:
    """Tokens of a group of texts with its distinct words and bigrams; keys of words are odd, of bigrams even."""

    def __init__(self, row: dict):
        self.context = row["context"]
        self.words, self.one = _sorted(row["words"]), _values(row["tokens"], "<u4").astype(np.int64)
        lengths = _values(row["lengths"], "<i8")
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.train = _values(row["trained"], "u1")[self.doc].astype(np.int64)
        self.train[: self.context] = 0  # counted in the group before
        w, same = self.words[self.one], self.doc[1:] == self.doc[:-1]
        at = np.flatnonzero(same) + 1
        keys = _mixed(w[at - 1] * np.uint64(0x9E3779B97F4A7C15) + w[at]) & ~ONE
        self.bigrams, first, inverse = _distinct(keys)
        self.left, self.right = self.one[at[first] - 1], self.one[at[first]]
        self.two = np.full(len(w), -1)
        self.two[at] = inverse
        self.inside = np.concatenate([[False, False], same[1:] & same[:-1]])[: len(w)]
        self.at = at
        self.merged = np.argsort(np.concatenate([self.words, self.bigrams]), kind="stable")

    def ask_counts(self, gid: int, buckets: int) -> list[tuple]:
        """First round: words and bigrams with their occurrences in training."""
        n1 = np.bincount(self.one, weights=self.train, minlength=len(self.words))
        n2 = np.bincount(self.two[self.at], weights=self.train[self.at], minlength=len(self.bigrams))
        keys, n = np.concatenate([self.words, self.bigrams])[self.merged], np.concatenate([n1, n2]).astype("<u4")[self.merged]
        return [(1, bucket, gid, [_press_sorted(keys[a:b]), _press(n[a:b])], 0) for bucket, a, b in _cuts(keys, buckets)]

    def learn_counts(self, answers: list[dict]) -> None:
        n, mine = np.zeros(len(self.merged), dtype=np.int64), np.zeros(len(self.merged), dtype=bool)
        n[self.merged], mine[self.merged] = _joined(answers, 0, "<i8"), _joined(answers, 1, "u1")
        self.n1, self.n2 = n[: len(self.words)], n[len(self.words) :]
        kept2 = (self.two >= 0) & (self.n2[self.two] > 0) if len(self.n2) else np.zeros(len(self.two), dtype=bool)
        # Trigrams after a retained bigram; those that end with a retained one may be retained themselves.
        after = np.flatnonzero(self.inside & np.concatenate([[False], kept2[:-1]]))
        at = after[kept2[after]]
        keys = _mixed(self.bigrams[self.two[at - 1]] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.one[at]])
        trigrams, first, inverse = _distinct(keys)
        order = np.argsort(self.two[at[first] - 1], kind="stable")
        self.trigrams, place = trigrams[order], at[first[order]]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.n3 = np.bincount(rank[inverse], weights=self.train[at], minlength=len(order)).astype("<u4")
        self.state3, self.word3, self.lower3 = self.two[place - 1], self.one[place], self.two[place]
        # Contexts: words that bigrams of this group are settled for or fail from, and bigrams before trigrams.
        settled = np.flatnonzero(mine[len(self.words) :] & (self.n2 > 0))
        fails = np.flatnonzero((self.two >= 0) & ~kept2)
        met1, met2 = np.zeros(len(self.words), dtype=bool), np.zeros(len(self.bigrams), dtype=bool)
        met1[self.left[settled]] = met1[self.one[fails - 1]] = met2[self.two[after - 1]] = True
        self.context1, self.context2 = np.flatnonzero(met1 & (self.n1 > 1)), np.flatnonzero(met2)
        own = np.searchsorted(self.context1, self.left[settled])
        total = lambda weights: np.bincount(own, weights=weights, minlength=len(self.context1))
        shares = np.stack([total(self.n2[settled]), total(self.n1[self.right[settled]]), total(np.ones(len(settled)))])
        self.shares = np.concatenate([shares, np.zeros((3, len(self.context2)))], axis=1).astype("<i8")
        sizes = np.bincount(np.searchsorted(self.context2, self.state3), minlength=len(self.context2))
        self.sizes = np.concatenate([np.zeros(len(self.context1)), sizes]).astype("<u4")
        self.contexts = np.concatenate([self.words[self.context1], self.bigrams[self.context2]])
        self.merged2 = np.argsort(self.contexts, kind="stable")

    def ask_contexts(self, gid: int, buckets: int, turn: int = 0, passes: int = 1) -> list[tuple]:
        """Second round: contexts with the trigrams after them (occurrences, count of the last bigram) and with shares;
        those of every ``passes``-th bucket."""
        keys, sizes, shares = self.contexts[self.merged2], self.sizes[self.merged2], self.shares[:, self.merged2]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        lower, made = self.n2[self.lower3].astype("<i8"), []
        for bucket, a, b in _cuts(keys, buckets):
            if bucket % passes != turn:
                continue
            lo, hi = ends[a], ends[b]
            parts = [self.trigrams[lo:hi], self.n3[lo:hi], lower[lo:hi], sizes[a:b], *[np.ascontiguousarray(share[a:b]) for share in shares]]
            made.append((2, bucket, gid, [_press_sorted(keys[a:b]), *map(_press, parts)], 0))
        return made

    def automaton(self, answers: list[dict], space: float) -> Automaton:
        """The part of the automaton that the texts of this group can reach."""
        n3 = _joined(answers, 0, "<i8")
        upper, lower, many = np.zeros((3, len(self.contexts)))
        for part, sums in enumerate((upper, lower, many), 1):
            sums[self.merged2] = _joined(answers, part, "<i8")
        width, k1 = len(self.words), len(self.context1)
        count = np.concatenate([self.n1[self.context1], self.n2[self.context2]])
        shorter = np.concatenate([np.full(k1, space), self.n1[self.right[self.context2]]])
        taken = np.concatenate([(lower + many)[:k1], (lower - DISCOUNT * many)[k1:]]) / shorter
        weight = np.log10((1 - (upper - DISCOUNT * many) / count) / np.maximum(1 - taken, 1e-12))
        back = np.zeros(1 + width + len(self.bigrams))
        back[1 + self.context1], back[1 + width + self.context2] = weight[:k1], weight[k1:]
        two, three = np.flatnonzero(self.n2 > 0), np.flatnonzero(n3 > 0)
        keys = np.concatenate([(1 + self.left[two]) * width + self.right[two], (1 + width + self.state3[three]) * width + self.word3[three]])
        p = np.concatenate([(self.n2[two] - DISCOUNT) / self.n1[self.left[two]], (n3[three] - DISCOUNT) / self.n2[self.state3[three]]])
        target = 1 + width + np.concatenate([two, self.lower3[three]])
        fail = np.concatenate([np.zeros(1 + width, dtype=np.int64), 1 + self.right])
        self.base = np.log10((self.n1 + 1.0) / space)
        after = np.where(self.n1 > 0, np.arange(1, width + 1), 0)
        return Automaton(self.base, after, keys, np.log10(p), target, back, fail)

    def scores(self, automaton: Automaton) -> tuple[np.ndarray, ...]:
        """(tokens, known, base, score) per text, walking each from its start or from what the group before ends with."""
        doc, texts = self.doc[self.context :], int(self.doc[-1]) + 1
        fresh = np.concatenate([[False], self.doc[1:] != self.doc[:-1]])
        score = np.bincount(doc, weights=automaton.walk(self.one, 0, fresh)[self.context :], minlength=texts)
        per = lambda values: np.bincount(doc, weights=values[self.one[self.context :]], minlength=texts)
        return np.bincount(doc, minlength=texts), per(self.n1 > 0).astype(np.int64), per(self.base), score


def _summed(key: np.ndarray, count: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether each in order is the first of its key, total per key, number of each one's key in order)."""
    order = np.argsort(key, kind=kind)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    total = np.add.reduceat(count[order], np.flatnonzero(new)) if len(key) else count
    return order, new, total, np.cumsum(new) - 1


def count_grams(least: int):
    """Group function of a bucket: the counts of the words and bigrams of each group, and which of them it settles."""

    def run(table_: pa.Table) -> pa.Table:
        rows = table_.to_pylist()
        keys = [_sorted(row["parts"][0]) for row in rows]
        key = np.concatenate(keys)
        order, new, n, index = _summed(key, _joined(rows, 1, "<u4").astype("<i8"), "stable")  # sorted runs
        odd = key[order][new] & ONE == ONE
        n[~odd & (n < least)] = 0
        types = int((odd & (n > 0)).sum())
        answer, mine = np.empty(len(key), dtype="<i8"), np.empty(len(key), dtype="u1")
        answer[order], mine[order] = n[index], new
        ends = np.cumsum([len(own) for own in keys]).tolist()
        starts = [0, *ends[:-1]]
        return _sent([(1, row["bucket"], row["gid"], [_press(answer[a:b]), _press(mine[a:b])], types * (k == 0)) for k, (row, a, b) in enumerate(zip(rows, starts, ends, strict=True))])

    return run


def sum_contexts(least: int):
    """Group function of a bucket of contexts: the counts of their trigrams and, per context, over what is retained after
    it, the sum of counts, the sum of counts after the next shorter context, and how many."""

    def run(table_: pa.Table) -> pa.Table:
        rows = table_.to_pylist()
        keys = [_sorted(row["parts"][0]) for row in rows]
        known, _, context = _distinct(np.concatenate(keys))
        trigrams = _joined(rows, 1, "<u8")
        order, new, n, index = _summed(trigrams, _joined(rows, 2, "<u4").astype("<i8"))
        n[n < least] = 0
        own = np.repeat(context, _joined(rows, 4, "<u4"))[order][new]
        total = lambda where, weights: np.bincount(where, weights=weights, minlength=len(known))
        after = (n, np.where(n > 0, _joined(rows, 3, "<i8")[order][new], 0), n > 0)
        sums = [(total(own, values) + total(context, _joined(rows, 5 + k, "<i8"))).astype("<i8")[context] for k, values in enumerate(after)]
        answer = np.empty(len(trigrams), dtype="<i8")
        answer[order] = n[index]
        made, at, to = [], 0, 0
        for row, mine in zip(rows, keys, strict=True):
            size = int(_values(row["parts"][4], "<u4").sum())
            made.append((2, row["bucket"], row["gid"], [_press(answer[to : to + size]), *[_press(values[at : at + len(mine)]) for values in sums]], 0))
            at, to = at + len(mine), to + size
        return _sent(made)

    return run


def _answers(table_: pa.Table, number: int) -> list[dict]:
    return sorted((row for row in table_.to_pylist() if row["round"] == number), key=lambda row: row["bucket"])


def _settled(df: DataFrame, label: str) -> DataFrame:
    """The staged frame; the shuffle files that made it are deleted when it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stage(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body")


def score_corpus(docs: DataFrame, train: Column, text: str = "text", keep: Sequence[str] = ("doc_id",), *, least: int = LEAST) -> tuple[DataFrame, int]:
    """(``keep`` columns as ``row`` with n_tokens, n_known, base_score and score of every row, tokens of training).

    The automaton is trained on the rows where ``train`` holds, with all n-grams that occur ``least`` (two or more) times
    in them.
    """
    spark = docs.sparkSession
    given = docs.select(F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), _body(text))
    kept = json.loads(given.schema["row"].dataType.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true'))
    kept = T.StructType.fromJson(kept)
    numbers = [T.StructField(name, T.LongType()) for name in ("gid", "rid", "context", "n", "at")]
    places = [T.StructField("file", T.StringType()), T.StructField("sizes", T.ArrayType(T.LongType()))]
    schema = T.StructType([*numbers, *places, T.StructField("rows", T.ArrayType(kept))])
    groups = stage(given.mapInArrow(_groups(schema, scratch_path(spark, "tokens")), schema), "groups")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GRAM_BUCKET_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from _sent(load_group(row).ask_counts(row["gid"], buckets)).to_batches()

    slim = groups.drop("rows", "rid", "n")
    counts = _settled(slim.repartition(buckets, "gid").mapInArrow(ask, SENT).groupBy("bucket").applyInArrow(count_grams(least), SENT), "counts")
    tokens = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    types = counts.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("n")).first()["n"]
    space = float(tokens + types + 1)

    def ask_again(turn: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            group = load_group(row)
            group.learn_counts(_answers(right, 1))
            return _sent(group.ask_contexts(row["gid"], buckets, turn, PASSES))

        return run

    answers = counts
    for turn in range(PASSES):
        asked = slim.groupBy("gid").cogroup(counts.groupBy("gid")).applyInArrow(ask_again(turn), SENT)
        answers = answers.unionByName(_settled(asked.groupBy("bucket").applyInArrow(sum_contexts(least), SENT), "sums"))

    measures = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())]
    result = T.StructType([T.StructField("rid", T.LongType()), T.StructField("row", kept), *[T.StructField(*measure) for measure in measures]])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["rows"]).to_pylist()[0]
        group = load_group(row)
        group.learn_counts(_answers(right, 1))
        found = group.scores(group.automaton(_answers(right, 2), space))
        rows = left["rows"].combine_chunks().flatten()
        return pa.table([pa.array(np.arange(len(rows)) + row["rid"]), rows, *[pa.array(values) for values in found]], names=result.names)

    scored = groups.drop("n").groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(score, result)
    # A long text has a row in each of its groups.
    whole = scored.groupBy("rid").agg(
        F.first("row").alias("row"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return whole.drop("rid"), tokens


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@query("op5_backoff_automaton")
def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the automaton trained on the documents that are not held out."""
    scored, tokens = score_corpus(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
