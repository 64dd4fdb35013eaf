"""Language-model scores by logistic context mixing.

The model codes a text as its tokens, lower-cased words (runs of [^\\x20\\x09-\\x0D]) and an end. Bit predictors with
hashed contexts say for each token by which of three ways it comes, each a binary decision that the next way follows
if it is not taken:

1. From the words that followed the two words before it, in other training texts, each by how often it did. Whether that
   is so is predicted from how often the two words came at all and from how many tokens in a row were found so just before; both
   predictions are mixed in the logistic domain with learnt weights, and an adaptive map of the two gates refines the mix.
2. From the words of training texts of the text's kind, and then of all, by their counts less a discount.
3. Byte by byte, each byte as eight binary decisions, any word, whether training texts have it or not. For each of them four predictors give a probability
   from tables that are hashed by context: the last two bytes with the text's kind, the last four (or three, of a word's first four), all of the word so far,
   and that with the kind. Their logits are added with weights from a set that is chosen by the gate: how much the two
   longest contexts have been seen, and which bit it is. Tables count every occurrence of every training word, and
   so do the decisions that weights are learnt from: equal words are gone through once, with their number. The weights are learnt online, by Newton steps batch after
   batch of decisions, with each word itself taken out of the counts (of words that share a decision, the mean); each slice of the dictionary learns
   its own, and their mean, by the decisions that each gate saw, is the one set that all words are coded with. At last an adaptive
   map, by gate and probability, whose counts are summed over all slices, refines what the mixer says.

Within a text, words that have come become likelier: ways 2 and 3 are the start of an urn to which each word that comes is
added; urns of several sizes run side by side, and the text's probability is their mean. Bits sum up to total bits, and
divide by bytes to bits per byte. A word's probability is the sum over all ways by which it can come, so
the bit mixer has a part in every token's: what counts leave to it, which is much where most words are rare, and little of a frequent word's.
For a fixed training set all ways together are a distribution over texts: they leave each other what they
don't take, and the model is the same for all words and any number of slices. Values are sent in steps of 1/512 of a power of ten. A training text is scored
without its own pairs and triples but with its own words in the counts, so its score is a little better than a new text's would be.

A text's kind is the likeliest of KINDS distributions over the marks of the whole text; it is coded first, at its own
probability. Marks are the words of at most SHORT bytes, by hash; those tell languages and
manners apart. The distributions come from a mixture model fitted by EM to the marks of all training texts. Sums of a
round are whole numbers of a small unit, so they don't depend on the order in which tasks end.

What is counted grows with the corpus: words, pairs and triples of words are keyed by 64-bit hashes and
counted exactly, over all training texts, in slices of the keys; the number of slices, without a limit, and the bits of a key that are sent, grow with the number of tokens. A text's own pairs and
triples are taken out of the counts for it. Only the tables of way 3 have a fixed size.

How it is spread: each task reads whole texts and gives their words numbers in a dictionary of its own block of texts; a
block is kept as numbers. From blocks the dictionary goes out by slices, and the distinct pairs and triples, each once with its count. So a slice
gets a key at most once from a block, however often it comes, and no key is hot. Sums go back to the blocks the same way, and there to texts.

Null and empty texts are one token, the end. Null ids are training rows. Repeated rows count as often as
they come, and are each other's "other texts". Other columns are ignored. Without training texts the model is uniform over bits. An empty
table gives an empty result. Very long texts: a task holds some hundred bytes for each token of a block, which has BLOCK tokens
or one longer text; words longer than PIECE bytes are spelled in pieces of that size.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc32_mod, trim
from .shingles import U, _power, mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"  # no word holds one
BITS = (20, 20, 20, 21)
ORDERS = len(BITS)
PARTS = 64
LEVELS = 8
GATES = LEVELS * 4 * 8
BUCKETS = 24
PRIOR = 0.2
#: Sizes of the urns that adapt to a text; without limit is the model itself.
URNS = (3000, 300, 30)
#: How much the mixer holds on to the weights it starts with.
STIFF = 1000.0
#: Kinds of texts; places of marks; bytes of a mark at most.
KINDS, MARKS, SHORT = 5, 512, 4
#: Tokens of a block; bytes of a word that are spelled at once; tokens for which there is a slice.
BLOCK, PIECE, SLICE = 1 << 21, 4096, 1 << 22
#: Gates of way 1: how often the two words came, and how many tokens in a row were found.
SEEN, STREAKS = 8, 8
#: A posterior's unit in EM, and texts of a row: sums over a row are whole numbers below 2 ** 24.
UNIT, ROW = 2.0**-10, 4096


def pack(*parts) -> bytes:
    return zstandard.compress(pickle.dumps(parts, 5), 1)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as their first bytes, then all second ones, and so on: high bytes are mostly zero."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    words.append(END)
    return words


def _training():
    return F.coalesce(crc32_mod("doc_id", 7) != 2, F.lit(True))


class _Marks(dict):
    """Places of short words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word) % MARKS
        return n


    def of(self, words: list[bytes]) -> list[int]:
        return [self[w] for w in {w for w in words if len(w) <= SHORT}]


def marks(docs: DataFrame, most: int = ROW) -> DataFrame:
    """tokens of all texts, and packed, of all training texts, which marks they have; rows hold many texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, n = _Marks(), [], 0

        def row() -> pa.RecordBatch:
            nonlocal n
            bits = np.zeros((len(held), MARKS), np.uint8)
            for k, x in enumerate(held):
                bits[k, x] = 1
            out = pa.RecordBatch.from_arrays([pa.array([n]), pa.array([pack(np.packbits(bits, axis=1))], pa.binary())], names=["tokens", "bits"])
            held.clear()
            n = 0
            return out

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens_of(text)
                n += len(words)
                if train:
                    held.append(places.of(words))
                    if len(held) == most:
                        yield row()
        if n:
            yield row()

    return docs.select("text", _training().alias("train")).mapInArrow(task, "tokens long, bits binary")


def _any_kinds(bits: np.ndarray, columns: int) -> np.ndarray:
    """What EM starts with: shares of kinds drawn by a text's marks, few of them large."""
    h = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in bits], U)
    u = (mix(h[:, None] + np.arange(1, columns + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(11)).astype(float) / (1 << 53)
    return u ** (1 / 0.3) + 1e-9


def learn_kinds(table: DataFrame, rounds: int = 12, seeds: int = 2, settled: float = 3e-4) -> np.ndarray:
    """log probabilities (MARKS + 1, KINDS) of a mixture of distributions over marks, fitted by EM to the marks of
    texts; the last row has the kinds' own. All starts go side by side, until no likelihood grows by more than a share of `settled`."""
    spark, wide = table.sparkSession, KINDS * seeds
    logs = last = None

    def sums(sent, first: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, likely, logs = np.zeros((MARKS + 1, wide)), np.zeros(wide), None if first else sent.value
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    (packed,) = unpack(blob)
                    if not len(packed):
                        continue
                    x = np.unpackbits(packed, axis=1).astype(np.float32)
                    if first:
                        post = _any_kinds(packed, wide).reshape(-1, seeds, KINDS)
                        norm = np.zeros((len(x), seeds, 1))
                    else:
                        z = (x @ logs[:-1] + logs[-1]).astype(float).reshape(-1, seeds, KINDS)
                        norm = z.max(2, keepdims=True)
                        post = np.exp(z - norm)
                        norm = norm + np.log(post.sum(2, keepdims=True))
                    post = np.rint((post / post.sum(2, keepdims=True)).reshape(-1, wide) / UNIT).astype(np.float32)
                    total[:-1] += x.T @ post
                    total[-1] += post.sum(0, dtype=float)
                    likely += np.repeat(np.rint(norm[:, :, 0] * 1024).sum(0), KINDS)
            for k in range(wide):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.append(total[:, k], likely[k]).tobytes()], pa.binary())], names=["k", "data"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out[k] = out.get(k, 0) + np.frombuffer(data)
            for k, x in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["k", "data"])

        return table.select("bits").mapInArrow(task, "k long, data binary").repartition(wide, "k").mapInArrow(merge, "k long, data binary")

    for n in range(rounds + 1):
        sent = spark.sparkContext.broadcast(None if logs is None else logs.astype(np.float32))
        got = sorted((r["k"], np.frombuffer(r["data"])) for r in sums(sent, n == 0).collect())  # wide rows of 4 KB
        sent.destroy()
        if not any(x[MARKS] > 0 for _, x in got):  # no texts
            return np.zeros((MARKS + 1, KINDS))
        result = np.stack([x for _, x in got], 1)
        likely, own, words = result[-1].reshape(seeds, KINDS)[:, 0], result[MARKS].reshape(seeds, KINDS) * UNIT, result[:MARKS] * UNIT + 0.05
        if n > 1 and np.all(likely - last <= settled * np.abs(last)):
            break
        if n < rounds:
            last = likely
            logs = np.vstack([np.log(words / words.sum(0)), np.log((own + 1) / (own.sum(1, keepdims=True) + KINDS)).reshape(1, -1)])
    return logs.reshape(MARKS + 1, seeds, KINDS)[:, int(likely.argmax())]


def kind_of(words: list[bytes], logs: np.ndarray, places: _Marks) -> int:
    """The likeliest kind; of equal ones the first."""
    return int((logs[-1] + logs[sorted(places.of(words))].sum(0)).argmax())


def _numbers() -> list[defaultdict]:
    """For each kind the numbers of its words, in order of coming."""
    return [defaultdict(itertools.count().__next__) for _ in range(KINDS)]


class Scale:
    """Slices and bits of keys for so many tokens."""

    def __init__(self, tokens: int):
        self.slice_bits = (tokens // SLICE).bit_length()
        self.key_bits = min(64, 14 + max(tokens, 1).bit_length())  # a key that never came is taken for one that did with a chance below 2 ** -14

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.slice_bits)).astype(np.int64) if self.slice_bits else np.zeros(len(h), np.int64)


def _slices(at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of slices in order: which, and from where to where."""
    which, first = np.unique(at, return_index=True)
    return zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(at)])


def _hashes(names: list[bytes]) -> np.ndarray:
    """Of words without their kind."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w[1:]) for w in names), U, len(names))


def word_keys(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the key of the two tokens before it (of the same text), and that with the token."""
    one, two = np.roll(h, 1), np.roll(h, 2)
    one[starts] = two[starts] = U(1)
    after = starts + 1
    two[after[after < len(h)]] = U(1)
    pair = mix(one * U(0xA0761D6478BD642F) + mix(two + U(0x9E3779B97F4A7C15)))
    return pair, mix(pair ^ (h * U(0xE7037ED1A0B428DB)))


class Groups:
    """Tokens by key: the distinct keys in order, and how often each comes in the block's training texts."""

    def __init__(self, key: np.ndarray, of: np.ndarray, train: np.ndarray):
        self.order, self.of, self.train = np.argsort(key), of, train
        ordered = key[self.order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(first, len(key)))
        self.keys = ordered[first]
        self.count = np.add.reduceat(train[self.order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def others(self, elsewhere: np.ndarray) -> np.ndarray:
        """Of each token how often its key comes in training texts but its own. elsewhere: keys in other blocks."""
        order = self.order
        own = self.train[order].astype(np.int64)
        many = np.flatnonzero(np.repeat(self.size > 1, self.size))
        if len(many):  # of a key's tokens those of one text belong together
            run = np.repeat(np.arange(len(self.size)), self.size)[many]
            both = run * (int(self.of[-1]) + 1) + self.of[order[many]]
            by = np.argsort(both)
            ordered = both[by]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            n = np.diff(np.append(first, len(by)))
            own[many[by]] *= np.repeat(n, n)
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(elsewhere + self.count, self.size) - own
        return out


BLOCKS = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("names", pa.binary())])
SENT = pa.schema([("what", pa.string()), ("block", pa.int64()), ("slice", pa.int64()), ("data", pa.binary())])
SENT_SQL = "what string, block long, slice long, data binary"


def _sent(what: str, block: int, at: int, *parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([what]), pa.array([block]), pa.array([at]), pa.array([pack(*parts)], pa.binary())], schema=SENT)


def _blocked(docs: DataFrame, logs: np.ndarray, most: int) -> DataFrame:
    """Blocks of texts: (ids, are they training texts, bytes, kinds, numbers of tokens, tokens as numbers of words), and (words, their counts in training texts)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        numbers, held, n, places = _numbers(), [], 0, _Marks()

        def block() -> pa.RecordBatch:
            ids, train, size, kinds, lids = zip(*held)
            lengths, lid = np.array([len(x) for x in lids]), np.concatenate(lids)
            lid += np.repeat((np.cumsum([0] + [len(d) for d in numbers])[:-1])[list(kinds)], lengths).astype(np.int32)
            names = [bytes([k]) + w for k, d in enumerate(numbers) for w in d]
            counts = np.bincount(lid, np.repeat(np.array(train), lengths), len(names)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([part << 20 | seq]), pa.array([pack(ids, np.array(train), np.array(size), np.array(kinds, np.int8), lengths, lid)], pa.binary()), pa.array([pack(b" ".join(names), counts)], pa.binary())], schema=BLOCKS)

        for batch in batches:
            for doc, train, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = tokens_of(text)
                if held and n + len(words) > most:
                    yield block()
                    numbers, held, n, seq = _numbers(), [], 0, seq + 1
                kind = kind_of(words, logs, places)
                held.append((doc, train, len((text or "").encode("utf-8", "surrogatepass")), kind, np.fromiter(map(numbers[kind].__getitem__, words), np.int32, len(words))))
                n += len(words)
        if held:
            yield block()
        numbers, held = [], []
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _training().alias("train"), "text").mapInArrow(task, "block long, texts binary, names binary")


def _dictionaries(blocks: DataFrame, scale: Scale) -> DataFrame:
    """Of each block its words by slices: (numbers, counts, words)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*(batch.column(k).to_pylist() for k in range(2))):
                joined, counts = unpack(blob)
                names = joined.split(b" ")
                at = scale.slice_of(_hashes(names))
                order = np.argsort(at, kind="stable")
                for k, a, z in _slices(at[order]):
                    some = order[a:z]
                    yield _sent("words", block, k, some.astype(np.int32), counts[some], b" ".join([names[i] for i in some.tolist()]))
        trim()

    return blocks.select("block", "names").mapInArrow(task, SENT_SQL)


def _groups(texts: bytes, names: bytes) -> Iterator[tuple[str, Groups]]:
    """Pairs and triples of a block."""
    _, train, _, _, lengths, lid = unpack(texts)
    h = _hashes(unpack(names)[0].split(b" "))
    of, tr = np.repeat(np.arange(len(lengths)), lengths), np.repeat(train, lengths)
    for what, key in zip(("pairs", "triples"), word_keys(h[lid], np.cumsum(lengths) - lengths)):
        yield what, Groups(key, of, tr)


def _keys(blocks: DataFrame, scale: Scale) -> DataFrame:
    """Of each block its distinct pairs and triples by slices: (keys, counts)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, names in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for what, g in _groups(texts, names):
                    short = g.keys >> U(64 - scale.key_bits)
                    for k, a, z in _slices(scale.slice_of(g.keys)):
                        yield _sent(what, block, k, planes(np.diff(short[a:z], prepend=U(0))), planes(g.count[a:z]))
        trim()

    return blocks.select("block", "texts", "names").mapInArrow(task, SENT_SQL)


def _elsewhere(keys: DataFrame) -> DataFrame:
    """Of each key how often it comes in training texts of other blocks: rows (what, block, slice, data)."""

    def one(t: pa.Table) -> pa.Table:
        blocks, blobs = t.column("block").to_numpy(), [unpack(x) for x in t.column("data").to_pylist()]
        keys = [np.cumsum(from_planes(k)) for k, _ in blobs]
        counts = [from_planes(c).astype(np.int64) for _, c in blobs]
        edges = np.cumsum([0] + [len(k) for k in keys])
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], first), np.diff(np.append(first, len(key))))
        total -= count
        out = [zstandard.compress(planes(total[a:z]), 1) for a, z in zip(edges[:-1], edges[1:])]
        return pa.table({"what": t.column("what"), "block": blocks, "slice": t.column("slice"), "data": pa.array(out, pa.binary())})

    return keys.groupBy("what", "slice").applyInArrow(one, SENT_SQL)


def _merged(words: DataFrame) -> DataFrame:
    """Dictionaries of a slice: distinct words with their counts, and where each block's are; sums for the whole."""

    def one(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("block").to_numpy())
        blocks = t.column("block").to_numpy()[order]
        data = t.column("data").to_pylist()
        parts = [unpack(data[i]) for i in order]
        names = [w for _, _, joined in parts for w in joined.split(b" ")]
        counts = np.concatenate([c for _, c, _ in parts]).astype(np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), U, len(names))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        distinct = [names[i] for i in first]
        by_name = sorted(range(len(distinct)), key=distinct.__getitem__)
        rank = np.empty(len(distinct), np.int64)
        rank[by_name] = np.arange(len(distinct))
        distinct, inverse = [distinct[i] for i in by_name], rank[inverse]
        c = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        _, bare = np.unique(_hashes(distinct), return_inverse=True)
        base = np.bincount(bare, c).astype(np.int64)
        kind = np.array([w[0] for w in distinct])
        sums = np.zeros((KINDS + 1, 4), np.int64)  # tokens, words, words seen once, twice: of each kind, and of all
        for k, (x, of) in enumerate([(c, kind == k) for k in range(KINDS)] + [(base, slice(None))]):
            sums[k] = x[of].sum(), (x[of] > 0).sum(), (x[of] == 1).sum(), (x[of] == 2).sum()
        edges = np.cumsum([0] + [len(x) for x, _, _ in parts])
        back = [(int(b), lid, inverse[a:z].astype(np.int32)) for b, (lid, _, _), a, z in zip(blocks, parts, edges[:-1], edges[1:])]
        return pa.table({"slice": t.column("slice")[:1], "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), "words": pa.array([pack(b" ".join(distinct), c, base[bare])], pa.binary()), "back": pa.array([pack(back)], pa.binary())})

    return words.groupBy("slice").applyInArrow(one, "slice long, sums array<long>, words binary, back binary")


class Events:
    """The byte decisions of distinct beginnings in order, those of a shared beginning once. Each row is a byte for the
    kind, which isn't coded, and the bytes."""

    def __init__(self, full: list[bytes]):
        size = np.array([len(w) for w in full])
        width = int(size.max())
        m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in full), np.uint8).reshape(len(full), width)
        inside = np.arange(width) < size[:, None]
        same = np.logical_and.accumulate((m[1:] == m[:-1]) & inside[:-1], axis=1)
        fresh = inside.copy()
        fresh[1:] &= ~same
        owner = np.maximum.accumulate(np.where(fresh, np.arange(len(full), dtype=np.int32)[:, None], 0), axis=0)
        fresh[:, 0] = inside[:, 0] = False
        at = np.cumsum(fresh.ravel()).reshape(fresh.shape) - 1
        self.cells = at[owner, np.arange(width)][inside]  # of each byte of each row its event
        self.word = np.repeat(np.arange(len(full)), size - 1)
        self.n_words = len(full)
        row, col = np.nonzero(fresh)
        self.byte = m[row, col].astype(np.int64)
        kind = m[row, 0].astype(U)
        back = np.concatenate([np.zeros((len(full), 3), np.uint8), m], axis=1)
        back[:, 3] = 0
        last = [back[row, col + 3 - k].astype(U) for k in range(1, 4)]
        last.append(np.where(col > 4, back[row, np.maximum(col - 1, 0)], 0).astype(U))
        p, _ = _power(width + 1)
        prefix = np.concatenate([np.zeros((len(full), 1), U), np.cumsum((m.astype(U) + U(1)) * p[:width] * (np.arange(width) > 0).astype(U), axis=1)], axis=1)[row, col]
        prefix = prefix + col.astype(U) * U(0x9E3779B97F4A7C15)
        two = last[0] | last[1] << U(8)
        three = two | last[2] << U(16)
        self.contexts = [mix(two + (kind << U(32)) + U(1 << 40)), mix(three + (last[3] << U(24)) + U(3 << 40)), mix(prefix + U(4 << 40)), mix(prefix + (kind + U(1)) * U(0xA0761D6478BD642F))]
        self.weight = np.bincount(self.cells, minlength=len(row))

    def bits(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """For each bit its place, the slot of each context and the bit."""
        node = np.ones(len(self.byte), np.int64)
        for k in range(8):
            y = self.byte >> (7 - k) & 1
            n = node.astype(U) * U(0x9E3779B97F4A7C15)
            slots = []
            for j, c in enumerate(self.contexts):
                s = ((c ^ n) * U(0xD6E8FEB86659FD93)) >> U(64 - BITS[j])
                slots.append(s.view(np.int64))
            yield k, slots, y
            node = node << 1 | y

    def times(self, of_word: np.ndarray) -> np.ndarray:
        """How often each event comes, if the words come so many times."""
        return np.bincount(self.cells, of_word[self.word], len(self.byte)).astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each word the sum of its events' values."""
        return np.bincount(self.word, values[self.cells], self.n_words)


def spelled(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Rows for Events, a row for each piece of a word, and of which word it is; words end in a blank."""
    if all(len(w) <= PIECE for w in words):
        return [w if w[1:] == END else w + b" " for w in words], np.arange(len(words))
    rows, of = [], []
    for k, w in enumerate(words):
        full = w if w[1:] == END else w + b" "
        for a in range(1, len(full), PIECE):
            rows.append(full[:1] + full[a : a + PIECE])
            of.append(k)
    return rows, np.array(of)


def training_rows(joined: bytes, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Rows for Events of the words of a dictionary that training texts have, and how often each comes there."""
    known = np.flatnonzero(counts)
    words = joined.split(b" ")
    rows, of = spelled([words[i] for i in known.tolist()])
    return rows, counts[known].astype(np.int64)[of]


def _batches(rows: list[bytes], most_cells: int = 200_000, first: int = 0) -> Iterator[np.ndarray]:
    """Places of rows, in batches in order whose rows differ little in length; the first so many are smaller."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    kind = np.where(size > 15, np.frexp(size)[1], 0)  # bits of the length
    n = 0
    for k in np.unique(kind):
        ids = np.flatnonzero(kind == k)
        if k:  # short rows are words as they were sorted; of longer ones there may be pieces
            ids = np.array(sorted(ids.tolist(), key=rows.__getitem__))
        width, a = int(size[ids].max()) + 1, 0
        while a < len(ids):
            step = max(1, (most_cells // 20 if n < first else most_cells) // width)
            yield ids[a : a + step]
            a, n = a + step, n + 1


def _counted(merged: DataFrame) -> DataFrame:
    """(part, data): counts of zeros and ones of all tables, cut into parts, merged. Every training word counts as often as it comes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                joined, c, _ = unpack(blob)
                if tables is None:
                    tables = [np.zeros(2 << b, np.int64) for b in BITS]
                rows, times = training_rows(joined, c)
                for some in _batches(rows):
                    e = Events([rows[i] for i in some])
                    weight = e.times(times[some])
                    for _, slots, y in e.bits():
                        for j, s in enumerate(slots):
                            np.add.at(tables[j], 2 * s + y, weight)
        if tables is not None:
            for k, part in enumerate(np.array_split(np.concatenate(tables), PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["part", "data"])
        tables = None
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(data), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zstandard.compress(part.astype(np.float32).tobytes(), 1)], pa.binary())], names=["part", "data"])

    return merged.select("words").mapInArrow(task, "part long, data binary").repartition(PARTS, "part").mapInArrow(merge, "part long, data binary")


class Tables:
    """Counts, unpacked once a worker."""

    def __init__(self, parts: list[bytes]):
        flat = np.concatenate([np.frombuffer(zstandard.decompress(s), np.float32) for s in parts]) if parts else np.zeros(2 * sum(1 << b for b in BITS), np.float32)
        self.counts, at = [], 0
        for b in BITS:
            self.counts.append(flat[at : at + (2 << b)].reshape(-1, 2))
            at += 2 << b

    def ready(self) -> Tables:
        self.logit = [np.log((c[:, 1] + PRIOR) / (c[:, 0] + PRIOR)).astype(np.float32) for c in self.counts]
        self.seen = [_seen(c.sum(1)) for c in self.counts[-2:]]
        return self


def _seen(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1), LEVELS - 1).astype(np.int8)


def gate(four: np.ndarray, prefix: np.ndarray, bit: int) -> np.ndarray:
    return (prefix.astype(np.int64) * 4 + (four.astype(np.int64) // 3).clip(0, 3)) * 8 + bit


def _start() -> np.ndarray:
    return np.full((GATES, ORDERS), 1.4 / ORDERS)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -18, 18)))


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((np.clip(x, -11.9, 11.9) + 12) * (BUCKETS / 24)).astype(np.int64)


def learn_slice(tables: Tables, rows: list[bytes], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by gate, (ones, all) of the adaptive map by prefix gate and probability, and how many decisions each gate
    saw, from training words, which come so many times, or once each."""
    w, apm, told = _start(), np.zeros((LEVELS, BUCKETS, 2)), np.zeros(GATES)
    curve = np.tile(np.eye(ORDERS) * STIFF, (GATES, 1, 1))  # what the decisions so far say of the loss around w
    pairs = [np.ascontiguousarray(c).view(np.float64).ravel() for c in tables.counts]
    for some in _batches(rows, 600_000, first=24):
        e = Events([rows[i] for i in some])
        own = (e.weight if times is None else e.times(times[some])).astype(np.float32)
        taught = own / e.weight.astype(np.float32)  # by a word, in the mean of those that share the decision
        for k, slots, y in e.bits():
            one = y.astype(np.float32)
            x = np.empty((ORDERS, len(y)), np.float32)
            seen = []
            for j, s in enumerate(slots):
                c = pairs[j][s].view(np.float32).reshape(-1, 2)
                ones = np.maximum(c[:, 1] - taught * one, 0)  # not what the word itself has taught
                zeros = np.maximum(c[:, 0] - taught * (1 - one), 0)
                x[j] = np.log((ones + PRIOR) / (zeros + PRIOR))
                if j >= ORDERS - 2:
                    seen.append(_seen(ones + zeros))
            g = gate(seen[0], seen[1], k)
            order = np.argsort((g >> 3).astype(np.uint8), kind="stable")
            edges = np.searchsorted(g[order] >> 3, np.arange(GATES // 8 + 1))
            x, one, own_, g_ = x[:, order], one[order], own[order], g[order]
            for at in np.flatnonzero(np.diff(edges)):
                a, z = edges[at], edges[at + 1]
                part, h = x[:, a:z], int(g_[a])
                dot = w[h] @ part
                p = _squash(dot)
                curve[h] = 0.999 * curve[h] + (part * (own_[a:z] * np.maximum(p * (1 - p), 0.01))) @ part.T
                w[h] += np.clip(np.linalg.solve(curve[h], part @ ((one[a:z] - p) * own_[a:z])), -0.1, 0.1)
                told[h] += own_[a:z].sum(dtype=float)
                at_ = _bucket(dot)
                apm[h >> 5, :, 0] += np.bincount(at_, own_[a:z] * one[a:z], BUCKETS)
                apm[h >> 5, :, 1] += np.bincount(at_, own_[a:z], BUCKETS)
    return w, apm, told


def learn_mixer(tables: Tables, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map of training words that are one slice."""
    return joined_mixer(mixer_sums(*learn_slice(tables, rows)))


#: Weights are summed as whole numbers of this unit, so the sum doesn't depend on the order in which tasks end.
STEP = 2.0**-20
CELLS = GATES * (ORDERS + 1) + LEVELS * BUCKETS * 2


def mixer_sums(w: np.ndarray, apm: np.ndarray, told: np.ndarray) -> np.ndarray:
    """What is added over slices: each gate's weights times its decisions, its decisions, and the map's counts."""
    told = told.astype(np.int64)
    return np.concatenate([(np.rint(w / STEP).astype(np.int64) * told[:, None]).ravel(), told, np.rint(apm).astype(np.int64).ravel()])


def joined_mixer(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map from sums over slices; a gate that saw nothing keeps the weights at the start."""
    w, told, apm = np.split(np.asarray(total, float), [GATES * ORDERS, GATES * (ORDERS + 1)])
    w = np.where(told[:, None] > 0, w.reshape(GATES, ORDERS) * STEP / np.maximum(told, 1)[:, None], _start())
    return w, apm.reshape(LEVELS, BUCKETS, 2)


class Model:
    def __init__(self, tables: Tables, weights: np.ndarray, apm: np.ndarray):
        self.tables, self.weights = tables if hasattr(tables, "logit") else tables.ready(), weights.astype(np.float32)
        mid = _squash(np.arange(BUCKETS) * (24 / BUCKETS) - 12 + 12 / BUCKETS)
        self.apm = np.clip((apm[:, :, 0] + 50 * mid) / (apm[:, :, 1] + 50), 1e-6, 1 - 1e-6).astype(np.float32)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word (a byte for its kind before it) the log10 of its probability."""
        rows, of = spelled(words)
        values = np.zeros(len(rows))
        for some in _batches(rows):
            e = Events([rows[i] for i in some])
            total = np.zeros(len(e.byte))
            t = self.tables
            for k, slots, y in e.bits():
                prefix = t.seen[1][slots[-1]]
                w = self.weights[gate(t.seen[0][slots[-2]], prefix, k)]
                dot = w[:, 0] * t.logit[0][slots[0]]
                for j in range(1, ORDERS):
                    dot += w[:, j] * t.logit[j][slots[j]]
                p = 0.5 * _squash(dot) + 0.5 * self.apm[prefix, _bucket(dot)]
                total += np.log10(np.where(y, p, 1 - p))
            values[some] = e.sums(total)
        return np.bincount(of, values, len(words))


_models: dict[str, object] = {}


def _once(key: str, make):
    """One model a worker: the last."""
    if key not in _models:
        _models.clear()
        _models[key] = make()
    return _models[key]


def discounted(sums: np.ndarray) -> list[tuple[float, float, float]]:
    """(discount, its share of all, tokens) of each kind's words, and of all: what counts lose to words not seen."""
    out = []
    for tokens, words, once, twice in sums.tolist():
        d = min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.5
        out.append((d, d * words / tokens if tokens else 1.0, max(tokens, 1)))
    return out


def by_counts(kind: np.ndarray, c: np.ndarray, base: np.ndarray, spelled: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """log10 of words' probabilities by ways 2 and 3: counts of the kind, of all, and the spelling (log10), each with
    what the one before it leaves."""
    d = discounted(sums)
    lost, left, total = (np.array([x[k] for x in d]) for k in range(3))
    with np.errstate(divide="ignore"):
        p = np.logaddexp2(np.log2(np.maximum(base - lost[-1], 0) / total[-1]), np.log2(left[-1]) + spelled * math.log2(10))
        p = np.logaddexp2(np.log2(np.maximum(c - lost[kind], 0) / total[kind]), np.log2(left[kind]) + p)
    return p * math.log10(2)


def codes(pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, from how often the two words before it come in other training texts, and those with it: 0 or 1 and
    the former's logarithm, below SEEN; and the share that follows so, in sixteenths of a bit (255: none, or below 2 ** -15.8)."""
    seen = np.where(pair > 0, np.minimum(SEEN - 1, 1 + np.log2(np.maximum(pair, 1)).astype(np.int64)), 0)
    share = np.full(len(pair), 255, np.uint8)
    some = np.flatnonzero((triple > 0) & (pair > 0))
    share[some] = np.clip(np.ceil(-16 * np.log2(triple[some] / pair[some]) - 1e-9), 0, 255)
    return seen.astype(np.uint8), share


def streaks(seen: np.ndarray, share: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Before each token of a text, how many in a row were found; the number's length in bits, below STREAKS."""
    at = np.arange(len(seen))
    miss = (seen == 0) | (share == 255)
    last = np.where(miss, at + 1, 0)  # the first place after a miss
    last[starts] = np.maximum(last[starts], starts)
    since = np.zeros(len(seen), np.int64)
    since[1:] = np.maximum.accumulate(np.maximum(last, _marked(starts, len(seen))))[:-1]
    since = np.maximum(since, _marked(starts, len(seen)))
    run = at - since
    return np.minimum(STREAKS - 1, np.ceil(np.log2(run + 1))).astype(np.int64)


def _marked(starts: np.ndarray, n: int) -> np.ndarray:
    """Of each token the place where its text begins."""
    out = np.zeros(n, np.int64)
    out[starts] = starts
    return np.maximum.accumulate(out)


def learn_found(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Chance of way 1 by the gates (SEEN, STREAKS): two predictors, mixed in the logistic domain by weights fitted to
    all training tokens, and refined by what each pair of gates has seen. No chance without the two words."""
    p = [(hits.sum(axis) + 0.5) / (total.sum(axis) + 2.0) for axis in (1, 0)]
    x = np.stack([np.repeat(_logit(p[0])[:, None], STREAKS, 1), np.repeat(_logit(p[1])[None], SEEN, 0), np.ones((SEEN, STREAKS))], -1).reshape(-1, 3)
    y, n, w = hits.ravel(), total.ravel(), np.array([0.5, 0.5, 0.0])
    for _ in range(30):
        q = _squash(x @ w)
        w = w + np.clip(np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(3), x.T @ (y - n * q) + (np.array([0.5, 0.5, 0.0]) - w)), -1, 1)
    mixed = _squash(x @ w).reshape(SEEN, STREAKS)
    out = (hits + 8 * mixed) / (total + 8)
    out[0] = 0
    return np.clip(out, 0, 1 - 1e-4)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def text_scores(lid: np.ndarray, lengths: np.ndarray, value: np.ndarray, seen: np.ndarray, share: np.ndarray, found: np.ndarray) -> np.ndarray:
    """log10 of each text's probability: the mean over urns of the products over tokens. value: log10 of each word's."""
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    t = np.arange(len(lid)) - starts[of]
    key = of.astype(np.int64) * (int(lid.max(initial=0)) + 1) + lid
    shift = len(lid).bit_length()
    if int(key.max(initial=0)).bit_length() + shift < 63:  # sorting numbers that end in the place is much faster than sorting places
        ordered = np.sort(key << shift | np.arange(len(lid)))
        order, ordered = ordered & ((1 << shift) - 1), ordered >> shift
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    came = np.empty(len(lid), np.int64)
    came[order] = np.arange(len(lid)) - np.maximum.accumulate(np.where(first, np.arange(len(lid)), 0))
    chance = found[seen, streaks(seen, share, starts)]
    way = np.where(share < 255, chance * 2.0 ** (-share.astype(float) / 16), 0.0)
    word, tiny = 10.0 ** np.maximum(value, -250)[lid], np.minimum(value + 250, 0)[lid]  # of very long words the rest is added
    out = [np.bincount(of, np.log10(way + (1 - chance) * word) + tiny, len(lengths))]
    tiny = np.where(came == 0, tiny, 0)
    for a in URNS:
        out.append(np.bincount(of, np.log10(way + (1 - chance) * ((a * word + came) / (a + t))) + tiny, len(lengths)))
    top = np.max(out, axis=0)
    return top + np.log10(np.mean([10.0 ** (x - top) for x in out], axis=0))


def score(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits
    (the same in bits) and bits_per_byte."""
    work = Workspace(spark, "context-mixing")
    found = work.table(marks(docs), "marks")
    scale = Scale(found.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    logs = learn_kinds(found)
    prior = logs[-1] / math.log(10)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "none").option("parquet.block.size", 16 << 20).parquet(work.at(tag))
        return spark.read.schema(df.schema).parquet(work.at(tag))

    blocks = kept(_blocked(docs, logs, block), "blocks")

    def coded(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {"pairs": [], "triples": []}
        for what, _, data in sorted(zip(*(right.column(c).to_pylist() for c in ("what", "slice", "data")))):
            got[what].append(from_planes(zstandard.decompress(data)).astype(np.int64))
        texts, names = left.column("texts")[0].as_py(), left.column("names")[0].as_py()
        seen, share = codes(*(g.others(np.concatenate(got[what])) for what, g in _groups(texts, names)))
        _, train, _, _, lengths, _ = unpack(texts)
        streak, tr = streaks(seen, share, np.cumsum(lengths) - lengths), np.repeat(train, lengths)
        cell = (seen.astype(np.int64) * STREAKS + streak)[tr]
        stats = np.stack([np.bincount(cell, share[tr] < 255, SEEN * STREAKS), np.bincount(cell, minlength=SEEN * STREAKS)])
        return pa.table({"block": left.column("block")[:1], "codes": pa.array([pack(seen.tobytes(), share.tobytes())], pa.binary()), "stats": pa.array([stats.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))})

    coded = kept(blocks.groupBy("block").cogroup(_elsewhere(_keys(blocks, scale)).groupBy("block")).applyInArrow(coded, "block long, codes binary, stats array<long>"), "codes")
    total = coded.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(2 * SEEN * STREAKS)]).first()
    chances = learn_found(*np.array(total, float).reshape(2, SEEN, STREAKS))
    work.free()
    merged = kept(_merged(_dictionaries(blocks, scale)), "merged")
    work.free()
    width = (KINDS + 1) * 4
    sums = np.array(merged.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(width)]).first(), np.int64).reshape(KINDS + 1, 4)
    n_all, v_all = (int(x) for x in sums[-1, :2])
    counts = work.table(_counted(merged), "tables")
    sent = spark.sparkContext.broadcast([bytes(r["data"]) for r in counts.orderBy("part").collect()])  # fixed size, whatever the corpus
    key = work.path

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                joined, c, _ = unpack(blob)
                tables = _once(f"{key}-tables", lambda: Tables(sent.value).ready())
                total += mixer_sums(*learn_slice(tables, *training_rows(joined, c)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])
        trim()

    total = np.zeros(CELLS, np.int64)
    for r in merged.select("words").mapInArrow(learn, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        total[r["cell"]] = r["n"]
    mixer = joined_mixer(total)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, back in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables = _once(f"{key}-tables", lambda: Tables(sent.value).ready())
                joined, c, base = unpack(words)
                names = joined.split(b" ")
                model = Model(tables, *mixer)
                kind = np.array([w[0] for w in names])
                p = np.rint(by_counts(kind, c, base, model.log10(names), sums) * 512).astype(np.int32)
                for b, lid, inverse in unpack(back)[0]:
                    yield _sent("values", b, 0, lid, p[inverse], base[inverse])
        trim()

    unit = math.log10(n_all + v_all + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, train, size, kinds, lengths, lid = unpack(next(x for x in left.column("texts").to_pylist() if x is not None))
        seen, share = (np.frombuffer(x, np.uint8) for x in unpack(next(x for x in left.column("codes").to_pylist() if x is not None)))
        value, base = np.zeros(int(lid.max()) + 1), np.zeros(int(lid.max()) + 1, np.int64)
        for blob in right.column("data").to_pylist():
            lids, some, n = unpack(blob)
            value[lids], base[lids] = some / 512, n
        of = np.repeat(np.arange(len(lengths)), lengths)
        known, plain = np.bincount(of, (base > 0)[lid], len(lengths)), np.bincount(of, (np.log10(base + 1) - unit)[lid], len(lengths))
        scores = text_scores(lid, lengths, value, seen, share, chances) + prior[kinds]
        bits = -scores * math.log2(10)
        return pa.table([pa.array(ids, pa.int64()), pa.array(~train), pa.array(lengths), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(lengths), n_all)), pa.array(plain), pa.array(scores), pa.array(bits), pa.array(bits / np.maximum(size, 1))], names=KIND.names)

    none = F.lit(None).cast("binary")
    left = blocks.select("block", "texts", none.alias("codes")).union(coded.select("block", none.alias("texts"), "codes"))
    values = merged.select("words", "back").mapInArrow(value, SENT_SQL)
    return left.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double")


KIND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])
