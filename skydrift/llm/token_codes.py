"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, least significant first. Level k holds the k-th chunks of those
ids that have one, a bitmap that says which of them go on to level k+1, and a rank directory (ones
before each block of 512 bits). So any token of a file is found with one rank per level, and no
block is decoded. A file holds the tokens of consecutive documents, with their ids and offsets:

    header   8 bytes "DACODES1", then tokens, documents, levels as unsigned 64-bit integers
    ids      one signed 64-bit integer a document, then one byte a document: 1 if it has an id
    offsets  documents + 1 unsigned 64-bit integers, tokens before each document of this file
    levels   for each: chunks (unsigned 64-bit), ranks (unsigned 32-bit each), bitmap, chunks

All integers are little-endian. Files hold at most `tokens_a_file` tokens, or one document if that
is longer, so a writer's memory is bounded by that and the longest document.

Null texts are empty: such a document is its end id alone. Documents with equal doc_id follow each
other in order of their texts; null ids come first. Other columns are ignored. An empty table
writes no file and gives no rows.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import full_address
from .common import Workspace, local_or_remote, trim

MAGIC, BLOCK = b"DACODES1", 512
#: Encoded at once.
TEXTS = 1000


def pack(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """The file of these documents; tokens are all their ids, one after the other."""
    out, left, levels = [], np.ascontiguousarray(tokens, dtype="<u8"), 0
    while levels == 0 or len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones[:-1])]) if len(ones) else ones
        out += [np.uint64(len(left)).tobytes(), ranks.astype("<u4").tobytes(), bits.tobytes(), (left & 0xFF).astype(np.uint8).tobytes()]
        left, levels = left[more] >> np.uint64(8), levels + 1
    head = np.array([len(tokens), len(doc_ids), levels], "<u8").tobytes()
    ids = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is not None for x in doc_ids)
    return b"".join([MAGIC, head, ids, np.concatenate([[0], np.cumsum(lengths, dtype="<u8")]).astype("<u8").tobytes(), *out])


class Codes:
    """Reads what pack() wrote; buffer may be a memory map."""

    def __init__(self, buffer):
        b = memoryview(buffer)
        if bytes(b[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, self.n_docs, n_levels = (int(x) for x in np.frombuffer(b, "<u8", 3, 8))
        at = 32
        ids = np.frombuffer(b, "<i8", self.n_docs, at)
        has = np.frombuffer(b, np.uint8, self.n_docs, at := at + 8 * self.n_docs)
        self.doc_ids = [int(x) if y else None for x, y in zip(ids, has)]
        self.offsets = np.frombuffer(b, "<u8", self.n_docs + 1, at := at + self.n_docs).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(b, "<u8", 1, at)[0])
            ranks = np.frombuffer(b, "<u4", -(-n // BLOCK), at := at + 8)
            bits = np.frombuffer(b, np.uint8, -(-n // 8), at := at + ranks.nbytes)
            chunks = np.frombuffer(b, np.uint8, n, at := at + bits.nbytes)
            at += n
            self.levels.append((ranks, bits, chunks))

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        ranks, bits, chunks = self.levels[level]
        if i >= len(chunks):  # past the end: all ones
            i, extra = len(chunks) - 1, 1
            if i < 0:
                return 0
        else:
            extra = 0
        start = i // BLOCK * BLOCK
        seen = np.unpackbits(bits[start // 8 : i // 8 + 1], bitorder="little")
        return int(ranks[i // BLOCK]) + int(seen[: i - start].sum()) + (int(seen[i - start]) if extra else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (_, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(k, i), shift + 8
        return value

    def span(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b, found from the rank directories without reading what lies before."""
        out = np.zeros(b - a, np.uint32)
        where, shift = np.arange(b - a), 0
        for k, (_, bits, chunks) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            where, shift = where[more], shift + 8
            if not len(where):
                break
            a = self._rank(k, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.offsets[k]), int(self.offsets[k + 1]))


# The letters that stand for bytes in byte-level vocabularies. Printable Latin-1 bytes are themselves.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = np.zeros(256, "<u4")
LETTERS[_printable] = _printable
LETTERS[np.setdiff1d(np.arange(256), _printable)] = 256 + np.arange(256 - len(_printable))


class Encoder:
    """The tokenizer over whole texts, with what it gave for pieces between blanks kept for the next.

    A byte-level BPE splits a text before it merges anything, and always before a blank that follows
    something else than white space; around a line feed between two such characters; and before a
    comma or full stop that follows a letter. So pieces cut there give the same ids alone. Texts with other white space, or with
    several blanks or line feeds in a row, are encoded as they are; so are those with one of the tokenizer's added tokens, which it
    finds before it splits.
    """

    most = 400_000  # pieces kept, and as many that have come before them

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kept, self.old = Tokenizer.from_file(path), {}, {}
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        across = [t for t in added if " " in t or "\n" in t]  # these don't lie within a piece
        self.across = re.compile("|".join(map(re.escape, across))) if across else None
        self.feed = np.array(self.tok.encode("\n", add_special_tokens=False).ids, "<u4")
        probe = [" probe", "été", " Größe", "日本語", "a", " ª"]
        whole = [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(probe, add_special_tokens=False)]
        self.by_bytes = False
        try:  # only a byte-level tokenizer's model takes bytes as letters
            self.by_bytes = self._words(probe) == whole
        except Exception:  # noqa: BLE001 - a model of another kind
            pass

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Of single words of letters alone, with a blank before or without: each is one piece to the pre-tokenizer,
        so its bytes, as the letters that stand for them, go to the tokenizer's model at once."""
        raw = np.frombuffer("\n".join(pieces).encode(), np.uint8)
        tokenize = self.tok.model.tokenize
        return [array("I", [t.id for t in tokenize(p)]).tobytes() for p in LETTERS[raw].tobytes().decode("utf-32-le").split(chr(LETTERS[10]))] if pieces else []

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Of pieces without white space but for one blank before them."""
        out: list[bytes] = [b""] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if p.isalpha() or p[0] == " " and p[1:].isalpha()] if self.by_bytes else []
        for k, ids in zip(plain, self._words([pieces[k] for k in plain])):
            out[k] = ids
        rest = [k for k, x in enumerate(out) if not x]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for k, e in zip(part, self.tok.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
        return out

    def _learn(self, new: set[str]) -> None:
        """Pieces begin with a line feed, or else follow a blank; None: the text has to be encoded as it is."""
        kept, need, plans = self.kept, {}, []
        if joined := new & {"", "\n"}:
            kept.update(dict.fromkeys(joined))
            new = new - joined
        joined = "".join([p[1:] if p[0] == "\n" else p for p in new])
        if len(joined.split()) > 1 or joined.strip() != joined or self.added.search(joined):  # some piece isn't a plain word
            odd = [p for p in new if self.added.search(p) or len((p[1:] if p[0] == "\n" else "." + p).split()) != 1 or p[-1].isspace() or p[1:2].isspace()]
            kept.update(dict.fromkeys(odd))
            new = new.difference(odd)
        for p in new:
            head = p[1:] if p[0] == "\n" else " " + p
            if head[-1] in ",." and len(head) > 1 and head[-2].isalpha():
                tail, head = head[-1], head[:-1]
                need[tail] = b""
            else:
                tail = ""
            need[head] = b""
            plans.append((p, head, tail))
        words = list(need)
        need = dict(zip(words, self._many(words)))
        feed = self.feed.tobytes()
        for p, head, tail in plans:
            ids = need[head] + need[tail] if tail else need[head]
            kept[p] = feed + ids if p[:1] == "\n" else ids

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        gc.disable()  # many small objects come here, and none in cycles
        try:
            return self._encoded(list(texts))
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > self.most:  # what comes again goes over to the new ones, so frequent pieces stay
            self.old, self.kept = self.kept, {}
        cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        new = set().union(*cut).difference(self.kept) if cut else set()
        if again := new & self.old.keys():
            self.kept.update(zip(again, map(self.old.__getitem__, again)))
            new -= again
        self._learn(new)
        get, skip, out = self.kept.__getitem__, self.feed.nbytes, []
        for text, pieces in zip(texts, cut):
            try:
                if self.across and self.across.search(text):
                    raise TypeError(text)
                out.append(b"".join(map(get, pieces))[skip:])
            except TypeError:  # a None among them, or an added token across pieces
                out.append(array("I", self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_files(docs: DataFrame, out: str, vocabulary: str, end_id: int, tokens_a_file: int = 2_000_000) -> DataFrame:
    """Writes the files of docs(doc_id, text) below the folder out, in ascending doc_id order; returns the
    lazy manifest: path, part, seq, n_docs, n_tokens. Run it once, into a table: each run writes files anew,
    under names of its own, and only files in the manifest of finished tasks count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.uint32(end_id).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        fs, folder = local_or_remote(out)
        fs.create_dir(folder, recursive=True)
        ids, sizes, data, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, data, held, seq
            path = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(path) as f:
                f.write(pack(ids, sizes, np.frombuffer(b"".join(data), "<u4")))
            row = pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [held]}, schema=MANIFEST)
            ids, sizes, data, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), TEXTS):
                for key, got in zip(keys[at : at + TEXTS], enc([t or "" for t in texts.slice(at, TEXTS).to_pylist()])):
                    n = len(got) // 4 + 1
                    if held and held + n > tokens_a_file:
                        yield flush()
                    ids.append(key)
                    sizes.append(n)
                    data += [got, end]
                    held += n
        if ids:
            yield flush()
        ids, sizes, data = [], [], []
        trim()

    out = full_address(docs.sparkSession, out)  # what tasks write through is what Spark means
    n = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(task, "path string, part int, seq int, n_docs long, n_tokens long")


MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_files(manifest: DataFrame, out: str) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start (tokens of all documents before), n_tokens, ids_crc32."""
    # one row a file; parts first, so that no task sees the rows of all files
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    files = manifest.withColumn("inside", inside).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("start"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = local_or_remote(out)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(path) as f:
                    codes = Codes(f.read())
                crcs = [zlib.crc32(codes.document(k).astype("<u4").tobytes()) for k in range(codes.n_docs)]
                yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids, pa.int64()), pa.array(codes.offsets[:-1] + start), pa.array(np.diff(codes.offsets)), pa.array(crcs, pa.int64())], schema=DIGEST)

    out = full_address(manifest.sparkSession, out)
    n = manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(n, manifest.rdd.getNumPartitions())).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes docs as token files (below out, or a folder of its own in the shared one) and reads them back."""
    work = Workspace(spark, "token-codes")
    out = out or work.at("files")
    manifest = work.table(write_files(docs, out, vocabulary, end_id), "manifest")
    return read_files(manifest, out)
