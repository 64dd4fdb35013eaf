"""Removal of repeated passages with column-wise suffix sorting.

Every byte is removed that a string of 400 bytes covers which also starts somewhere else, in the same
document or another; strings are judged on the input. Texts are UTF-8. In the same pass strings of 240 bytes are judged
likewise: more than fifty words that documents share have at least so many bytes, but not always 400. They are reported and not removed.

1. Each start of a 240-byte string is given the least hashed 64-byte gram within it, its anchor. The
   starts of one anchor are consecutive; the bytes from the first to the end of the last start's 400-byte string (or the text) are the
   anchor's span. Equal strings have equal anchors at equal places. Anchors are counted by their gram;
   one that comes once ends there, so what follows sees only text around grams that come again.
2. Equal spans of a gram are one, with their number. If there are several, all their strings come again.
3. Spans of one gram that differ are aligned at it and built column by column, from right to left: each
   round inserts one symbol of every span, and updates the order of all suffixes that start there (the
   column's part of the collection's Burrows-Wheeler order) and the common prefixes of neighbours in it.
   Neighbours that share 240 symbols, or 400, mark a start as repeated. Rounds are at most 577, whatever
   the length of the documents. The symbols of a batch of spans lie in an external file in the shared folder, column after column from the right, which
   is written once and read once, in sequence. A task also holds the bytes of the spans of its batch, which are written from there: a batch is the spans of whole
   grams, some 2 MB, or those of one gram, at most `wide` times the bytes of a span; and order, common prefixes and runs, some 40 bytes a span.
4. Marked starts go back to their documents as intervals.

A whole-collection construction would take as many rounds as the longest document has bytes, each over
all of the order so far; the anchors cut it into independent parts with the same answer.

Grams with more than `wide` different spans are not brought into one task: for them the hash of each
string of a span is counted as a row, with partial sums, which is exact too.

Null texts are empty, and documents below 240 bytes keep everything. Rows of equal doc_id are documents
of their own; if their texts are equal too, they are each other's copies. Null ids are allowed; ids are whole numbers, or text that says one. Extra
columns are ignored. An empty table gives an empty result. Very long texts: a task holds some thirty times the bytes of one
text when it looks for anchors, and a text with its spans when it cuts them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, local_or_remote, small, trim
from .shingles import U, mix

LENGTH, PASSAGE, GRAM = 400, 240, 64
#: A passage has more words than this.
WORDS = 50
CHUNK_BYTES = 1 << 20
#: Bytes of spans that are turned into columns at once.
SEGMENT = 8 << 20
_symbols = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on."""
    h, k = _symbols[buf], 1
    while k < GRAM:
        h = h[:-k] * U(pow(0xD6E8FEB86659FD93, k, 1 << 64)) + h[k:]
        k *= 2
    return mix(h)


def anchors(texts: list[bytes], length: int = PASSAGE) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, gram hash, anchor, first start, last start) for each anchor of texts of `length` bytes or more."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(buf)
    bits = U(int(len(h)).bit_length())
    low = (U(1) << bits) - U(1)
    keys = (h & ~low) | np.arange(len(h), dtype=U)
    wide, k = length - GRAM + 1, 1
    while 2 * k <= wide:
        keys, k = np.minimum(keys[:-k], keys[k:]), 2 * k
    place = (np.minimum(keys[: len(keys) - (wide - k)], keys[wide - k :]) & low).astype(np.int64)
    # starts whose string stays within its text
    ok = np.ones(len(place), bool)
    for e in ends[:-1]:
        ok[max(0, e - length + 1) : e] = False
    start = np.flatnonzero(ok)
    if not len(start):
        return
    at = place[start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    text = np.searchsorted(ends, start[first], side="right")
    base = (ends - sizes)[text]
    yield from zip(text.tolist(), h[at[first]].view(np.int64).tolist(), (at[first] - base).tolist(), (start[first] - base).tolist(), (start[last] - base).tolist())


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))


ANCHOR = "gram long, span binary, id long, tkey long, rel int, first int, last int, full int"


def _anchored(docs: DataFrame) -> DataFrame:
    kind = pa.schema([("gram", pa.int64()), ("span", pa.binary()), ("id", pa.int64()), ("tkey", pa.int64()), ("rel", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("full", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(texts: list[bytes], keys: list[tuple[int, int]]) -> pa.RecordBatch:
            rows = [(g, xxhash.xxh3_128_digest(texts[t][a : b + LENGTH], seed=at - a), *keys[t], at - a, a, b, min(b, len(texts[t]) - LENGTH)) for t, g, at, a, b in anchors(texts)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([],) * 8, kind)], schema=kind)

        for batch in batches:
            texts, keys, size = [], [], 0
            for text, i, k in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if len(raw := _bytes(text)) >= PASSAGE:
                    texts.append(raw)
                    keys.append((i, k))
                    size += len(raw)
                if size > CHUNK_BYTES:
                    yield found(texts, keys)
                    texts, keys, size = [], [], 0
            if texts:
                yield found(texts, keys)
        trim()

    return docs.select("text", "id", "tkey").where(F.octet_length("text") >= PASSAGE).mapInArrow(task, ANCHOR)


class Columns:
    """Symbols of aligned spans in an external file, column after column from the right, for one pass in sequence.
    left, right: the columns that each span has."""

    def __init__(self, spans: list[bytes], left: np.ndarray, right: np.ndarray, folder: str):
        self.left, self.right = left, right
        self.fs, at = local_or_remote(folder)
        self.fs.create_dir(at, recursive=True)
        self.paths, self.edges, a = [], [], 0
        while a < len(spans):  # a file for so many spans that their columns can be turned in memory
            z, size = a, 0
            while z < len(spans) and (z == a or size + len(spans[z]) <= SEGMENT):
                size, z = size + len(spans[z]), z + 1
            path = f"{at}/{uuid.uuid4().hex}.columns"
            data, offset = np.frombuffer(b"".join(spans[a:z]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spans[a:z]])])[:-1]
            lo, hi = left[a:z], right[a:z]
            with self.fs.open_output_stream(path, buffer_size=1 << 20) as f:
                for col in range(int(hi.max()) - 1, int(lo.min()) - 1, -1):
                    some = np.flatnonzero((lo <= col) & (col < hi))
                    f.write(data[offset[some] + col - lo[some]].tobytes())
            self.paths.append(path)
            self.edges.append((a, z))
            a = z

    def __enter__(self) -> Columns:
        self.files = [self.fs.open_input_stream(p, buffer_size=1 << 18) for p in self.paths]
        self.now = np.zeros(len(self.left), np.uint8)
        return self

    def read(self, col: int) -> np.ndarray:
        """The symbol of each span that has the column. Columns are asked for from the right, each once."""
        for f, (a, z) in zip(self.files, self.edges):
            some = np.flatnonzero((self.left[a:z] <= col) & (col < self.right[a:z]))
            if len(some):
                self.now[a + some] = np.frombuffer(f.read(len(some)), np.uint8)
        return self.now

    def __exit__(self, *_) -> None:
        for f, p in zip(self.files, self.paths):
            f.close()
            self.fs.delete_file(p)


def repeated_runs(group: np.ndarray, rel: np.ndarray, spans: list[bytes], folder: str, lengths: tuple[int, ...] = (PASSAGE, LENGTH)) -> Iterator[tuple[int, int, int, int]]:
    """(which of lengths, span, first, last): runs of the starts in each span (sorted by group; rel: where its anchor
    lies) at which so many bytes also lie, at the same distance from the anchor, in another span of the group."""
    sizes = np.array([len(s) for s in spans], np.int64)
    left, right = -rel, sizes - rel  # columns of each span
    enters = np.argsort(-right, kind="stable")
    came = 0
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int32)
    still = np.full((len(lengths), len(spans)), np.iinfo(np.int64).min)  # the last column of a run that goes on
    none = still[0, 0] if len(spans) else 0
    with Columns(spans, left, right, folder) as columns:
        for col in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 2, -1):
            stay = left[order] <= col
            if not stay.all():  # those that have ended leave; common prefixes close over the gap
                gone = order[~stay]
                for k in range(len(lengths)):
                    for i in gone[still[k, gone] != none].tolist():
                        yield k, i, int(col + 1 + rel[i]), int(still[k, i] + rel[i])
                    still[k, gone] = none
                kept = np.flatnonzero(stay)
                if len(kept):
                    lcp = np.minimum.reduceat(lcp[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                    lcp[np.concatenate([[True], group[order[kept[1:]]] != group[order[kept[:-1]]]])] = 0
                else:
                    lcp = lcp[:0]
                order = order[kept]
            n = came
            while n < len(enters) and right[enters[n]] > col:
                n += 1
            if n > came:  # spans that begin here, from the right: empty suffixes come first in their group
                new = np.sort(enters[came:n])
                where = np.searchsorted(group[order], group[new], side="left")
                order = np.insert(order, where, new)
                old = np.ones(len(order), bool)
                old[where + np.arange(len(new))] = False
                full = np.zeros(len(order), np.int32)
                full[old] = lcp
                after = np.flatnonzero(~old) + 1
                full[after[after < len(full)]] = 0
                lcp, came = full, n
            if not len(order):
                continue
            key = group[order] << 8 | columns.read(col)[order]
            to = np.argsort(key, kind="stable")
            key, p, q = key[to], to[:-1], to[1:]
            fresh = np.zeros(len(order), np.int32)
            same = key[1:] == key[:-1]
            p, q = p[same], q[same]
            if len(p):
                pairs = np.empty(2 * len(p), np.int64)
                pairs[::2], pairs[1::2] = p + 1, q + 1
                fresh[1:][same] = 1 + np.minimum.reduceat(np.append(lcp, np.int32(0)), pairs)[::2]
            order, lcp = order[to], fresh
            for k, length in enumerate(lengths):
                hit = lcp >= length
                hit[:-1] |= hit[1:]
                begins = order[hit & (still[k, order] == none)]
                ends = order[~hit & (still[k, order] != none)]
                for i in ends.tolist():
                    yield k, i, int(col + 1 + rel[i]), int(still[k, i] + rel[i])
                still[k, ends] = none
                still[k, begins] = col


SPANS = "gram long, span binary, rel int, most int, bytes binary"


def _cut_spans(docs: DataFrame) -> DataFrame:
    """docs(text, wants: spans to cut out): a row for each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = _bytes(text)
                rows += [(w["gram"], w["span"], w["rel"], w["last"] - w["first"], raw[w["first"] : w["last"] + LENGTH]) for w in wants]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["gram", "span", "rel", "most", "bytes"])
        trim()

    return docs.select("text", "wants").mapInArrow(task, SPANS)


RUNS = pa.schema([("gram", pa.int64()), ("span", pa.binary()), ("whole", pa.bool_()), ("from", pa.int32()), ("to", pa.int32())])
RUNS_SQL = "gram long, span binary, whole boolean, `from` int, `to` int"


def _column_wise(spans: DataFrame, batch_bytes: int, folder: str) -> DataFrame:
    """(gram, span, whole: of LENGTH bytes, from, to): runs of repeated starts within the spans of each gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> pa.RecordBatch:
            names = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.int64)
            out = []
            for k, i, a, b in repeated_runs(names, np.array([r[2] for r in rows], np.int64), [r[4] for r in rows], folder):
                if a <= rows[i][3]:  # what starts further on has another anchor
                    out.append((rows[i][0], rows[i][1], bool(k), a, min(b, rows[i][3])))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([],) * 5, RUNS)], schema=RUNS)

        rows, size, before = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if row[0] != before and size > batch_bytes:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                before = row[0]
        if rows:
            yield done(rows)
        rows = []
        trim()

    return spans.repartition("gram").sortWithinPartitions("gram").mapInArrow(task, RUNS_SQL)


def _counted(spans: DataFrame) -> DataFrame:
    """The same for grams of very many spans, by counting the hash of each string."""
    kind = pa.schema([("gram", pa.int64()), ("span", pa.binary()), ("whole", pa.bool_()), ("at", pa.int32()), ("col", pa.int32()), ("hash", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, span, rel, most, raw in zip(*(batch.column(c).to_pylist() for c in range(5))):
                for whole, length in ((False, PASSAGE), (True, LENGTH)):
                    n = max(0, min(most, len(raw) - length) + 1)
                    hashes = [xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([span] * n, pa.binary()), pa.array([whole] * n), pa.array(range(n), pa.int32()), pa.array([i - rel for i in range(n)], pa.int32()), pa.array(hashes, pa.binary())], schema=kind)

    rows = spans.mapInArrow(task, "gram long, span binary, whole boolean, at int, col int, hash binary")
    again = rows.groupBy("gram", "whole", "col", "hash").agg(F.count("*").alias("n")).where("n > 1").select("gram", "whole", "col", "hash")
    return rows.join(again, ["gram", "whole", "col", "hash"]).select("gram", "span", "whole", F.col("at").alias("from"), F.col("at").alias("to"))


def intervals(docs: DataFrame, work: Workspace, batch_bytes: int = 2 << 20, wide: int = 1_000_000) -> DataFrame:
    """docs with id and tkey: rows (id, tkey, ranges), ranges the first and last of consecutive repeated starts, of
    strings of LENGTH bytes (whole) or PASSAGE."""
    found = work.table(_anchored(docs), "anchors")
    again = work.table(found.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "again", True)
    # the tables grow with the collection, so they meet by a shuffle at every size
    live = work.table(found.join(again.hint("merge"), "gram", "left_semi"), "live")
    for tag in ("anchors", "again"):
        work.drop(tag)
    spans = work.table(live.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "tkey", "rel", "first", "last", "full")).alias("one")), "spans", True)
    grams = spans.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    grams = work.table(grams.select("gram", "kinds"), "grams", True)
    open_spans = spans.join(grams.hint("merge"), "gram")
    wants = open_spans.select("one.id", "one.tkey", F.struct("gram", "span", "one.rel", "one.first", "one.last").alias("w")).groupBy("id", "tkey").agg(F.collect_list("w").alias("wants"))
    wants = work.table(wants, "wants", True)
    cut = work.table(_cut_spans(docs.join(wants.hint("merge"), ["id", "tkey"])), "cut")
    many = work.table(grams.where(F.col("kinds") > wide).select("gram"), "wide", True)
    if many.isEmpty():
        runs = _column_wise(cut, batch_bytes, work.at("columns"))
    else:
        many = small(many, 80)
        runs = _column_wise(cut.join(many, "gram", "left_anti"), batch_bytes, work.at("columns")).union(_counted(cut.join(many, "gram", "left_semi").dropDuplicates(["gram", "span"])))
    runs = work.table(runs, "runs")
    single = spans.where("n = 1").join(runs, ["gram", "span"]).select("one.id", "one.tkey", "whole", (F.col("one.first") + F.col("from")).alias("first"), (F.col("one.first") + F.col("to")).alias("last"))
    several = live.join(spans.where("n > 1").select("gram", "span").hint("merge"), ["gram", "span"], "left_semi")
    several = several.select("id", "tkey", F.explode(F.array(F.struct(F.lit(False).alias("whole"), "first", "last"), F.struct(F.lit(True).alias("whole"), "first", F.col("full").alias("last")))).alias("x")).select("id", "tkey", "x.*").where("first <= last")
    return single.union(several).groupBy("id", "tkey").agg(F.collect_list(F.struct("first", "last", "whole")).alias("ranges"))


def removed(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte runs [start, end) that the strings from these starts cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def _with_ranges(docs: DataFrame, work: Workspace, **how) -> DataFrame:
    keyed = _keyed(docs)
    got = work.table(intervals(keyed, work, **how), "intervals")
    for tag in ("live", "spans", "grams", "wants", "cut", "wide", "runs", "columns"):
        work.drop(tag)
    return keyed.join(got.hint("merge"), ["id", "tkey"], "left")


def whole_words(raw: bytes, a: int, b: int) -> int:
    """Words that lie in raw[a:b] with their ends."""
    part = raw[a:b]
    n = len(part.split())
    for edge in (raw[max(a - 1, 0) : a + 1], raw[max(b - 1, 0) : b + 1]):
        n -= len(edge.split()) == 1 and len(edge.strip()) == 2  # the cut is within a word
    return max(n, 0)


def _parted(ranges: list[dict] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Bytes of repeated strings of LENGTH, and of PASSAGE."""
    rows = ranges or ()
    return tuple(removed([(r["first"], r["last"]) for r in rows if r["whole"] == whole], length) for whole, length in ((True, LENGTH), (False, PASSAGE)))


def digest(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; and n_shared, bytes in repeated strings of
    PASSAGE bytes, and n_passages, how many runs of such bytes have more than WORDS words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, sums, shared, passages = [], [], [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _bytes(text)
                cut, common = _parted(ranges)
                n.append(len(raw))
                gone.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                sums.append(hashlib.sha256(kept(raw, cut)).hexdigest())
                shared.append(sum(b - a for a, b in common))
                passages.append(sum(whole_words(raw, a, b) > WORDS for a, b in common))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sums), *(pa.array(x, pa.int64()) for x in (shared, passages))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "n_passages"])
        trim()

    x = _with_ranges(docs, Workspace(spark, "suffix-dedup"), **how)
    return x.select("doc_id", "text", "ranges").mapInArrow(task, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, n_passages long")


def kept(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def strip(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id and text without the repeated passages; bytes of a character that was cut in two are dropped."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(_bytes(t), _parted(r)[0]).decode("utf-8", "ignore") for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["doc_id", "text"])

    return _with_ranges(docs, Workspace(spark, "suffix-strip"), **how).select("doc_id", "text", "ranges").mapInArrow(task, f"doc_id {kind}, text string")
