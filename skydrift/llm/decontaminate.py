"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. An item's windows are its
runs of ten consecutive words, or the item itself if it has fewer (an item without words has none). All
windows of all items form one automaton, and each text is scanned once in its normalised form, words
joined by single blanks; what it finds is mapped back to words and to offsets in the original text.

The benchmark's size is summed before anything is sent. Up to `item_bytes` it is one automaton, which a worker builds
once. A larger one is dealt into several of about that size, which the texts pass one after the other, so no automaton outgrows a worker; parts
come to the driver one at a time.

Null and empty texts have no words. Items of equal item_id count once; a null item_id is called "null".
Repeated documents are each judged; other columns of the documents are kept as they are, except where
`verdicts` returns its own. An empty benchmark leaves every document clean. Texts of any length are scanned whole, in
pieces that overlap by a window, so that no more than a piece is held as words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: Bytes: A-Z to a-z, 0-9, a-z and all of non-ASCII characters as they are, anything else to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words in texts whose A-Z are as they were.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def automaton(items: list[tuple[str, str | None]], window: int = 10):
    """Of the windows, each between blanks, with (words, items that have it)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(b" ".join(w[i : i + n]), (n, set()))[1].add(key)
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(f" {k.decode('latin-1')} ", v)
    a.make_automaton()
    return a


def _cut(raw: bytes, size: int) -> Iterator[bytes]:
    """A folded text in pieces of about this size, cut at blanks."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def scan(a, text: str | None, window: int = 10, size: int = 1 << 20) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words, the hit runs of words [first, last + 1) and the items found."""
    n, tail, found, items = 0, [], [], set()
    for piece in _cut((text or "").encode("utf-8", "surrogatepass").translate(FOLD), size):
        fresh = piece.split()
        w = tail + fresh
        if len(a) and w:
            got = list(a.iter(f" {b' '.join(w).decode('latin-1')} "))
            if got:  # places of the blanks after words say which word is a match's last
                last = np.searchsorted(np.cumsum([len(x) + 1 for x in w]), [e for e, _ in got]) + n - len(tail)
                found += [(e - k + 1, e + 1) for e, (_, (k, _)) in zip(last.tolist(), got)]
                for _, (_, keys) in got:
                    items |= keys
        n += len(fresh)
        tail = w[len(w) - min(len(w), window - 1) :]
    return n, merged(found), items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [start, end) offsets, in characters, in the original text."""
    at = [m.span() for m in WORD.finditer(text)] if runs else []
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCANNED = "n_words long, runs array<struct<first:int,last:int>>, items array<string>"


def _parts(benchmark: DataFrame, item_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in parts of at most about item_bytes, of which one is collected at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    k = max(1, -(-2 * total // item_bytes)) if total > item_bytes else 1
    for i in range(k):
        yield [tuple(r) for r in b.where(F.pmod(F.xxhash64("item_id"), F.lit(k)) == i).collect()]


_built: dict[str, object] = {}


def _once(key: str, make):
    """One automaton a worker: the last."""
    if key not in _built:
        _built.clear()
        _built[key] = make()
    return _built[key]


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, runs (hit words as [first, last)) and items, beside their own columns."""
    spark = docs.sparkSession
    out = docs.withColumns({"_n": F.lit(0).cast("long"), "_r": F.lit(None).cast("array<struct<first:int,last:int>>"), "_i": F.lit(None).cast("array<string>")})
    schema = out.schema
    at = schema.fieldNames().index("text")
    for items in _parts(benchmark, item_bytes):
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def task(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            a = _once(key, lambda: automaton(sent.value, window))
            for batch in batches:
                n, r, i = [], [], []
                kept = [batch.column(batch.num_columns - k) for k in (2, 1)]
                for row, text in enumerate(batch.column(at).to_pylist()):
                    count, runs, found = scan(a, text, window)
                    if kept[0][row].is_valid:
                        runs = merged(runs + [(x["first"], x["last"]) for x in kept[0][row].as_py()])
                        found |= set(kept[1][row].as_py())
                    n.append(count)
                    r.append([{"first": x, "last": y} for x, y in runs])
                    i.append(sorted(found))
                types = [f.type for f in batch.schema][-3:]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(n, types[0]), pa.array(r, types[1]), pa.array(i, types[2])], schema=batch.schema)
            trim()

        out = out.mapInArrow(task, schema)
    return out.withColumnsRenamed({"_n": "n_words", "_r": "runs", "_i": "items"})


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    s = scanned(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return s.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with their own columns, in which no window of any item occurs."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"c{k}") for k, c in enumerate(names)])
    s = scanned(inner, benchmark, window).where(F.size("runs") == 0)
    return s.select(*[F.col(c if c == "text" else f"c{k}").alias(c) for k, c in enumerate(names)])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, start, end (characters of the original text) and the passage, for each hit run."""
    s = scanned(docs.select("doc_id", "text"), benchmark, window).where(F.size("runs") > 0)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def place(text, runs):
        return text.combine(runs, lambda t, r: [{"start": a, "end": b} for a, b in original_spans(t, [(x["first"], x["last"]) for x in r])])

    s = s.withColumn("span", F.explode(place("text", "runs")))
    return s.select("doc_id", "span.start", "span.end", F.expr("substring(text, span.start + 1, span.end - span.start)").alias("passage"), "items")


