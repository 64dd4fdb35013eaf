"""A quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is cut into blocks of
`block` bytes; each is compressed once with either dictionary, so that a long text leans on the
dictionaries and not on itself. With g and b the sums of the sizes, the normalised difference
(b - g) / (b + g), how well the text compresses at all, (g + 8) / (n + 8), and its length enter a
logistic calibration, fitted on labelled texts that neither dictionary has seen.

The fit sees a bounded sample of labelled rows: about `most_rows` ids a class for the dictionaries and as many for the
calibration, chosen by the hash of the id, with their whole texts. Of the pieces of `PIECE` bytes that the former
cut into, a dictionary is built from about `SHARE` times its size, chosen by hash from all of each text; only those
come to the driver, and of the latter only sizes. Scoring covers whole texts of all rows. Held-out rows (crc32 of the id as text,
modulo 5, is 0) are never learnt from. Very long texts are compressed block after block and never copied.

Null texts are empty; an empty text gets the score that the calibration gives to no bytes. Rows of null
doc_id are scored and never learnt from. Labels of null quality, or of ids without a document, are left
out; repeated labels count once, repeated documents as often as they come (about `most_rows` different sizes a class). Without labels of both classes every score is 0.5.
Extra columns are ignored by `score`, and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, about, crc32_mod, small, trim

THRESHOLD = 0.3
#: Bytes of a piece; the pieces of a dictionary as a multiple of its size.
PIECE, SHARE = 1024, 16


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    block: int = 512
    level: int = 3
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"_made": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _compressors(self):
        if not self._made:
            for name, raw in (("good", self.good), ("bad", self.bad)):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=self.level)
                self._made[name] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False)
        return self._made["good"], self._made["bad"]

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes with the good dictionary, with the bad one, and as they are."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self._compressors()
        g = b = 0
        for i in range(0, max(len(raw), 1), self.block):
            part = raw[i : i + self.block]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return g, b, len(raw)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(sizes), 0.5)
        x = (_features(sizes) - np.array(self.mean)) / np.array(self.scale)
        return _sigmoid(np.c_[np.ones(len(x)), x] @ np.array(self.weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(sizes: np.ndarray) -> np.ndarray:
    g, b, n = np.asarray(sizes, float).reshape(-1, 3).T
    d, r = (b - g) / (b + g), np.log((g + 8) / (n + 8))
    return np.c_[d, r, r * r, d * r, d * d, np.log1p(n)]


def _calibrate(sizes: np.ndarray, y: np.ndarray, times: np.ndarray) -> dict:
    """Logistic regression by damped Newton steps, lightly held to zero. times: how often each row comes."""
    x = _features(sizes)
    mean = np.average(x, axis=0, weights=times)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=times)) + 1e-9
    z, ridge = np.c_[np.ones(len(x)), (x - mean) / scale], np.diag([0.0] + [0.05] * x.shape[1])
    w = np.zeros(z.shape[1])
    loss = lambda w: times @ np.logaddexp(0, np.where(y == 1, -(z @ w), z @ w)) + w @ ridge @ w / 2
    for _ in range(60):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(len(w)), z.T @ (times * (p - y)) + ridge @ w)
        t = 1.0
        while t > 1e-4 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return {"weights": tuple(map(float, w)), "mean": tuple(map(float, mean)), "scale": tuple(map(float, scale))}


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes themselves
        return b"".join(pieces)[-size:] or b"\n" * 16


def _pieces(picked: DataFrame, dictionary_bytes: int) -> dict[int, list[bytes]]:
    """picked(doc_id, quality, text): of each class pieces of its texts, from all of them with the same chance."""
    b = picked.select("doc_id", "quality", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    n = F.ceil(F.octet_length("b") / PIECE).cast("int")
    held = {int(r["quality"]): r["n"] for r in b.groupBy("quality").agg(F.sum(n).alias("n")).collect()}
    out: dict[int, list[bytes]] = {0: [], 1: []}
    cut = b.where("octet_length(b) > 0").select("doc_id", "quality", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    chosen = None
    for q in (0, 1):
        some = cut.where((F.col("quality") == q) & about(SHARE * dictionary_bytes / PIECE / max(held.get(q) or 0, 1), "doc_id", "i", seed=3))
        chosen = some if chosen is None else chosen.union(some)
    chosen = chosen.select("quality", F.col("b").substr(F.col("i") * PIECE + 1, F.lit(PIECE)).alias("b"), F.xxhash64("doc_id", "i", F.lit(1)).alias("h"))
    for row in sorted(chosen.collect(), key=lambda r: (r["h"], bytes(r["b"]))):  # the bound is twice SHARE * dictionary_bytes
        out[int(row["quality"])].append(bytes(row["b"]))
    return out


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, dictionary_bytes: int = 448 << 10) -> Model:
    """Learns from rows that are not held out."""
    work = Workspace(docs.sparkSession, "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc32_mod("doc_id", 5) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    held = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, about(2 * most_rows / max(held.get(1, 0), 1), "doc_id", seed=11)).otherwise(about(2 * most_rows / max(held.get(0, 0), 1), "doc_id", seed=11))
    ids = known.where(share).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))
    picked = work.table(docs.select("doc_id", "text").join(small(ids, 80), "doc_id"), "picked")
    pieces = _pieces(picked.where("part = 0"), dictionary_bytes)
    blank = Model(b"\n" * 16, b"\n" * 16)
    if not pieces[0] or not pieces[1]:
        return blank
    even = min(dictionary_bytes, *(max(256, sum(map(len, t))) for t in pieces.values()))
    model = Model(_dictionary(pieces[1], even), _dictionary(pieces[0], even))
    sizes = work.table(_sized(picked.where("part = 1"), model, "quality").groupBy("quality", "g", "b", "n").agg(F.count("*").alias("times")), "sizes")
    got = sizes.where(about(2 * most_rows / max(sizes.count(), 1), "quality", "g", "b", "n", seed=7)).orderBy("quality", "g", "b", "n").collect()
    work.drop()
    y = np.array([r["quality"] for r in got])
    if not len(y) or y.min() == y.max():
        return blank
    return Model(model.good, model.bad, **_calibrate(np.array([(r["g"], r["b"], r["n"]) for r in got]), y, np.array([float(r["times"]) for r in got])))


def _sized(df: DataFrame, model: Model, *names: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([sent.value.sizes(t) for t in batch.column(0).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x[:, k]) for k in range(3))], names=[*batch.schema.names[1:], "g", "b", "n"])
        trim()

    kinds = dict(df.dtypes)
    return df.select("text", *names).mapInArrow(task, ", ".join([*(f"{n} {kinds[n]}" for n in names), "g long, b long, n long"]))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column _score."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = docs.withColumn("_score", F.lit(0.0)).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = sent.value
            s = m.score(np.array([m.sizes(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "_score"])
        trim()

    return docs.mapInArrow(task, schema)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = model or train(docs, labels)
    s = _scored(docs.select("doc_id", "text"), model)
    return s.select("doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, with their own columns, whose score reaches the threshold."""
    model = model or train(docs, labels)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"c{k}") for k, c in enumerate(names)])
    kept = _scored(inner, model).where(F.col("_score") >= THRESHOLD)
    return kept.select(*[F.col(c if c == "text" else f"c{k}").alias(c) for k, c in enumerate(names)])
