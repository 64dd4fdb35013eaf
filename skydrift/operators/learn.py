"""A classifier of hits, anomalies, and how much the search recovers of tones planted in what was observed."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import rollup
from .dedoppler import column_noise
from .features import SCALARS, snippets, vectors
from .kernel import kernel_hits, packed
from .ordering import numbered
from .rangejoin import small

# The classes of signals, in the order in which models and tables have them.
LABELS = ("technosignature_like", "rfi_zero_drift", "rfi_wideband", "rfi_nonlinear", "rfi_intermittent", "rfi_strong_carrier", "noise")
def normalized(z: np.ndarray, block: int = 512) -> np.ndarray:
    """The array form of normalize.normalize."""
    z = np.nan_to_num(z.astype(np.float64))
    n_f = z.shape[1]
    edges = range(0, n_f, block)
    mid = np.array([0.5 * (a + min(a + block, n_f) - 1) for a in edges])
    lerp = lambda v: np.interp(np.arange(n_f), mid, v)
    spec = z.mean(0)
    z = z - lerp([np.median(spec[a : a + block]) for a in edges])
    mads = []
    for a in edges:
        part = z[:, a : a + block]
        mads.append(1.4826 * np.median(np.abs(part - np.median(part))))
    sigma = lerp(mads)
    return z / np.where(np.isfinite(sigma) & (sigma > 0), sigma, float(z.std()) or 1.0)


def measures(z: np.ndarray, start: float, drift: float, snr: float) -> list[float]:
    """The array form of features.scalars, in the order of SCALARS."""
    n_t, n_f = z.shape
    at = np.rint(start + drift * np.arange(n_t)).astype(int)[:, None] - 32 + np.arange(64)
    s = np.where((at >= 0) & (at < n_f), z[np.arange(n_t)[:, None], at.clip(0, n_f - 1)], 0.0)
    p = s.mean(0)
    peak = p[31:34].max()
    low = np.flatnonzero(p <= 0.5 * max(peak, 1e-6))
    lo, hi = max(low[low < 32], default=-1), min(low[low > 32], default=64)
    on = s[:, 31:34].max(1)
    base, dev = abs(on.mean()) + 1e-3, on - on.mean()
    strong = on > 1.5
    off = s[:, 26:39].argmax(1) - 6
    var = float((dev**2).mean()) or 1e-9
    return [snr, abs(drift), float(abs(drift) < 0.02), float(hi - lo - 1), float((on > 2).mean()), float(dev.std() / base), float((dev**4).mean() / var**2), float(np.sqrt((off[strong] ** 2).mean())) if strong.sum() >= 2 else 6.0, float(np.r_[p[12:28], p[37:53]].mean() / (peak + 1e-3)), float(np.delete(s, np.s_[28:37], 1).mean()), float(on.max() / base)]


def image(z: np.ndarray, start: float, drift: float, rows: int = 16, pool: int = 4) -> np.ndarray:
    """The array form of features.images, row by row."""
    n_t, n_f = z.shape
    at = np.rint(start + drift * np.arange(n_t)).astype(int)[:, None] - 32 + np.arange(64)
    s = np.where((at >= 0) & (at < n_f), z[np.arange(n_t)[:, None], at.clip(0, n_f - 1)], 0.0)
    if n_t != rows:
        a = np.arange(rows) * n_t // rows
        s = np.stack([s[k:j].mean(0) for k, j in zip(a, np.maximum((np.arange(rows) + 1) * n_t // rows, a + 1))])
    s = s.reshape(rows, -1, pool).mean(2)
    return (s / (np.abs(s).max() + 1e-6)).ravel()


#: A row of what a classifier learns from.
EXAMPLE = "label string, drift double, " + ", ".join(f"{s} double" for s in SCALARS) + ", img array<double>"
#: Channels at either end of a window in which no test tone begins, and how far from its start it may be found.
MARGIN, NEAR_CHANNELS, NEAR_DRIFT = 4, 3, 0.5


def planted(samples: DataFrame, n_t: int, n_f: int, snrs: tuple[float, ...], drifts: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Observed samples (obs, t, c, z) with test tones: (samples, trials). Each observation comes once as it is, as cell
    0, and once for each strength and drift, with a tone of one channel that drifts upwards from a channel that
    follows from the observation's number. A tone's power over all samples is its strength times the noise of the
    observation's column sums. trials(obs, source, cell, tone_snr, tone_drift, start) says what is where; obs numbers
    observation and cell together."""
    cells = [(0.0, 0.0), *((float(s), float(d)) for s in snrs for d in drifts)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.lit(s).alias("tone_snr"), F.lit(d).alias("tone_drift")) for k, (s, d) in enumerate(cells)]))
    t = column_noise(samples, n_t).select(F.col("obs").alias("source"), "scale", each.alias("x")).select("source", "scale", "x.*")
    room = F.lit(n_f - 2 * MARGIN) - F.ceil(F.col("tone_drift") * (n_t - 1))
    start = MARGIN + F.pmod(F.col("source") * 7919 + F.col("cell") * 104729, room)
    t = kept(t.select((F.col("source") * len(cells) + F.col("cell")).alias("obs"), "source", "cell", "tone_snr", "tone_drift", start.alias("start"), (F.col("tone_snr") * F.col("scale") / n_t).alias("power")), "trials")
    on = F.col("c") == F.col("start") + F.rint(F.col("tone_drift") * F.col("t"))
    x = samples.withColumnRenamed("obs", "source").join(small(t), "source").select("obs", "t", "c", (F.col("z") + F.when(on, F.col("power")).otherwise(0.0)).alias("z"))
    return x, t.drop("power")


def _hits_of_trials(x: DataFrame, trials: DataFrame, n_t: int, n_f: int, k_max: int, threshold: float) -> DataFrame:
    """(obs, channel, drift, snr, near, and the trial's columns): near where a hit is its trial's tone."""
    h = kernel_hits(packed(x, n_t, n_f), k_max, threshold).where("channel IS NOT NULL").select(F.col("unit_id").cast("long").alias("obs"), "channel", "drift", "snr")
    close = (F.abs(F.col("channel") - F.col("start")) <= NEAR_CHANNELS) & (F.abs(F.col("drift") - F.col("tone_drift")) <= NEAR_DRIFT)
    return h.join(small(trials), "obs").withColumn("near", (F.col("cell") > 0) & close)


def recovery_trials(samples: DataFrame, n_t: int, n_f: int, k_max: int, threshold: float, snrs: tuple[float, ...], drifts: tuple[float, ...]) -> DataFrame:
    """(snr, drift, found): a row for each tone planted in each observation."""
    x, t = planted(samples, n_t, n_f, snrs, drifts)
    found = _hits_of_trials(x, t, n_t, n_f, k_max, threshold).where("near").select("obs").distinct().withColumn("found", F.lit(True))
    return t.where("cell > 0").join(found, "obs", "left").select(F.col("tone_snr").alias("snr"), F.col("tone_drift").alias("drift"), F.coalesce("found", F.lit(False)).alias("found"))


def examples(samples: DataFrame, n_t: int, n_f: int, k_max: int, threshold: float, snrs: tuple[float, ...], drifts: tuple[float, ...]) -> DataFrame:
    """Measured and labelled hits: what is found in the observations as they are is noise, a planted tone that is found
    again drifts or stands still. (hit_id, then as EXAMPLE)"""
    x, t = planted(samples, n_t, n_f, snrs, drifts)
    label = F.when(F.col("cell") == 0, "noise").when(F.col("tone_drift") == 0, "rfi_zero_drift").otherwise("technosignature_like")
    h = _hits_of_trials(x, t, n_t, n_f, k_max, threshold).where("near OR cell = 0")
    h = kept(h.select((F.col("obs") * max(n_f, 1000) + F.col("channel")).alias("hit_id"), "obs", "channel", "drift", "snr", label.alias("label")), "examples")
    v = vectors(h, snippets(h, x, n_t), n_t)
    numbers = [F.col("features")[k].alias(c) for k, c in enumerate(SCALARS)]
    return v.join(h.select("hit_id", "label", "drift"), "hit_id").select("hit_id", "label", "drift", *numbers, F.slice("features", len(SCALARS) + 1, 256).alias("img"))


def _assembled(df: DataFrame) -> DataFrame:
    """With the vector of 267 numbers: the scalars, then the image."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.concat(F.array(*[F.col(s).cast("double") for s in SCALARS]), "img")))


def train(rows: DataFrame, seed: int = 1, trees: int = 60):
    """A random forest over scalars and image; (model, label names, share right on the held-out rows). Of each label every
    fourth row, in an order by hash, is held out. The model remembers the largest snr that it was shown and, of the
    held-out rows, how many of each label it has right by band of drift."""
    from pyspark.ml.classification import RandomForestClassifier

    number = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")).cast("double") - 1
    x = _assembled(rows.select("label", "drift", *SCALARS, "img").withColumn("y", number))
    x = numbered(x, [F.xxhash64(*SCALARS, F.lit(seed)), *SCALARS], "_place", ("label",)).withColumn("out", F.col("_place") % 4 == 0)
    model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=10, seed=seed).fit(x.where("NOT out"))
    names = F.array(*map(F.lit, LABELS))
    judged = kept(model.transform(x.where("out")).select("label", "drift", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted")), "judged")
    model.snr_max = rows.agg(F.max("snr")).first()[0]
    model.recall = [tuple(r) for r in rollup.recall_by_band(judged, DRIFT_BANDS).orderBy("label", "band").collect()]  # a row a label and band
    return model, LABELS, judged.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]


#: Channels a step at which the bands of drift meet, by which a classifier is judged.
DRIFT_BANDS = (1.0, 12.0)
META = "labels array<string>, scalars array<string>, snr_max double, recall array<struct<label:string,band:int,recall:double,n:long>>"


def save(model, folder: str) -> None:
    """The model, and beside it what it says and of what."""
    model.write().overwrite().save(f"{folder}/forest")
    spark = SparkSession.active()
    spark.createDataFrame([(list(LABELS), list(SCALARS), getattr(model, "snr_max", None), getattr(model, "recall", None))], META).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load(spark: SparkSession, folder: str | None):
    """(model, None), or (None, why there is none): a model of other labels or features isn't used."""
    from pyspark.ml.classification import RandomForestClassificationModel

    if not folder:
        return None, "no model is named"
    try:
        meta = spark.read.schema(META).json(f"{folder}/meta").first()
        if tuple(meta["labels"]) != LABELS or tuple(meta["scalars"]) != SCALARS:
            return None, "the model was made for other labels or features; train a new one"
        model = RandomForestClassificationModel.load(f"{folder}/forest")
        model.snr_max, model.recall = meta["snr_max"], [tuple(r) for r in meta["recall"] or ()]
        return model, None
    except Exception as e:  # noqa: BLE001 - a search goes on without a model, and says so
        return None, f"the model can't be loaded: {type(e).__name__}"


def probabilities(model, hits: DataFrame) -> DataFrame:
    """hits with a p_ column for each label."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assembled(hits)).withColumn("p", vector_to_array("probability"))
    return out.withColumns({f"p_{name}": F.col("p")[k] for k, name in enumerate(LABELS)}).drop("features", "rawPrediction", "probability", "prediction", "p")


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def forest(x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 1) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees (Liu, Ting and Zhou 2008): random cuts of samples of the points. Of each tree's nodes the
    feature (-1: a leaf), the cut, the child below it (the one above is next) and, of leaves, the path's mean length."""
    rng, n = np.random.default_rng(seed), len(x)
    m = min(sample, n)
    top, out = math.ceil(math.log2(max(m, 2))), []
    for _ in range(trees):
        nodes = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rng.choice(n, m, replace=False), 0)]
        while todo:
            k, inside, depth = todo.pop()
            spread = np.ptp(x[inside], axis=0) if len(inside) else np.zeros(x.shape[1])
            if depth >= top or len(inside) < 2 or not spread.any():
                nodes[k][3] = depth + _path(len(inside))
                continue
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(x[inside, f].min(), x[inside, f].max()))
            nodes[k][:3] = f, cut, len(nodes)
            below = x[inside, f] < cut
            todo += [(len(nodes), inside[below], depth + 1), (len(nodes) + 1, inside[~below], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        f, cut, child, path = zip(*nodes)
        out.append((np.array(f), np.array(cut), np.array(child), np.array(path) / (_path(m) or 1.0)))
    return out


def isolation(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """How early random cuts part each point from a sample; 0 to 1."""
    total = np.zeros(len(x))
    for f, cut, child, path in trees:
        at = np.zeros(len(x), np.int64)
        while len(more := np.flatnonzero(f[at] >= 0)):
            k = at[more]
            at[more] = child[k] + (x[more, f[k]] >= cut[k])
        total += path[at]
    return 2.0 ** (-total / len(trees))


def isolation_scores(x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 1) -> np.ndarray:
    return isolation(forest(x, trees, sample, seed), x)


def anomalies(hits: DataFrame, key: str = "run", least: int = 20, most: int = 4096) -> DataFrame:
    """hits(hit_id, run, scalars) with anomaly, 0 to 1 within each run; null in runs of fewer than `least`. A run's trees
    are grown from at most about `most` of its hits, chosen by hash; then all hits are scored where they are."""
    kinds = dict(hits.dtypes)
    x = hits.select("hit_id", F.col(key).alias("run"), *[F.col(s).cast("double").alias(s) for s in SCALARS])
    n = x.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    some = x.join(n, "run").where(F.pmod(F.xxhash64("hit_id", F.lit(5)), F.lit(1 << 20)) < F.lit(float(most << 20)) / F.col("n"))

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("hit_id")
        p = np.column_stack([t.column(s).to_numpy(zero_copy_only=False) for s in SCALARS])
        mid, scale = np.median(p, 0), p.std(0) + 1e-9
        return pa.table({"run": t.column("run")[:1], "trees": pa.array([pickle.dumps((mid, scale, forest(np.nan_to_num((p - mid) / scale))))], pa.binary())})

    trees = some.groupBy("run").applyInArrow(grow, f"run {dict(x.dtypes)['run']}, trees binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            runs = np.array([-1 if r is None else r for r in batch.column(1).dictionary_encode().indices.to_pylist()])
            names = batch.column(1).dictionary_encode().dictionary.to_pylist()
            p = np.column_stack([batch.column(3 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(SCALARS))])
            for k, name in enumerate(names):
                of = np.flatnonzero(runs == k)
                if not batch.column(2)[int(of[0])].is_valid:
                    continue
                if name not in held:
                    if len(held) > 16:
                        held.clear()
                    held[name] = pickle.loads(batch.column(2)[int(of[0])].as_py())
                mid, scale, made = held[name]
                out[of] = isolation(made, np.nan_to_num((p[of] - mid) / scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, mask=np.isnan(out))], names=["hit_id", "run", "s"])

    joined = x.join(trees, "run", "left").select("hit_id", "run", "trees", *SCALARS)
    raw = joined.mapInArrow(score, f"hit_id {kinds['hit_id']}, run {dict(x.dtypes)['run']}, s double")
    ends = raw.groupBy("run").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return raw.join(ends, "run").select("hit_id", ((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("anomaly"))
