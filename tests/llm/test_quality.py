import zlib

import numpy as np

from skydrift.llm import quality

from .conftest import docs, table, with_clashes


def mixed(spark, n=240):
    rng = np.random.default_rng(0)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "un") for b in ("ra", "ven", "sol", "di", "pek", "tor")]
    good = lambda k: " ".join(rng.choice(vocab, k)) + "."
    bad = lambda k: " ".join(w.upper() + "!!" for w in rng.choice(vocab, k))
    texts = [good(60) if i % 4 else bad(60) for i in range(n)]
    return docs(spark, texts), spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    d, labels = mixed(spark)
    got = {r["doc_id"]: r for r in quality.score(with_clashes(d), labels).collect()}
    out = [r for i, r in got.items() if r["held_out"]]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(bool(r["doc_id"] % 4)) for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_never_learns_from_held_out_rows(spark):
    d, labels = mixed(spark)
    flipped = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["quality"], 0) for r in labels.collect()], labels.schema)
    assert quality.train(d, labels) == quality.train(d, flipped)


def test_keep_good_and_edges(spark):
    d, labels = mixed(spark)
    kept = quality.keep_good(with_clashes(d), labels)
    ids = [r["doc_id"] for r in kept.collect()]
    assert "_score" in kept.columns and all(sum(i % 4 == k for i in ids) > 50 for k in (1, 2, 3)) and sum(i % 4 == 0 for i in ids) < 5
    odd = table(spark, [(None, "x", None, None, None), (1, None, None, None, None), (2, "", None, None, None), (2, "ab " * 60_000, None, None, None)])
    got = quality.score(odd, labels, quality.train(d, labels)).collect()
    assert len(got) == 4 and all(r["score"] is not None for r in got)
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(table(spark, []), labels).collect() == []


def test_labels_of_null_quality_and_without_documents(spark):
    d, labels = mixed(spark)
    more = labels.union(spark.createDataFrame([(1, None, 0), (None, 1, 0), (10**6, 0, 0)], labels.schema))
    assert quality.score(d, more).count() == d.count()


def test_scores_against_plain_steps(spark):
    """Each block compressed by itself with either dictionary, and the logistic curve by hand."""
    import math

    import zstandard

    d, labels = mixed(spark)
    model = quality.train(d, labels)
    for r in quality.score(d, labels, model).join(d.select("doc_id", "text"), "doc_id").collect():
        raw, sums = r["text"].encode(), []
        for blob in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(blob), write_content_size=False, write_dict_id=False)
            sums.append(sum(len(c.compress(raw[i : i + model.block])) for i in range(0, len(raw), model.block)))
        g, b = sums
        x, y, n = (b - g) / (b + g), math.log((g + 8) / (len(raw) + 8)), math.log1p(len(raw))
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], (x, y, y * y, x * y, x * x, n), model.mean, model.scale))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 0.02  # prepared dictionaries may choose other matches


def test_learns_from_whole_texts(spark):
    """What tells good from bad begins after 20,000 bytes that all texts share."""
    rng = np.random.default_rng(1)
    same = " ".join(f"w{x}" for x in rng.integers(0, 5000, 4000))
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("ra", "ven", "sol", "di")]
    texts = [same + " " + " ".join(w if i % 2 else w.upper() + "!!" for w in rng.choice(vocab, 6000)) for i in range(60)]
    d = docs(spark, texts)
    got = quality.score(d, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_rows_that_come_very_often(spark):
    from pyspark.sql import functions as F

    d, labels = mixed(spark)
    many = labels.crossJoin(spark.range(400)).drop("id").unionByName(labels)
    assert quality.train(d, many) == quality.train(d, labels)
    often = d.where("doc_id = 1").crossJoin(spark.range(30_000)).drop("id").select(d.columns).unionByName(d)
    model = quality.train(often, labels, dictionary_bytes=64 << 10)
    assert len(model.good) <= 64 << 10 and quality.score(d, labels, model).where(F.col("score").isNull()).count() == 0
