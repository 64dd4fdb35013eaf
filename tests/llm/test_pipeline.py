import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from skydrift.llm import mixing, quality, queries

from .conftest import SF
from .test_decontaminate import brute as brute_hits
from .test_near_dedup import brute as brute_classes


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        before, after = [r.asDict() for r in docs.collect()], kept[name].collect()
        ids = [r["doc_id"] for r in after]
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert sorted(ids) == sorted(i for i, p in scores.items() if p)
        elif name == "near_dedup":
            before.sort(key=lambda r: r["doc_id"])
            assert sorted(ids) == sorted({before[c]["doc_id"] for c in brute_classes([r["text"] for r in before])})
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = brute_hits([r["text"] for r in before], items)
            assert sorted(ids) == sorted(r["doc_id"] for r, h in zip(before, hit) if not h[5])
        elif name == "mixing":
            plan = {r["doc_id"]: r["taken"] for r in mixing.plan(spark, docs, corpus_pipeline.RECIPE).collect()}
            got = {}
            for r in after:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
            assert {i: n for i, n in plan.items() if n} == {i: n for i, n in got.items() if n}
        docs = kept[name]
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0], r[1].encode()))
    for r, (i, text) in zip(rows, want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_registered():
    assert [f"op{n}_" for n in range(1, 13)] == [q[: q.index("_") + 1] for q in queries.queries()]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and long texts, extra columns with clashing names, no rows."""
    from pyspark.sql import functions as F

    from .conftest import table, with_clashes

    good = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = [(None, None, None, None, None), (None, "some words without an id", "en", None, 24), (10**9, "", None, "src1", 0), (10**9, None, "en", "src1", None), (10**9 + 1, "same id, first text of the two", None, None, 30), (10**9 + 1, "same id, another text", "xx", "odd source", 20), (10**9 + 2, "long " * 300_000, "en", "src2", 1_500_000)]
    odd = table(spark, rows)
    for label, docs in (("odd", with_clashes(good.unionByName(odd).unionByName(odd))), ("none", with_clashes(odd.limit(0)))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            names = docs.columns
            out = stage(spark, docs, SF)
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
            out.write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
            if label == "odd" and name == "near_dedup":
                assert docs.where("doc_id IS NOT NULL").groupBy("doc_id", "text").count().where("count > 1").isEmpty()
        n = docs.count()
        assert (n == 0) == (label == "none")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n
