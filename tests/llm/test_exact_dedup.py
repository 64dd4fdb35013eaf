import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from skydrift.llm import exact_dedup

from .conftest import docs, stored, table, with_clashes


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: (len(m[1]), -m[0]))
        done = False
        for i, t in members:
            kept = (i, t) == keep and not done
            done |= kept
            out.append((i, keep[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


TEXTS = ["a b", "ab", "a\tb\n", None, "", "  ", "ab c", "é ", "é", "x" * 200_000, "x" * 200_000 + " ", "a b", "ab"]


def test_against_brute_force(spark, tmp_path):
    path = stored(spark, with_clashes(docs(spark, TEXTS)), tmp_path / "d.parquet")
    got = sorted(tuple(r) for r in exact_dedup.dedup(spark, path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute(list(enumerate(TEXTS)))


def test_equal_digests_of_different_texts_are_told_apart(spark, tmp_path):
    path = stored(spark, docs(spark, TEXTS), tmp_path / "d.parquet")
    weak = lambda norm: F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, 0)  # noqa: E731 - all the same
    got = exact_dedup.dedup(spark, path, digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [x[:4] for x in brute(list(enumerate(TEXTS)))]


def test_state_goes_on(spark, tmp_path):
    docs(spark, ["one", "two"]).write.parquet(str(tmp_path / "d.parquet"))
    path, state = str(tmp_path / "d.parquet"), f"file://{tmp_path}/state"
    exact_dedup.ingest(spark, path, state).count()
    docs(spark, ["o n e", "three"], first=10).write.mode("append").parquet(path)
    groups = {r["keep_id"]: r["group_size"] for r in exact_dedup.ingest(spark, path, state).collect()}
    assert groups == {1: 1, 10: 2, 11: 1}
    assert sorted(r["group_size"] for r in exact_dedup.ingest(spark, path, state).collect()) == [1, 1, 2]


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(None, "a", None, None, None), (5, "a", None, None, None), (5, "a", None, None, None), (None, "zz", None, None, None)]
    path = stored(spark, table(spark, rows), tmp_path / "d.parquet")
    got = exact_dedup.dedup(spark, path).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in got) == [(0, 0, 1), (0, 5, 3), (5, 5, 3), (5, 5, 3)]
    assert sum(r["kept"] for r in got) == 2
    path = stored(spark, table(spark, []), tmp_path / "e.parquet")
    assert exact_dedup.dedup(spark, path).collect() == []


def test_ids_of_any_type_and_size(spark, tmp_path):
    low, high = -(2**63), 2**63 - 1
    path = stored(spark, docs(spark, ["a", "b"]).selectExpr("CASE WHEN doc_id = 0 THEN {} ELSE {} END AS doc_id".format(f"CAST('{low}' AS BIGINT)", f"CAST('{high}' AS BIGINT)"), "'same' AS text"), tmp_path / "d.parquet")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.dedup(spark, path).collect()} == {(low, low, True), (high, low, False)}
    path = stored(spark, spark.createDataFrame([("x2", "same"), ("x10", "sa me"), ("x3", "same"), (None, "same")], "doc_id string, text string"), tmp_path / "s.parquet")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.dedup(spark, path).collect()} == {(i, "x10") for i in ("x2", "x10", "x3", None)}
