import pytest
from pyspark.sql import functions as F

from skydrift.operators import score
from skydrift.operators.ordering import numbered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_value_that_most_rows_have(spark):
    df = spark.range(5000).select(F.col("id").alias("hit_id"), F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id") * 0.25).alias("interest"))
    got = [(r["hit_id"], r["rank"]) for r in score.ranked(df).collect()]
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    assert dict(got) == {hit: k for k, (hit, _) in enumerate(rows, 1)} and len(got) == 5000
    assert "SinglePartition" not in plan(score.ranked(df)) and "Window" not in plan(score.ranked(df))


def test_ranges_split_equal_values(spark):
    """No task holds the rows of a value that a third of all have."""
    df = spark.range(9000).select(F.col("id").alias("hit_id"), (F.col("id") % 3 == 0).cast("int").alias("interest"))
    out = numbered(df, [F.desc("interest"), "hit_id"], parts=16)
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1500 and sum(sizes) == 9000


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_within_keys(spark, parts):
    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else f"k{i}", (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "target string, x int")
    got = {(r["target"], r["x"]): r["place"] for r in numbered(df, ["x"], "place", ("target",), parts).collect()}
    seen = {}
    for t, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen[t] = seen.get(t, 0) + 1
        assert got[(t, x)] == seen[t]


def test_nulls_come_last_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan")), (4, 9.0)], "hit_id long, interest double")
    assert [r["hit_id"] for r in score.ranked(df).orderBy("rank").collect()] == [3, 4, 2, 1]
    assert score.ranked(df.limit(0)).count() == 0 and score.ranked(df.limit(0)).columns == ["hit_id", "interest", "rank"]
