import pytest

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, first=0):
    return table(spark, [(first + i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)])


def stored(spark, df, path):
    """A folder of Parquet files, as the queries read them."""
    df.repartition(2).write.mode("overwrite").parquet(str(path))
    return str(path)


#: Columns that the operators might want to use themselves.
CLASHES = ("id", "node", "class_id", "n", "c0", "key", "score", "items", "runs", "tokens", "digest", "value", "_score", "domain", "band")


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
