"""The ledger as keyed state of a stream: what is known of each observation, kept up to date visit by visit.

State lies in RocksDB on the executors and is checkpointed with the stream; it never expires. Each observation has how
far its search has come, how often it failed, and its best signal under the newest version of the scoring: a newer
version drops what an older one found. All of that are counts and maxima, so the state is a streaming aggregation's: rows
of an observation are summed up before they are exchanged, and no Python runs for a key.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import GIVE_UP

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LEDGER = "obs string, visits long, reach long, nchans long, failures long, done boolean, given_up boolean, version string, interest double, seq long"


def folded(visits: DataFrame) -> DataFrame:
    """visits(obs, seq, stop, nchans, errors, version, interest) to the ledger's rows. A visit with errors is a failure and
    moves nothing; null interest is no signal; of equally interesting signals the one of the earliest visit counts."""
    good, interest = F.coalesce(F.col("errors"), F.lit(0)) <= 0, F.col("interest").cast("double")
    signal = good & interest.isNotNull() & ~F.isnan(interest) & F.col("version").isNotNull()
    best = F.max(F.when(signal, F.struct("version", interest.alias("interest"), (-F.col("seq")).alias("neg")))).alias("best")
    most = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).cast("long")
    x = visits.groupBy(F.col("obs").cast("string").alias("obs")).agg(
        F.count("*").alias("visits"), most(F.when(good, F.col("stop"))).alias("reach"), most(F.col("nchans")).alias("nchans"), F.count_if(~good).alias("failures"), F.max("version").alias("version"), best)
    new = F.col("best.version") == F.col("version")  # a newer version drops what an older one found
    return x.select("obs", "visits", "reach", "nchans", "failures", ((F.col("nchans") > 0) & (F.col("reach") >= F.col("nchans"))).alias("done"), (F.col("failures") >= GIVE_UP).alias("given_up"),
        "version", F.when(new, F.col("best.interest")).alias("interest"), F.when(new, -F.col("best.neg")).cast("long").alias("seq"))


@contextlib.contextmanager
def store(spark: SparkSession):
    """The state store that keyed state needs, for the queries that are started meanwhile."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(visits: DataFrame, out: str) -> None:
    """Takes what is new of a stream of visits into the state, and writes the rows that changed below out, by batch."""
    rows = folded(visits)
    with store(visits.sparkSession):
        w = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/changes/batch={n}"))
        w.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each observation. visits only grow, so it is the one with most."""
    changes = spark.read.schema(LEDGER).parquet(f"{out}/changes")
    return changes.groupBy("obs").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("obs", "batch")]), "visits").alias("x")).select("obs", "x.*")
