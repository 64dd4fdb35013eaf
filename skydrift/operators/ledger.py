"""What a long search remembers: done, failed and partly searched observations, signals, and which to take next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIVE_UP, PER_OBSERVATION, OVERALL = 3, 2000, 50_000


def given_up(failures: DataFrame, after: int = GIVE_UP) -> DataFrame:
    """Observations that have failed often enough to be left alone."""
    return failures.groupBy("obs").agg(F.count("*").alias("attempts")).where(F.col("attempts") >= after)


def skip_set(done: DataFrame, failures: DataFrame) -> DataFrame:
    return done.select("obs").union(given_up(failures).select("obs")).distinct()


def not_skipped(observations: DataFrame, skip: DataFrame) -> DataFrame:
    return observations.join(skip, "obs", "left_anti")


def widened(rows: DataFrame, done: DataFrame, partial: DataFrame, limit: int, most: int = 2000) -> DataFrame:
    """Up to `limit` rows(obs, place) not done. The query grows from `limit` fourfold, to `most` at the most, until
    it holds enough new rows and, of these, half as many that weren't begun; half the places go to such rows,
    then the begun ones, then others. Counts are taken at each size at once, so there is no loop of queries."""
    half = (limit + 1) // 2
    sizes, n = [], limit
    while True:
        sizes.append(n)
        if n >= most:
            break
        n = min(n * 4, most)
    new = rows.join(done.select("obs"), "obs", "left_anti").join(partial.select("obs", F.lit(True).alias("begun")).distinct(), "obs", "left").withColumn("begun", F.coalesce("begun", F.lit(False)))
    counts = new.agg(*[F.count_if(F.col("place") <= s).alias(f"n{s}") for s in sizes], *[F.count_if((F.col("place") <= s) & ~F.col("begun")).alias(f"f{s}") for s in sizes])
    total = rows.agg(F.count("*").alias("total"))
    size = F.lit(sizes[-1])
    for s in reversed(sizes):
        size = F.when(((F.col(f"n{s}") >= limit) & (F.col(f"f{s}") >= half)) | (F.col("total") < s), s).otherwise(size)
    at = counts.join(total).select(size.alias("size"))
    got = new.join(F.broadcast(at)).where("place <= size")  # one row
    kind = Window.partitionBy("begun").orderBy("place")
    ranked = got.withColumn("r", F.row_number().over(kind)).where(F.col("r") <= limit)
    # the first half of the fresh ones, the begun ones, the rest of the fresh ones
    stage = F.when(~F.col("begun") & (F.col("r") <= half), 0).when(F.col("begun"), 1).otherwise(2)
    ordered = ranked.withColumn("stage", stage).withColumn("slot", F.row_number().over(Window.orderBy("stage", "r")))
    return ordered.where(F.col("slot") <= limit).select("obs", "begun", "slot")


def next_range(progress: DataFrame, units_a_visit: int, width: int) -> DataFrame:
    """progress(obs, nchans, cursor): the channels to search on the next visit."""
    step = units_a_visit * width
    x = progress.withColumn("start", F.coalesce("cursor", F.lit(0)))
    return x.where(F.col("start") < F.col("nchans")).select("obs", "start", F.least(F.col("start") + step, F.col("nchans")).alias("stop"))


def advanced(progress: DataFrame, visited: DataFrame) -> DataFrame:
    """Cursors after visits(obs, stop, errors); a visit with errors doesn't move its cursor."""
    moved = visited.groupBy("obs").agg(F.max(F.when(F.col("errors") == 0, F.col("stop"))).alias("to"))
    x = progress.join(moved, "obs", "left").withColumn("cursor", F.greatest(F.coalesce("cursor", F.lit(0)), F.coalesce("to", F.lit(0))))
    return x.select("obs", "nchans", "cursor", (F.col("cursor") >= F.col("nchans")).alias("done"))


def remembered(signals: DataFrame, per_obs: int = PER_OBSERVATION, overall: int = OVERALL) -> DataFrame:
    """signals(obs, seq, rank, frequency_mhz, target): the first of each observation, of these the last overall."""
    return signals.where(F.col("rank") <= per_obs).orderBy(F.desc("seq"), F.desc("rank"), F.desc("obs")).limit(overall)


def lifetime_best(results: DataFrame, version: str) -> DataFrame:
    """The best row ever under this scoring version; of equal ones the earliest."""
    return results.where(F.col("scoring_version") == version).groupBy("scoring_version").agg(F.max_by(F.struct("obs", "interest"), F.struct("interest", -F.col("seq"))).alias("b")).select("scoring_version", "b.obs", "b.interest")


def cache_key(columns: list[str]) -> Column:
    return F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def misses(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Units whose key the cache doesn't hold."""
    return units.join(cache.select("key"), "key", "left_anti")


def results_version(cfg: dict, code: str, model: str = "none") -> str:
    """Names what results depend on; cached ones under another name are passed over."""
    import hashlib
    import json

    return f"{code}:{model}:{hashlib.sha1(json.dumps(cfg, sort_keys=True).encode()).hexdigest()[:12]}"


def probed(cache: dict, key: str, probe, now: float, keep_hours: float = 24.0):
    """probe(key), or what it gave within the last hours; cache maps keys to [time, value]."""
    if key not in cache or now - cache[key][0] > keep_hours * 3600:
        cache[key] = [now, probe(key)]
    return cache[key][1]
