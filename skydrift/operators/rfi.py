"""Interference: known bands, mirror images, other targets, ON/OFF cadences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, half_even
from .blocks import with_halo
from .mirror import images
from .rangejoin import bucketed

#: Channels of a stretch, and hits of a task's part, in which mirror images are looked for.
STRETCH, PART = 256, 1 << 16


def mirror_channel(nfine: int, channel: str = "channel") -> Column:
    """Where the image of a channel about its coarse channel's centre lies."""
    dc = F.floor(F.col(channel) / nfine) * nfine + nfine // 2
    return (dc * 2 - F.col(channel)).cast("long")


def mirror_pairs(hits: DataFrame, tol: int = 3, ratio: float = 2.0) -> DataFrame:
    """hits(hit_id, file, channel, mirror_channel, drift, snr) with mirror_pair and mirror_image.

    A hit pairs with another of its file that lies within tol whole channels of its image with the opposite drift. Both
    are images where their strengths are alike (within a ratio, 1 at least), else the weaker one is. Hits are dealt by
    stretches of channels; there each finds the strongest of its partners by searching, so no pairs are made."""
    x = [F.col("drift").cast("double").alias("drift"), F.col("snr").cast("double").alias("snr"), "hit_id"]
    side = lambda df, at, asks: df.where(F.col("file").isNotNull() & F.col(at).isNotNull() & F.col("drift").isNotNull() & F.col("hit_id").isNotNull()).select(F.lit(asks).alias("asks"), "file", F.col(at).cast("long").alias("at"), *x)
    asking = with_halo(side(hits.where("mirror_channel >= 0"), "mirror_channel", True), F.col("at"), STRETCH, tol, tol).drop("_own")
    asked = side(hits, "channel", False).withColumn("_block", F.floor(F.col("at") / STRETCH))
    parts = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), hits.count() // PART)
    dealt = asking.unionByName(asked).withColumn("_part", F.pmod(F.xxhash64("file", "_block"), F.lit(parts))).drop("_block")
    found = dealt.groupBy("_part").applyInArrow(images(tol, ratio), f"hit_id {dict(hits.dtypes)['hit_id']}, image boolean")
    marks = found.groupBy("hit_id").agg(F.bool_or("image").alias("mirror_image"), F.lit(True).alias("mirror_pair"))
    return hits.join(marks, "hit_id", "left").withColumns({"mirror_pair": flag("mirror_pair"), "mirror_image": flag("mirror_image")})


def multi_target(hits: DataFrame, seen: DataFrame, tol_khz: float = 2.0, band_khz: float = 25.0, band_hits: int = 2, asked: DataFrame | None = None) -> DataFrame:
    """hits(hit_id, target, frequency_mhz, interest) with multi_target: another target had a signal within
    tol_khz, or band_hits within band_khz; such hits keep a fifth of their interest. asked(target, frequency_mhz), if
    given, has all that hits have, from where they cost less to read.

    `seen` is first summed by frequency and target, and hits of one target and frequency ask once. Frequencies are dealt in
    blocks with a halo. A hit with another target in its bin of tol_khz, all of which lies within tol_khz of it, is settled.
    Others send probes to the ends of their ranges; how many lie between them is the difference of running counts
    over all targets, less that of their own. So no pairs are made."""
    tol, band = tol_khz / 1e3, band_khz / 1e3
    near, reach = min(tol, band), max(band * 1.01, 1e-9)
    f, t, n = F.col("frequency_mhz"), F.col("target"), F.col("n")
    of = lambda df, n, asks: df.where(f.isNotNull() & t.isNotNull()).select("target", "frequency_mhz", F.lit(n).cast("long").alias("n"), F.lit(asks).alias("asks"))
    asked = hits if asked is None else asked
    cells = of(seen, 1, True) if asked is seen else of(seen, 1, False).unionByName(of(asked, 0, True))
    cells = cells.groupBy("target", "frequency_mhz").agg(F.sum("n").alias("n"), F.bool_or("asks").alias("asks"))
    x = with_halo(cells, f, 16 * reach, reach, reach).withColumn("_bin", F.floor(f / near) if near > 0 else f)
    # as searches in sorted frequencies have it: at f - tol or above, and at f + tol or below
    same = Window.partitionBy("_block", "_bin")
    least, most = lambda c: F.min(F.when(n > 0, c)).over(same), lambda c: F.max(F.when(n > 0, c)).over(same)
    settled = (least(f) >= f - near) & (most(f) <= f + near) & ((least(t) != t) | (most(t) != t))
    x = x.withColumn("settled", F.coalesce(settled, F.lit(False))).withColumn("asks", F.col("asks") & F.col("_own"))
    row = lambda pos, side, wide, n: F.struct(pos.alias("pos"), F.lit(side).alias("side"), F.lit(wide).alias("wide"), n.alias("m"))
    none = F.lit(0).cast("long")
    point, probes = row(f, 0, False, n), [row(f + side * w, side, wide, none) for w, wide in ((near, False), (band, True)) for side in (-1, 1)]
    x = x.select("_block", "target", "frequency_mhz", "asks", "settled", F.explode(F.when(F.col("asks") & ~F.col("settled"), F.array(point, *probes)).otherwise(F.array(point))).alias("x"))
    x = x.select("_block", "target", "frequency_mhz", "asks", "settled", "x.*")
    upto = lambda *by: F.sum("m").over(Window.partitionBy("_block", *by).orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("others", F.col("side") * (upto() - upto("target"))).where((F.col("side") != 0) | (F.col("asks") & F.col("settled")))
    many = lambda wide: F.sum(F.when(F.col("wide") == wide, F.col("others")).otherwise(0))
    found = x.groupBy("_block", "target", "frequency_mhz").agg((F.bool_or("settled") | (many(False) > 0) | (many(True) >= max(band_hits, 1))).alias("multi_target")).drop("_block")
    marked = hits.drop("multi_target").join(found, ["target", "frequency_mhz"], "left").select(*[c for c in hits.columns if c != "multi_target"], F.coalesce("multi_target", F.lit(False)).alias("multi_target"))
    return marked.withColumn("interest", F.when(F.col("multi_target"), half_even(F.col("interest") * 0.2, 1)).otherwise(F.col("interest")))


def testable(scans: DataFrame, keys: tuple[str, ...] = ("cadence",), min_on: int = 2) -> DataFrame:
    """scans(keys, name, is_on): whether ON and OFF scans suffice for a test, and why or why not."""
    n = scans.groupBy(*keys).agg(F.count_if("is_on").alias("n_on"), F.count_if(~F.col("is_on")).alias("n_off"))
    why = F.when(F.col("n_on") < min_on, F.format_string("only %d ON scan(s); a test needs %d", "n_on", F.lit(min_on))).when(F.col("n_off") == 0, F.lit("no OFF scan")).otherwise(F.format_string("%d ON / %d OFF scans", "n_on", "n_off"))
    return n.withColumn("testable", (F.col("n_on") >= min_on) & (F.col("n_off") > 0)).withColumn("reason", why)


def cadence_events(scans: DataFrame, hits: DataFrame, tol_hz: float = 20.0, slope_s: float = 60.0, min_on_fraction: float = 1.0, min_on: int = 2, reference: str | None = None) -> DataFrame:
    """Hits of the reference scan (the first ON one, or that of the given name) that come again where their
    drift takes them in enough ON scans, and in no OFF scan.

    scans(name, mjd, is_on); hits(hit_id, name, frequency_mhz, drift_rate_hz_s). The scans of a cadence are a
    handful, so they are broadcast; hits meet by scan and frequency bucket."""
    w = Window.orderBy("mjd", "name")  # a handful of rows
    s = scans.withColumn("place", F.row_number().over(w))
    ons = s.where("is_on").join(hits.select("name").distinct(), "name", "left").join(hits.groupBy("name").agg(F.count("*").alias("n_hits")), "name", "left")
    first = ons.agg(F.min_by(F.struct("name", "mjd", F.coalesce("n_hits", F.lit(0)).alias("n_hits")), "place").alias("f"), F.count("*").alias("n_on"))
    named = ons.where(F.col("name") == F.lit(reference)).agg(F.max(F.struct("name", "mjd")).alias("g"))
    ref = first.join(named).where("f.n_hits > 0").select(F.coalesce("g.name", "f.name").alias("ref"), F.coalesce("g.mjd", "f.mjd").alias("t0"), "n_on")
    n_off = s.agg(F.count_if(~F.col("is_on")).alias("n_off"))
    ref = ref.join(n_off).where((F.col("n_on") >= min_on) & (F.col("n_off") > 0))
    others = s.join(ref).where("name <> ref").select(F.col("name").alias("scan"), "is_on", "place", ((F.col("mjd") - F.col("t0")) * 86400.0).alias("dt"))
    mine = hits.join(F.broadcast(ref), hits["name"] == ref["ref"]).select("hit_id", "frequency_mhz", F.col("drift_rate_hz_s").alias("rate"), "n_on", "n_off")
    asks = mine.join(F.broadcast(others)).withColumn("pred", F.col("frequency_mhz") + F.col("rate") * F.col("dt") / 1e6).withColumn("tol", (F.lit(tol_hz) + F.abs("rate") * slope_s) / 1e6)
    widest = asks.agg(F.max("tol")).first()[0] or 1e-6
    h = hits.select(F.col("name").alias("h_scan"), F.col("frequency_mhz").alias("hf"), F.col("drift_rate_hz_s").alias("hr"))
    like = ~F.col("is_on") | (F.abs(F.col("hr") - F.col("rate")) <= F.greatest(F.lit(0.2), F.abs("rate") * 0.5))
    met = bucketed(asks.select("hit_id", "scan", "is_on", "place", "pred", "tol", "rate"), h, F.col("pred"), F.col("hf"), widest, (F.abs(F.col("hf") - F.col("pred")) <= F.col("tol")) & like, ((F.col("scan"), F.col("h_scan")),))
    met = met.select("hit_id", "scan", "is_on", "place").distinct().groupBy("hit_id").agg(F.count_if("is_on").alias("on_found"), F.count_if(~F.col("is_on")).alias("off_found"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_on"), F.struct("place", "scan")))), lambda x: x["scan"]), ";").alias("matched_in"))
    out = mine.join(met, "hit_id", "left").withColumn("on_scans_matched", F.coalesce("on_found", F.lit(0)) + 1)
    out = out.where((F.col("on_scans_matched") / F.col("n_on") >= min_on_fraction) & (F.coalesce("off_found", F.lit(0)) == 0))
    return out.select("hit_id", "frequency_mhz", F.col("rate").alias("drift_rate_hz_s"), "on_scans_matched", F.col("n_on").alias("n_on_scans"), F.col("n_off").alias("off_scans_checked"), F.coalesce("matched_in", F.lit("")).alias("matched_in"), F.lit("passed_cadence").alias("status"))


def apply_cadence(hits: DataFrame, events: DataFrame | None, status: str = "tested", tol_hz: float = 50.0) -> DataFrame:
    """hits with cadence; a tested hit near no event failed, and keeps a fifth of its interest."""
    if status != "tested" or events is None:
        return hits.withColumn("cadence", F.lit(status))
    tol = tol_hz / 1e6
    ev = events.select(F.col("frequency_mhz").alias("ef")).distinct()
    passed = bucketed(hits.select("hit_id", "frequency_mhz"), ev, F.col("frequency_mhz"), F.col("ef"), tol, F.abs(F.col("frequency_mhz") - F.col("ef")) <= tol, how="left_semi").select("hit_id", F.lit(True).alias("_passed"))
    out = hits.join(passed, "hit_id", "left").withColumn("cadence", F.when(flag("_passed"), "passed").otherwise("failed")).drop("_passed")
    return out.withColumn("interest", F.when(F.col("cadence") == "failed", half_even(F.col("interest") * 0.2, 1)).otherwise(F.col("interest")))


def truth_join(injected: DataFrame, hits: DataFrame, n_t: int) -> DataFrame:
    """For each injected tone the best rank of a hit within the channels it drifts through, and 4 more. Of a channel's hits
    only the best can be it, and tones of equal start and drift ask once, so pairs are made of channels, not of hits."""
    cond = F.abs(F.col("channel") - F.col("start_channel")) <= F.abs(F.col("true_drift") * n_t) + 4
    width = injected.agg(F.max(F.abs(F.col("true_drift") * n_t) + 4)).first()[0] or 1.0
    asked = injected.select("start_channel", "true_drift").distinct()
    met = bucketed(asked, hits.groupBy("channel").agg(F.min("rank").alias("rank")), F.col("start_channel"), F.col("channel"), float(width), cond)
    found = met.groupBy("start_channel", "true_drift").agg(F.min("rank").alias("best_rank"))
    best = injected.join(found, ["start_channel", "true_drift"]).groupBy("tone_id").agg(F.min("best_rank").alias("best_rank"))
    return injected.join(best, "tone_id", "left")


def nearest(hits: DataFrame, places: DataFrame) -> DataFrame:
    """For each place (place_id, file, at) the hit of its file that lies nearest; of equal ones the first. In order of
    channel that is the last hit before the place or the first one after it, so no pairs are made."""
    one = hits.groupBy("file", F.col("channel").alias("at")).agg(F.min("hit_id").alias("hit_id"))
    both = places.select("file", "at", "place_id", F.lit(None).cast(dict(one.dtypes)["hit_id"]).alias("hit_id")).unionByName(one.withColumn("place_id", F.lit(None).cast(dict(places.dtypes)["place_id"])))
    hit = F.when(F.col("hit_id").isNotNull(), F.struct("at", "hit_id"))
    order = Window.partitionBy("file").orderBy("at", F.col("hit_id").isNull())
    before, after = F.last(hit, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.last(hit, True).over(Window.partitionBy("file").orderBy(F.desc("at"), F.col("hit_id").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    far = lambda h: F.when(h.isNotNull(), F.struct(F.abs(h["at"] - F.col("at")).alias("off"), h["hit_id"].alias("hit_id")))
    x = both.withColumn("before", before).withColumn("after", after).where("place_id IS NOT NULL").withColumn("m", F.least(far(F.col("before")), far(F.col("after")))).where("m IS NOT NULL")
    return x.groupBy("place_id").agg(F.min("m").alias("m")).select("place_id", F.col("m.hit_id").alias("hit_id"), F.col("m.off").alias("distance"))
