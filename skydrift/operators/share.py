"""Findings: checklists, the gate, identifiers, and what goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, flag

CHECKS = ("drifts", "narrowband", "steady", "outside_bands", "no_mirror", "one_target", "cadence", "cross_checked", "reobserved")


def checklist() -> dict[str, Column]:
    """Nine tri-state checks of a candidate; null: can't be said."""
    return {
        "drifts": F.when(flag("drift_unresolved"), None).otherwise(~flag("stationary")),
        "narrowband": F.coalesce(F.col("bandwidth_ch") <= 4, F.lit(False)),
        "steady": F.coalesce(F.col("on_fraction") >= 0.75, F.lit(False)),
        "outside_bands": ~flag("known_rfi_band"),
        "no_mirror": ~flag("mirror_image"),
        "one_target": ~flag("multi_target"),
        "cadence": F.when(F.col("cadence") == "not_run", None).otherwise(F.col("cadence") == "passed"),
        "cross_checked": F.lit(None).cast("boolean"),
        "reobserved": F.lit(None).cast("boolean"),
    }


def gate(require_cadence: bool = False) -> Column:
    """The first reason not to share, or "ok"."""
    c = checklist()
    out = (
        F.when(c["drifts"].isNull(), "drift not measurable")
        .when(~c["drifts"], "zero drift")
        .when(~c["outside_bands"], "known band")
        .when(~c["no_mirror"], "mirror image")
        .when(~c["one_target"], "another target")
    )
    if require_cadence:
        out = out.when(F.col("cadence") != "passed", F.concat(F.lit("cadence "), F.col("cadence")))
    return out.otherwise("ok")


def finding_id(data_key: Column, prefix: str = "AIS-") -> Column:
    """The same for the same data and signal, to 10 Hz and 0.05 Hz/s."""
    key = F.concat_ws("|", data_key, F.rint(F.col("frequency_mhz") * 1e5).cast("long").cast("string"), F.rint(F.col("drift_rate_hz_s") / 0.05).cast("long").cast("string"))
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(key.cast("binary"), 256), 1, 12)))


def cadence_of(hits: DataFrame, events: DataFrame | None, tol_mhz: float = 50e-6) -> DataFrame:
    """hits with cadence_status: of the events below tol, enough ON and OFF scans must have been looked at;
    without events, what the hit itself says."""
    if events is None:
        return hits.withColumn("cadence_status", F.when(F.col("cadence").isin("passed", "failed"), F.col("cadence")).otherwise("not_run"))
    from .rangejoin import bucketed

    ev = events.select(F.col("frequency_mhz").alias("ef"), "n_on_scans", "off_scans_checked")
    near = bucketed(hits.select("hit_id", "frequency_mhz"), ev, F.col("frequency_mhz"), F.col("ef"), tol_mhz, F.abs(F.col("frequency_mhz") - F.col("ef")) < tol_mhz)
    got = near.groupBy("hit_id").agg(F.max("n_on_scans").alias("on_"), F.max("off_scans_checked").alias("off_"))
    ok = (F.coalesce("on_", F.lit(0)) >= 2) & (F.coalesce("off_", F.lit(0)) >= 1)
    return hits.join(got, "hit_id", "left").withColumn("cadence_status", F.when(ok, "passed").otherwise("failed")).drop("on_", "off_")


def records(hits: DataFrame) -> DataFrame:
    """A nested record for each candidate, clean of NaN, with the hash of its JSON text (fields in order of name)."""
    c = checklist()
    assessment = F.struct(*[F.col(k) if k in ("ai_class", "cadence", "known_rfi_band") else finite(k).alias(k) for k in ("ai_class", "anomaly", "cadence", "interest", "known_rfi_band")])
    signal = F.struct(*[finite(k).alias(k) for k in ("bandwidth_ch", "drift_rate_hz_s", "frequency_mhz", "on_fraction", "snr")])
    rec = hits.withColumns({"assessment": assessment, "checks": F.struct(*[v.alias(k) for k, v in sorted(c.items())]), "schema": F.lit("drift-finding/1"), "signal": signal})
    body = F.to_json(F.struct("assessment", "checks", "finding_id", "schema", "signal"))
    return rec.withColumn("record", body).withColumn("payload_sha256", F.sha2(body.cast("binary"), 256))


def decisions(hits: DataFrame, destinations: tuple[str, ...], shared: DataFrame, require_cadence: bool | None = None, allow_synthetic: bool = False) -> DataFrame:
    """(finding_id, destination, action, reason): what is sent where. shared(finding_id, destination) is what has
    been; remote places need a passed cadence unless require_cadence is False, and take nothing synthetic."""
    to = hits.withColumn("destination", F.explode(F.array(*map(F.lit, destinations)))).withColumn("gate", gate(bool(require_cadence)))
    done = shared.select("finding_id", "destination", F.lit(True).alias("done")).distinct()
    to = to.join(done, ["finding_id", "destination"], "left")
    remote = F.col("destination") != "bundle"
    reason = F.when(F.col("gate") != "ok", F.col("gate")).when(flag("done"), "already shared")
    if require_cadence is None:
        reason = reason.when(remote & (F.coalesce("cadence", F.lit("not_run")) != "passed"), "no cadence pass")
    if not allow_synthetic:
        reason = reason.when(remote & flag("synthetic"), "synthetic data")
    reason = reason.otherwise("ok")
    return to.select("finding_id", "destination", F.when(reason == "ok", "send").otherwise("skip").alias("action"), reason.alias("reason"))


def markdown(rec: dict) -> str:
    """One finding in words. JSON leaves out what is null."""
    s, a = rec.get("signal", {}), rec.get("assessment", {})
    number = lambda k, f: format(s[k], f) if s.get(k) is not None else "?"
    lines = [f"# {number('frequency_mhz', '.6f')} MHz, {number('drift_rate_hz_s', '+.3f')} Hz/s", "", f"SNR {number('snr', '.1f')}, interest {a.get('interest', '?')}, class {a.get('ai_class', '?')}.", ""]
    lines += [f"- [{'x' if rec.get('checks', {}).get(k) else ' '}] {k}" for k in CHECKS]
    return "\n".join(lines) + "\n"


def write_bundle(found: DataFrame, folder: str, top: int) -> DataFrame:
    """The top findings as JSON lines below a folder of any store; returns what was written."""
    out = found.orderBy(F.desc("interest"), "finding_id").limit(top).select("finding_id", "record", "payload_sha256")
    out.select(F.col("record").alias("value")).write.mode("append").text(folder)
    return out


def webhook_body(record: Column, style: str, most: int = 1990) -> Column:
    """What goes to a webhook: the record, or text in the two common chat forms, cut to `most` characters."""
    text = F.substring(record, 1, most)
    return {"json": record, "slack": F.to_json(F.struct(text.alias("text"))), "discord": F.to_json(F.struct(text.alias("content")))}[style]
