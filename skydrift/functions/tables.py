"""Table functions for SQL: the search over any table of samples.

    SELECT * FROM dedoppler_hits(k_max => 3, threshold => 10.0, samples => TABLE(SELECT obs, t, c, z FROM x) PARTITION BY (obs, hash(obs)))

A partition is one observation or unit; its rows come as Arrow batches, in any order. Where x is dealt by obs already, as
a join leaves it, Spark adds no exchange for PARTITION BY obs, and may later read the join's by the tasks that wrote it,
which parts an observation. No join deals by the hash as well, so with it there always is an exchange of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.dedoppler import nms_window
from ..operators.kernel import peaks, search


class Hits:
    """(obs, channel, drift, snr): hits of a partition with columns obs, t, c and z, drifts below k_max + 1 channels a
    sample, at the threshold or above. Samples that are missing or null count as zero; t and c begin at zero. Rows
    whose obs, t or c is null are passed over."""

    def __init__(self):
        self.parts, self.k_max, self.threshold = [], 0, 0.0

    def eval(self, samples: pa.RecordBatch, k_max: pa.Array, threshold: pa.Array) -> Iterator[pa.Table]:
        if samples.num_rows:
            self.k_max, self.threshold = k_max[0].as_py(), float(threshold[0].as_py())
            rows = pa.table({n: samples.column(n) for n in ("obs", "t", "c", "z")})
            self.parts.append(rows.filter(pa.compute.and_(pa.compute.and_(rows["obs"].is_valid(), rows["t"].is_valid()), rows["c"].is_valid())))
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        rows = pa.concat_tables(self.parts) if self.parts else None
        if rows is None or not rows.num_rows:
            return
        t, c = (rows[n].to_numpy().astype(np.int64) for n in ("t", "c"))
        z = np.zeros((int(t.max()) + 1, int(c.max()) + 1))
        z[t, c] = np.nan_to_num(rows["z"].cast(pa.float64()).to_numpy())
        snr, drift = search(z, self.k_max)
        at = peaks(snr, nms_window(*z.shape, self.k_max), self.threshold)
        obs = rows["obs"].cast(pa.int64())[0].as_py()
        yield pa.table({"obs": pa.array([obs] * len(at), pa.int64()), "channel": pa.array(at.astype(np.int64)), "drift": pa.array(drift[at].astype(float)), "snr": pa.array(snr[at].astype(float))})


def register(spark: SparkSession) -> None:
    spark.udtf.register("dedoppler_hits", arrow_udtf(Hits, returnType="obs long, channel long, drift double, snr double"))
