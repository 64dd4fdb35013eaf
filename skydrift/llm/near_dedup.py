"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles; two are near if the weighted Jaccard similarity of
these is at least 0.8. Each shingle's weight, its count, is cut into levels: [0, 1), [1, 2), [2, 4),
[4, 8), ... Over each such block runs a Poisson process of that rate, seeded by shingle and block; a
point has a time, a level within the block and one of the signature's registers, and counts if its
level lies below the weight. A register keeps the earliest time it gets. Two texts agree in a register
with a chance that is exactly their weighted Jaccard similarity. Times are only followed up to a bound
at which all registers are likely filled; where one isn't, the bound is doubled. So the cost of a
signature is about one draw a shingle and not one for each shingle and register.

Signatures are banded: 24 bands of 5 registers find a pair of similarity 0.8 with a chance above
0.9999. Texts of equal multisets are one node from the start. In each bucket of a band every node is
verified, on exact multiset overlap, against the node that shares most buckets; where a bucket still
holds several components, its nodes are paired across them if sizes, the number of shingles that no other
text has, and a parity bitmap of their shingles allow 0.8 at all. Pairs found so are verified too. Classes are the connected
components of all verified links. No pair within a bucket that could be a link between components is
left out, nothing is capped, and buckets are never gathered in one place.

Null and empty texts, and those without words, are classes of their own. Nodes are texts and not ids: rows of
equal doc_id are judged each by its own text, and may be in different classes. A class is named by its least
doc_id that is in no other class, and if it has none, by a negative number made of its texts; a row without doc_id gets the class of
its text's group, which has no name if no row of it has an id. An empty table gives an empty result. Other
columns are ignored by `classes`, and kept by `keep_one`. Ids are whole numbers or text that says one. Texts of any
length are hashed whole; a task holds the hashes of one chunk of texts or of one longer text at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, components, small, trim
from .shingles import PARITY_BITS, U, counted, elements, mix, parity, shingles

BANDS, ROWS, NEAR = 24, 5, 0.8
REGISTERS = BANDS * ROWS
CHUNK_BYTES = 1 << 20
#: Shingles whose processes run side by side.
AT_ONCE = 1 << 18


def _blocks(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Processes of a multiset: index of the shingle, seed, rate and first level of each block below its weight."""
    owner, seeds, rates, bases = [np.arange(len(keys))], [mix(keys ^ U(0x5851F42D4C957F2D))], [np.ones(len(keys))], [np.zeros(len(keys))]
    k, base = 1, 1
    while len(more := np.flatnonzero(counts > base)):
        owner.append(more)
        seeds.append(mix(keys[more] ^ U((0x5851F42D4C957F2D + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(len(more), float(base)))
        bases.append(np.full(len(more), float(base)))
        k, base = k + 1, base * 2
    return tuple(map(np.concatenate, (owner, seeds, rates, bases)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Times, one row of m registers for each (distinct shingles, counts); rows of empty bags stay infinite."""
    out = np.full((len(bags), m), np.inf)
    flat = out.reshape(-1)
    todo, factor = [i for i, (k, _) in enumerate(bags) if len(k)], math.log(m) + 2
    while todo:
        # of a large bag some shingles at a time: a register keeps the least of all
        some, n = [], 0
        for i in todo:
            for a in range(0, len(bags[i][0]), AT_ONCE):
                some.append((i, slice(a, a + AT_ONCE)))
                n += min(AT_ONCE, len(bags[i][0]) - a)
                if n >= AT_ONCE:
                    _follow(bags, some, m, factor, flat)
                    some, n = [], 0
        if some:
            _follow(bags, some, m, factor, flat)
        todo, factor = [i for i in todo if np.isinf(out[i]).any()], factor * 2
    return out


def _follow(bags: list[tuple[np.ndarray, np.ndarray]], some: list[tuple[int, slice]], m: int, factor: float, flat: np.ndarray) -> None:
    """The processes of some shingles of bags, up to the bags' bounds, into the registers of all bags."""
    if some:
        parts = [_blocks(bags[i][0][s], bags[i][1][s]) for i, s in some]
        todo = [i for i, _ in some]
        sizes = [len(p[0]) for p in parts]
        row = np.repeat(np.array(todo), sizes)
        seed, rate, base = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        weight = np.concatenate([bags[i][1][s][p[0]] for (i, s), p in zip(some, parts)]).astype(float)
        bound = np.repeat([m * factor / bags[i][1].sum() for i in todo], sizes)
        time, state = np.zeros(len(row)), seed
        while len(row):
            state = state + U(0x9E3779B97F4A7C15)
            r = mix(state)
            time = time - np.log(((r >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
            live = time <= bound
            if not live.all():
                row, rate, base, weight, bound, time, state, r = (x[live] for x in (row, rate, base, weight, bound, time, state, r))
                if not len(row):
                    break
            r = mix(r + U(0xD1B54A32D192ED03))
            hit = base + (r >> U(32)).astype(float) * 2.0**-32 * rate < weight
            reg = ((r & U(0xFFFFFFFF)) * U(m)) >> U(32)
            np.minimum.at(flat, (row * m + reg.astype(np.int64))[hit], time[hit])


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    x = np.ascontiguousarray(sig).view(U).reshape(len(sig), -1, ROWS)
    h = np.zeros(x.shape[:2], U)
    for k in range(ROWS):
        h = mix(h * U(0x9FB21C651E98DF25) + x[:, :, k])
    return h.view(np.int64)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK_BYTES:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text), n (shingles), digest of the multiset (null without words), bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch.column(2).to_pylist()):
                lists = list(shingles(texts))
                sig = signatures([counted(s) for s in lists])
                b = bands(sig)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(start, len(texts)),
                    "tkey": batch.column(1).slice(start, len(texts)),
                    "n": pa.array([len(s) for s in lists], pa.int64()),
                    "digest": pa.array([xxhash.xxh3_128_digest(np.sort(s).tobytes()) if len(s) else None for s in lists], pa.binary()),
                    "bands": pa.array([x if len(s) else [] for x, s in zip(b, lists)], pa.list_(pa.int64())),
                })
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tkey(), "text").mapInArrow(task, "doc_id long, tkey long, n long, digest binary, bands array<long>")


def _tkey():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey")


def _with_elements(docs: DataFrame) -> DataFrame:
    """digest, elems, parity of each row's text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column(0).to_pylist()):
                lists = list(shingles(texts))
                sets = [elements(s) for s in lists]
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array([xxhash.xxh3_128_digest(np.sort(s).tobytes()) if len(s) else None for s in lists], pa.binary()),
                    "elems": pa.array([e.view(np.int64) for e in sets], pa.list_(pa.int64())),
                    "parity": pa.array([parity(e) for e in sets], pa.list_(pa.int64())),
                })
        trim()

    return docs.select("text").mapInArrow(task, "digest binary, elems array<long>, parity array<long>")


def _linked(pairs: DataFrame, elems: DataFrame) -> DataFrame:
    """Those pairs(a, b) of nodes whose multisets overlap enough."""
    x = pairs.join(elems.select(F.col("node").alias("a"), F.col("elems").alias("ea")), "a").join(elems.select(F.col("node").alias("b"), F.col("elems").alias("eb")), "b")
    both = F.size(F.array_intersect("ea", "eb"))
    return x.where(both >= F.lit(NEAR) * (F.size("ea") + F.size("eb") - both)).select("a", "b")


def grouped(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, tkey, n, digest; nodes: digest, node; comps: node, comp for nodes with a link). Nodes are the
    distinct texts, numbered as the table of them is written."""
    signed = work.table(_signed(docs), "signed")
    nodes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = work.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", True)
    rows = signed.select("doc_id", "tkey", "n", "digest")
    member = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    buckets = member.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    member = work.table(member.join(buckets, ["band", "value"]), "member", True)
    central = member.groupBy("node").agg(F.sum("size").alias("central"))
    hubs = member.join(central, "node").groupBy("band", "value").agg(F.max(F.struct("central", "node")).alias("m")).select("band", "value", F.col("m.node").alias("hub"))
    star = work.table(member.join(hubs, ["band", "value"]).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "star", True)
    wanted = member.select("node").distinct()
    ids = work.table(nodes.join(wanted, "node", "left_semi").select("digest", "node", "least_id"), "ids", True)
    texts = docs.select(F.col("doc_id").cast("long").alias("least_id"), "text")
    some = texts.join(small(ids.where("least_id IS NOT NULL").select("least_id").distinct(), 80), "least_id", "left_semi")
    if not ids.where("least_id IS NULL").isEmpty():
        some = some.union(texts.where("least_id IS NULL"))
    elems = work.table(_with_elements(some).join(ids.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "elems", "parity"), "elems")
    links = work.table(_linked(star, elems), "links-1", True)
    comps = components(work, links).select(F.col("id").alias("node"), "comp")
    # buckets that hold several components: their nodes outside the hub's component are paired across
    seen = member.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = seen.groupBy("band", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "value").join(hubs, ["band", "value"])
    hub_comp = mixed.join(comps.withColumnRenamed("node", "hub").withColumnRenamed("comp", "hcomp"), "hub", "left").select("band", "value", F.coalesce("hcomp", "hub").alias("hcomp"))
    mixed_members = work.table(seen.join(hub_comp, ["band", "value"]), "mixed", True)
    if mixed_members.isEmpty():
        return rows, nodes.select("digest", "node"), comps
    some = mixed_members.select("node").distinct()
    alone = elems.join(some, "node", "left_semi").select("node", F.explode("elems").alias("e")).groupBy("e").agg(F.count("*").alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count("*").alias("alone"))
    # overlap <= n - alone, so a partner has at most (1 + 1/NEAR) * (n - alone) - n shingles, and at least NEAR * n
    span = mixed_members.join(alone, "node", "left").withColumn("most", F.floor(F.least(F.col("n") / NEAR, (1 + 1 / NEAR) * (F.col("n") - F.coalesce("alone", F.lit(0))) - F.col("n")) + 1e-6)).withColumn("least", F.ceil(F.col("n") * NEAR - 1e-6)).where("most >= least")
    bin_of = lambda c: F.floor(F.log(c) / math.log(1.05))
    span = work.table(span.join(elems.select("node", "parity"), "node").select("band", "value", "node", "n", "comp", "hcomp", "least", "most", "parity"), "span", True)
    asks = span.where("comp <> hcomp").withColumn("bin", F.explode(F.sequence(bin_of(F.greatest(F.col("least"), F.lit(1))), bin_of(F.col("most"))))).select("band", "value", "bin", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "comp", "least", "most", "parity")])
    gives = span.withColumn("bin", bin_of(F.col("n")))
    # of n + n' members in all, at most (1 - NEAR) / (1 + NEAR) may differ
    differ = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("x_parity")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    may = (F.col("x_comp") != F.col("comp")) & F.expr("n BETWEEN x_least AND x_most AND x_n BETWEEN least AND most") & (differ <= (F.col("n") + F.col("x_n")) * ((1 - NEAR) / (1 + NEAR)) + 1e-6)
    more = asks.join(gives, ["band", "value", "bin"]).where(may).select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct()
    extra = work.table(_linked(more.join(star, ["a", "b"], "left_anti"), elems), "links-2", True)
    if not extra.isEmpty():
        comps = components(work, links.union(extra), "cc2").select(F.col("id").alias("node"), "comp")
    return rows, nodes.select("digest", "node"), comps


def _named(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, tkey, n, group (of the row's class; null for rows without words), class_id."""
    rows, nodes, comps = grouped(docs, work)
    for tag in ("member", "star", "elems", "ids", "mixed", "span", "links-1", "links-2"):
        work.drop(tag)
    group = nodes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("group"))
    rows = work.table(rows.join(group, "digest", "left"), "grouped", True)
    for tag in ("signed", "nodes"):
        work.drop(tag)
    own = F.coalesce("group", F.xxhash64("doc_id", "tkey"))
    # ids that name nothing, as they stand in several classes; there are none unless ids come again
    torn = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id")
    fit = rows.where("group IS NOT NULL AND doc_id IS NOT NULL")
    sure = fit if torn.isEmpty() else fit.join(small(torn, 80), "doc_id", "left_anti")
    names = fit.groupBy("group").agg((-1 - F.abs(F.min(F.xxhash64("digest")) % (1 << 62))).alias("other")).join(sure.groupBy("group").agg(F.min("doc_id").alias("least")), "group", "left")
    out = rows.join(names.select("group", F.coalesce("least", "other").alias("name")), "group", "left")
    return out.select("doc_id", "tkey", "n", "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("class_id"))


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    return _named(docs, Workspace(spark, "near-dedup")).select("doc_id", "class_id", "n")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, of which each class keeps the one of least doc_id, of equal ids one
    of them; rows without a doc_id stay. Of rows without words those with equal doc_id and text are one."""
    work = Workspace(spark, "near-keep")
    got = work.table(_named(docs, work).where("doc_id IS NOT NULL").select("doc_id", "tkey", F.coalesce("group", F.xxhash64("doc_id", "tkey")).alias("group"), "class_id"), "classes", True)
    best = got.groupBy("group", "class_id").agg(F.min(F.struct("doc_id", "tkey")).alias("b"))
    losers = got.join(best, ["group", "class_id"]).where("doc_id <> b.doc_id OR tkey <> b.tkey").select("doc_id", "tkey").distinct()
    again = got.groupBy("doc_id", "tkey").count().where("count > 1").select("doc_id", "tkey")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    keyed = inner.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "text": F.col(at["text"])}).withColumn("tkey", _tkey()).drop("text")
    kept = keyed.join(small(losers, 80), ["doc_id", "tkey"], "left_anti")
    if not again.isEmpty():
        twice = small(again, 80)
        kept = kept.join(twice, ["doc_id", "tkey"], "left_anti").unionByName(kept.join(twice, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"]))
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
