"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A budget of tokens goes down the tree: among siblings it is split
by their weights, none gets more than its capacity (its tokens times `max_epochs`), and what one can't
take goes to its siblings by their weights; only what a whole family can't take is left to the siblings
of its parent. Filling each family to a common level does just that: with siblings in order of
capacity / weight, the level is the largest of (budget - capacity before) / (weight from here on).

A leaf's budget is spent on epochs over it. All but the last are whole; the last one is a prefix, in
tokens, of the leaf's documents in an order that seed, epoch and doc_id determine; the document at the
cut is cut too. The cut is found from sums over ranges of the order, so no leaf, however hot, is sorted
as a whole: only the one range that holds the cut is. Everything is DataFrame operations.

Tokens are runs of [^\\x20\\x09-\\x0D]. Null texts have none. Null languages and sources are the leaf
"unknown". Rows that share doc_id and leaf stand together in the order and are cut alike. Weights
of zero or less leave a leaf out. Budgets are rounded down to whole tokens. Extra columns are ignored by
`plan`, and kept by `select`. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, small

BLANK = "\\x20\\x09-\\x0D"
LEAF = ("domain", "lang", "source")
DOMAINS = ("web", "books", "forums", "reference")


def default_domain(source: Column) -> Column:
    """The tables have no domain: sources are dealt to four of them by the number in their name."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    number = F.when(n == "", F.lit(0)).otherwise(n.cast("long"))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS)).cast("int") + 1)


@dataclass(frozen=True)
class Recipe:
    """Weights by name on each level (`other` for any name not given), share of all tokens to hand out."""

    domain: dict[str, float] = field(default_factory=lambda: {"web": 0.4, "books": 0.3, "forums": 0.1, "reference": 0.2})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 1.0
    max_epochs: int = 4
    seed: int = 17
    range_rows: int = 20_000

    def weight(self, level: str) -> Column:
        given = getattr(self, level)
        w = F.lit(float(self.other))
        for k, v in given.items():
            w = F.when(F.col(level) == k, F.lit(float(v))).otherwise(w)
        return w


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+")).cast("long")


def _leaf_columns() -> dict[str, Column]:
    return {"domain": default_domain(F.col("source")), "lang": F.coalesce("lang", F.lit("unknown")), "source": F.coalesce("source", F.lit("unknown"))}


def budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """leaves(domain, lang, source, tokens, rows) with budget: tokens to take, over all epochs."""
    cap = F.sum("tokens") * recipe.max_epochs
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(F.floor(F.col("t") * F.lit(recipe.share)).cast("double").alias("budget"))
    above = all_tokens.withColumn("root", F.lit(0))
    out, path = leaves, []
    for level in LEAF:
        parent = ["root", *path]
        path = [*path, level]
        nodes = leaves.withColumn("root", F.lit(0)).groupBy("root", *path).agg(cap.alias("cap")).withColumn("w", recipe.weight(level)).where("w > 0")
        nodes = nodes.join(F.broadcast(above) if parent == ["root"] else above, parent)
        family = Window.partitionBy(*parent)
        inside = family.orderBy(F.col("cap") / F.col("w"), level)
        before = F.sum("cap").over(inside) - F.col("cap")
        onward = F.sum("w").over(family.orderBy((F.col("cap") / F.col("w")).desc(), F.col(level).desc()))
        nodes = nodes.withColumn("level_", (F.col("budget") - before) / onward)
        share = F.least(F.col("cap").cast("double"), F.col("w") * F.max("level_").over(family))
        above = nodes.select("root", *path, share.alias("budget")) if path != list(LEAF) else nodes.select(*path, F.floor(F.round(share, 6)).cast("long").alias("budget"))
    return out.join(above, list(LEAF), "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast("long"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def cuts(work: Workspace, measured: DataFrame, recipe: Recipe) -> DataFrame:
    """For each leaf: full epochs, and where the prefix of the last one ends: key, id and tokens of the document
    at the cut (null if the last epoch is empty)."""
    leaves = work.table(measured.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = budgets(leaves, recipe).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    plan = work.table(plan, "plan")
    span = F.lit(float(1 << 60))
    keyed = measured.join(small(plan.where("rest > 0").select(*LEAF, "full", "rest", F.ceil(F.col("rows") / recipe.range_rows).alias("ranges")), 200), list(LEAF))
    keyed = keyed.withColumn("key", order_key(recipe.seed, F.col("full"), F.col("doc_id"))).withColumn("range", F.floor(F.col("key") / span * F.col("ranges")))
    keyed = keyed.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    sums = keyed.groupBy(*LEAF, "rest", "range").agg(F.sum("tokens").alias("in_range"))
    ranged = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy(*LEAF).orderBy("range")) - F.col("in_range")).where("before < rest AND rest <= before + in_range")
    near = keyed.join(small(ranged.select(*LEAF, "range", "before"), 200), [*LEAF, "range"]).groupBy(*LEAF, "rest", "before", "key", "id").agg(F.sum("tokens").alias("n"), F.count("*").alias("copies"))
    near = near.withColumn("start", F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key", "id")) - F.col("n")).where("start < rest AND rest <= start + n")
    return plan.select(*LEAF, "budget", "full").join(near.select(*LEAF, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.floor((F.col("rest") - F.col("start")) / F.col("copies")).alias("cut_tokens")), list(LEAF), "left")


def _taken(df: DataFrame, cut: DataFrame, recipe: Recipe) -> DataFrame:
    """df(leaf columns, doc_id, tokens) with full_epochs and last_tokens."""
    out = df.join(small(cut.drop("budget"), 300), list(LEAF), "left")
    key, me = order_key(recipe.seed, F.col("full"), F.col("doc_id")), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    whole = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (me < F.col("cut_id")))
    last = F.when(F.col("cut_key").isNull(), 0).when(whole, F.col("tokens")).when((key == F.col("cut_key")) & (me == F.col("cut_id")), F.least("tokens", "cut_tokens")).otherwise(0)
    return out.withColumn("last_tokens", last.cast("long")).withColumn("full_epochs", F.coalesce("full", F.lit(0)).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source").withColumns(_leaf_columns()).select(F.col("doc_id").cast("long").alias("doc_id"), *LEAF, tokens(F.col("text")).alias("tokens"))


def plan(spark: SparkSession, docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """For every document: its leaf, n_tokens, full_epochs, last_tokens (of the last epoch) and taken (tokens in all)."""
    work = Workspace(spark, "mixing")
    m = work.table(measured(docs), "measured")
    out = _taken(m, work.table(cuts(work, m, recipe), "cuts"), recipe)
    return out.select("doc_id", *LEAF, F.col("tokens").alias("n_tokens"), "full_epochs", "last_tokens", (F.col("full_epochs") * F.col("tokens") + F.col("last_tokens")).alias("taken"))


def select(spark: SparkSession, docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The mixed documents, with their own columns: one row an epoch, the text of the one at a leaf's cut
    shortened to its tokens. Texts without tokens stay once, for they cost nothing."""
    work = Workspace(spark, "mixing")
    cut = work.table(cuts(work, work.table(measured(docs), "measured"), recipe), "cuts")
    names, own = docs.columns, {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names], F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    inner = inner.withColumns(_leaf_columns()).withColumn("tokens", tokens(F.col("text")))
    out = _taken(inner, cut, recipe)
    pieces = F.split(F.col("text"), f"(?<=[^{BLANK}])(?=[{BLANK}])")
    short = F.array_join(F.slice(pieces, 1, F.col("last_tokens").cast("int")), "")
    last = F.when(F.col("last_tokens") == 0, F.array().cast("array<string>")).when(F.col("last_tokens") < F.col("tokens"), F.array(short)).otherwise(F.array("text"))
    texts = F.when(F.col("tokens") == 0, F.array("text")).otherwise(F.concat(F.array_repeat("text", F.col("full_epochs").cast("int")), last))
    out = out.withColumn("_text", F.explode(texts))
    return out.select(*[(F.col("_text") if c == "text" else F.when(F.col("_text").eqNullSafe(F.col("text")), F.col(own[c])).otherwise(F.length("_text").cast(docs.schema[c].dataType)) if c == "n_chars" else F.col(own[c])).alias(c) for c in names])
