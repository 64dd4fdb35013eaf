"""Spelling variants: words one edit apart, found by letter-parity bitmasks in three bands.

A mask has a bit for each letter, set where the letter comes an odd number of times. A deleted or inserted
letter flips one bit of it, a replaced one at most two; so of three bands of the mask at least two, or one, stay
equal. Words meet where such bands are equal and their lengths fit. Common bands alone would bring together a
square of the vocabulary, so what meets must also share the half of the word that the edit leaves alone: one
edit lies in one half, and the other is the same letter by letter. Each pair of near words meets in one place by
rule (the first equal band; the first half where both are equal), so there are no duplicates to be removed. Then
the edit distance is taken. Groups of words that meet are joined by equi-joins, which AQE splits where one is
large; nothing is capped. No side of a join is broadcast: all of them grow with the vocabulary, and Spark would size
them by their compressed files, before they become several rows a word.

Words are counted before they are shuffled, and only distinct ones are compared. Tables that are read several
times lie in the shared folder. Null texts have no words, a null doc_id counts as an empty string where a run is
to lose a letter, repeated rows count again, ties between forms go to the smallest word in code-point order, and
an empty table gives no rows. Other columns are ignored, whatever their names. doc_id may have any type that
casts to text. The length of a text or a run has no limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = 3


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, least_length: int = 6, least_n: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): runs of letters of all texts that are long and frequent enough. A run loses the letter at h modulo
    its length where slip divides h, the crc32 of its document's id, a colon and the run."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slip == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def merged(a: DataFrame, b: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the vocabulary, by sorted exchanges."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def parity(word: str) -> Column:
    """The three bands of a word's mask. Letters go to the bands in turn, so frequent ones spread over all of them."""
    place = "(CASE WHEN ascii(c) < 128 THEN ascii(c) - 97 ELSE ascii(c) - 166 END)"
    one = "aggregate(filter(split({w}, ''), c -> c <> ''), 0L, (m, c) -> m ^ (CASE WHEN {p} % {n} = {k} THEN shiftleft(1L, {p} div {n}) ELSE 0L END))"
    return F.array(*[F.expr(one.format(w=word, p=place, n=BANDS, k=k)) for k in range(BANDS)])


def _ways(length: Column, edit: str) -> Column:
    """What a word can meet others by. replaced: an equal band, length and half; deleted: two equal bands, with the
    halves that a word of `length` letters and one more letter share."""
    half, w = F.floor(length / 2).cast("int"), F.col("word")
    parts = [F.substring(w, F.lit(1), half), F.right(w, length - half)]
    rows = []
    for k in range(BANDS):
        others = [F.col("bands")[j] for j in range(BANDS) if j != k]
        band = [F.col("bands")[k], F.lit(0).cast("long")] if edit == "replaced" else others
        for h, part in enumerate(parts):
            rows.append(F.struct(F.lit(edit).alias("edit"), length.cast("int").alias("len"), F.lit(k).alias("k"), F.lit(h).alias("h"), band[0].alias("p"), band[1].alias("q"), part.alias("part")))
    return F.array(*rows)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every two words of vocabulary(word, n) that differ by one inserted, deleted or replaced
    letter, once each."""
    masks = vocabulary.select("word", "n", parity("word").alias("bands"), F.length("word").alias("size"))
    side = lambda ways, x: masks.withColumn("way", F.explode(ways)).select("way.*", *[F.col(c).alias(f"{c}_{x}") for c in ("word", "n", "bands")])
    size = F.col("size")
    a = side(F.concat(_ways(size, "replaced"), _ways(size - 1, "deleted")), "a")  # the longer one
    b = side(F.concat(_ways(size, "replaced"), _ways(size, "deleted")), "b")
    met = merged(a, b, ["edit", "len", "k", "h", "p", "q", "part"])
    earlier = [(F.col("k") <= j) | (F.col("bands_a")[j] != F.col("bands_b")[j]) for j in range(BANDS - 1)]
    half = F.floor(F.col("len") / 2).cast("int")
    first_half = (F.col("h") == 0) | (F.substring("word_a", F.lit(1), half) != F.substring("word_b", F.lit(1), half))
    once = F.when(F.col("edit") == "replaced", (F.col("word_a") < F.col("word_b")) & reduce(Column.__and__, earlier)).otherwise(first_half)
    met = met.where(once).where(F.levenshtein("word_a", "word_b", 1) == 1)
    return met.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b")


def forms(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, n, n_near, form_n) for each word of the vocabulary: its near word of largest n, if that is `times` as frequent."""
    pair = near_pairs(vocabulary)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    near = pair.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= F.col("n") * times
    return merged(vocabulary, near, "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(work: Workspace, found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of their chain. Each round doubles how far the links
    reach; n grows by a factor with every form, so chains are as short as the logarithm of the largest n."""
    links, i = work.table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links-0", True), 0
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if merged(links, on, "root", "left_semi").isEmpty():
            return links
        i += 1
        links = work.table(merged(links, on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"links-{i}", True)


def variants(spark: SparkSession, docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, slip: int = 199) -> DataFrame:
    """One row a word of docs(doc_id, text): word, form, root, n, n_near, form_n."""
    work = Workspace(spark, "spelling")
    vocabulary = work.table(words(docs, least_length, least_n, slip), "words", True)
    found = work.table(forms(vocabulary, times), "forms", True)
    return merged(found, roots(work, found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
