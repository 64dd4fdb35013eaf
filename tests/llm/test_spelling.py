import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skydrift.llm import queries, spelling

from .conftest import docs, stored, table, with_clashes

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    """Whether exactly one letter is inserted, deleted or replaced, from the first letter that differs."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(rows, least_length=6, least_n=5, times=5, slip=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least_length
    n = {w: k for w, k in n.items() if k >= max(1, least_n)}
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= times * n[a] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(a, form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] is not None else None) for a in n}


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs(spark, sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    assert found(spelling.variants(spark, sample)) == plain(rows)


LETTERS = st.text(st.sampled_from("abcABéÉ×ÿ"), min_size=1, max_size=7)


@given(st.lists(LETTERS, min_size=1, max_size=60), st.integers(1, 3))
@settings(max_examples=12, deadline=None)
def test_short_alphabets(spark, words, times):
    rows = [(i, " ".join(words[i::7])) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spelling.variants(spark, df, least_length=1, least_n=1, times=times + 1, slip=3))
    assert got == plain(rows, least_length=1, least_n=1, times=times + 1, slip=3)


def test_every_edit_meets_once(spark):
    base = "spelling"
    letters = "aefszéÿ"
    edits = {base[:i] + c + base[i:] for i in range(9) for c in letters} | {base[:i] + base[i + 1 :] for i in range(8)} | {base[:i] + c + base[i + 1 :] for i in range(8) for c in letters}
    words = sorted(edits | {base})
    v = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [frozenset((r["a"], r["b"])) for r in spelling.near_pairs(v).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(base in p for p in got) == len(edits - {base})


def test_masks(spark):
    row = spark.createDataFrame([("abcaéÿ",), ("",)], "word string").select(spelling.parity("word").alias("b")).collect()
    want = [0, 0, 0]
    for i in (1, 2, ord("é") - 192 + 26, ord("ÿ") - 192 + 26):  # a comes twice
        want[i % 3] ^= 1 << i // 3
    assert row[0]["b"] == want and row[1]["b"] == [0, 0, 0]


def test_chains_ties_and_letters(spark):
    counts = {"aabbcc": 5, "aabbcd": 25, "aabbdd": 125, "xxyyzza": 5, "xxyyzzb": 30, "xxyyzzc": 30, "étérnel": 5, "Étérnel": 25, "shorts": 4}
    text = " ".join(f"{w} " * k for w, k in counts.items())
    rows = [(1, text)]
    got = {r[0]: r for r in found(spelling.variants(spark, docs(spark, [text], 1), slip=10**9))}
    assert got["aabbcc"][1:] == ("aabbcd", "aabbdd", 5, 1, 25) and got["aabbdd"][1:3] == (None, "aabbdd")
    assert got["xxyyzza"][1] == "xxyyzzb" and got["xxyyzzb"][1] is None  # of equal ones the smaller, and equal is not enough
    assert got["étérnel"][1] == "Étérnel"  # only A-Z are lower-cased
    assert "shorts" not in got and set(got.values()) == plain(rows, slip=10**9)


def test_odd_rows(spark):
    long = "qwertyuiopasdfghjkl" * 3000
    rows = [(1, None, "en", "s", 0), (1, "", "en", "s", 0), (None, "missing identity " * 6, None, None, None), (2, "repeated words " * 5, "en", "s", 1), (2, "repeated words " * 5, "en", "s", 1), (3, f"{long} " * 5 + f"x{long} " * 5, "en", "s", 1)]
    want = plain([(r[0], r[1]) for r in rows])
    assert found(spelling.variants(spark, with_clashes(table(spark, rows)).withColumns({c: F.lit("x") for c in ("word", "bands", "run", "h", "form")}))) == want
    assert {r[0] for r in want} >= {"repeated", "missing", "identity", long, "x" + long}
    assert found(spelling.variants(spark, table(spark, []))) == set()
    texts = spark.createDataFrame([("a1", "textual identifiers " * 5)], "doc_id string, text string")
    assert found(spelling.variants(spark, texts)) == plain([("a1", "textual identifiers " * 5)])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    rel = con.sql(queries.oracle_sql()["op11_spelling"]).select(*COLUMNS)
    assert found(queries.op11_spelling(spark, f"/root/testdata/{sf}")) == set(rel.fetchall())


def test_common_endings(spark, tmp_path):
    """Endings that a tenth of the words share don't bring all those words together."""
    words = sorted({f"{a}{b}{c}{d}ation" for a in "bdfg" for b in "aeiou" for c in "lmnrst" for d in "aiou"})
    v = spark.read.parquet(stored(spark, spark.createDataFrame([(w, 5) for w in words], "word string, n long"), tmp_path / "v"))
    pairs = spelling.near_pairs(v).collect()
    assert len(pairs) == sum(one_edit(a, b) for i, a in enumerate(words) for b in words[:i])
    assert "CartesianProduct" not in spelling.near_pairs(v)._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_broadcast(spark, tmp_path):
    """Sides become several rows a word after Spark has sized them by their files, so none may go through the driver."""
    v = spark.read.parquet(stored(spark, spark.createDataFrame([(f"spelled{a}{b}", 5 + 90 * (a == b)) for a in "abcdef" for b in "abcdef"], "word string, n long"), tmp_path / "v"))
    found = spelling.forms(v)
    assert found.where("form IS NOT NULL").count() > 0
    work = spelling.Workspace(spark, "spelling-test")
    for df in (spelling.near_pairs(v), found, spelling.roots(work, found), spelling.variants(spark, docs(spark, ["wordless wordlesz " * 5 + "wordless " * 30]))):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
