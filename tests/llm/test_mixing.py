from collections import defaultdict

import pytest

from skydrift.llm import mixing

from .conftest import docs, table, with_clashes


def level(budget, caps, weights):
    """What each child gets: by weight, what one can't take to its siblings."""
    out, open_, left = {k: 0.0 for k in caps}, set(caps), budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if out[k] + left * weights[k] / total >= caps[k] - 1e-12]
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            return out
        share = {k: out[k] for k in open_}
        lam = min((caps[k] - share[k]) / weights[k] for k in open_)
        for k in list(open_):
            out[k] += lam * weights[k]
            left -= lam * weights[k]
            if out[k] >= caps[k] - 1e-9:
                open_.discard(k)
    return out


def brute_budgets(leaves, recipe):
    weight = lambda lv, k: getattr(recipe, lv).get(k, recipe.other)
    total = sum(leaves.values()) * recipe.share // 1
    cap = lambda pre: sum(v for k, v in leaves.items() if k[: len(pre)] == pre) * recipe.max_epochs
    out = {}
    ds = {k[0] for k in leaves}
    b0 = level(total, {d: cap((d,)) for d in ds}, {d: weight("domain", d) for d in ds})
    for d in ds:
        ls = {k[1] for k in leaves if k[0] == d}
        b1 = level(b0[d], {x: cap((d, x)) for x in ls}, {x: weight("lang", x) for x in ls})
        for x in ls:
            ss = {k[2] for k in leaves if k[:2] == (d, x)}
            b2 = level(b1[x], {s: cap((d, x, s)) for s in ss}, {s: weight("source", s) for s in ss})
            out |= {(d, x, s): b2[s] for s in ss}
    return out


LEAVES = [("web", "en", "a", 1000), ("web", "en", "b", 10), ("web", "de", "c", 300), ("books", "en", "d", 50), ("books", "fr", "e", 20), ("reference", "xx", "f", 7), ("forums", "en", "g", 0)]


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0, 3.9, 9.0])
def test_budgets_against_filling_step_by_step(spark, share):
    r = mixing.Recipe(share=share)
    df = spark.createDataFrame([(*x, 1) for x in LEAVES], "domain string, lang string, source string, tokens long, rows long")
    got = {(x["domain"], x["lang"], x["source"]): x["budget"] for x in mixing.budgets(df, r).collect()}
    want = brute_budgets({x[:3]: x[3] for x in LEAVES}, r)
    assert all(abs(got[k] - want[k]) <= 1 for k in want)
    assert all(got[x[:3]] <= x[3] * r.max_epochs for x in LEAVES)


def test_prefixes_spend_the_budget_exactly(spark, sample):
    for r in (mixing.Recipe(share=0.37), mixing.Recipe(share=2.5, range_rows=3)):
        rows = mixing.plan(spark, sample, r).collect()
        m = mixing.measured(sample)
        from pyspark.sql import functions as F

        b = {(x["domain"], x["lang"], x["source"]): x for x in mixing.budgets(m.groupBy(*mixing.LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), r).collect()}
        got, cut = defaultdict(int), defaultdict(int)
        for x in rows:
            k = (x["domain"], x["lang"], x["source"])
            got[k] += x["taken"]
            cut[k] += 0 < x["last_tokens"] < x["n_tokens"]
        assert dict(got) == {k: x["budget"] for k, x in b.items()}
        assert max(cut.values()) <= 1 and len(rows) == sample.count()


def test_select_writes_what_the_plan_says(spark):
    d = with_clashes(docs(spark, ["a b c d", " lead one", "tab\tand\nfeed x", None, "", "trail one "] * 5)).withColumn("tokens", mixing.F.lit("x"))
    r = mixing.Recipe(share=1.6)
    plan = {x["doc_id"]: x for x in mixing.plan(spark, d, r).collect()}
    out = mixing.select(spark, d, r)
    assert out.columns == d.columns
    got = defaultdict(list)
    for x in out.collect():
        got[x["doc_id"]].append(x)
        assert x["n_chars"] == len(x["text"] or "")
    for i, p in plan.items():
        n = [len((x["text"] or "").split()) for x in got[i]]
        assert sum(n) == p["taken"] if p["n_tokens"] else n == [0]


def test_repeats_nulls_and_no_rows(spark):
    d = table(spark, [(1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (None, "d e", "en", "src1", 3), (3, None, "en", "src1", None)])
    rows = mixing.plan(spark, d, mixing.Recipe(share=0.5)).collect()
    assert len(rows) == 4 and {r["lang"] for r in rows} == {"unknown", "en"}
    assert mixing.plan(spark, table(spark, [])).collect() == []
    assert mixing.select(spark, table(spark, [])).collect() == []
