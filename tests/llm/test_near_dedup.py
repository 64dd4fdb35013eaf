import random
from collections import Counter

import numpy as np

from skydrift.llm import near_dedup
from skydrift.llm.common import Workspace, components
from skydrift.llm.shingles import U, counted, elements, mix, parity, shingles

from .conftest import docs, table, with_clashes


def brute(texts):
    bags = [Counter(s.tolist()) for s in shingles(texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()) + str(rng.randrange(30)) for _ in range(n)]


def corpus(seed=0):
    rng, out = random.Random(seed), []
    for _ in range(25):
        w = words(rng, rng.randrange(30, 150))
        out.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = words(rng, 1)[0]
            out.append(" ".join(v))
    base = words(rng, 200)  # a large group around one text, some members just below the bound
    for _ in range(60):
        v = list(base)
        for _ in range(rng.randrange(1, 9)):
            v[rng.randrange(len(v))] = words(rng, 1)[0]
        out.append(" ".join(v))
    return [*out, None, "", "!!! ...", "one two", "One, two!", "one two three"]


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 20)) for i in range(1, 60)}
    b = {i: (c if rng.random() < 0.7 else int(rng.integers(1, 20))) for i, c in a.items() if rng.random() < 0.9}
    want = sum(min(a.get(i, 0), b.get(i, 0)) for i in a) / sum(max(a.get(i, 0), b.get(i, 0)) for i in a | b)
    got = []
    for k in range(60):
        bags = [(mix(np.array(sorted(x), U) + U(k * 1000)), np.array([x[i] for i in sorted(x)])) for x in (a, b)]
        s = near_dedup.signatures(bags)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 4 * np.std(got) / 60**0.5 + 1e-3


def test_signature_does_not_depend_on_company():
    bags = [counted(s) for s in shingles(corpus()[:20])]
    together = near_dedup.signatures(bags)
    assert all((near_dedup.signatures([b])[0] == t).all() for b, t in zip(bags, together))


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 400, 100).astype(U)
        y = rng.integers(0, 400, 100).astype(U)
        x, y = np.unique(x), np.unique(y)
        diff = len(np.setxor1d(x, y))
        assert sum(int(v).bit_count() for v in (parity(x) ^ parity(y)).view(U)) <= diff


def test_elements_keep_multiplicity():
    s = np.array([5, 5, 5, 7], U)
    t = np.array([5, 5, 9], U)
    assert len(np.intersect1d(elements(s), elements(t))) == 2


def test_classes_against_all_pairs(spark):
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark, docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_keep_one(spark):
    texts = corpus(3)
    want = brute(texts)
    kept = near_dedup.keep_one(spark, with_clashes(docs(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({want[i] for i in range(len(texts))})
    assert "class_id" in kept.columns


def test_nulls_repeats_and_no_rows(spark):
    t = " ".join(words(random.Random(1), 60))
    d = table(spark, [(None, t, None, None, None), (4, t, None, None, None), (4, t, None, None, None), (2, t, None, None, None), (None, None, None, None, None), (9, "w " * 40_000, None, None, None)])
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.classes(spark, d).collect()), key=str)
    assert got == sorted([(None, 2), (4, 2), (4, 2), (2, 2), (None, None), (9, 9)], key=str)
    assert sorted(r["doc_id"] or -1 for r in near_dedup.keep_one(spark, d).collect()) == [-1, -1, 2, 9]
    assert near_dedup.classes(spark, table(spark, [])).collect() == []


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 80) for _ in range(3))
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [(5, near(a, 0)), (5, near(b, 0)), (6, near(a, 1)), (7, near(b, 1)), (8, near(c, 0)), (8, near(a, 2)), (3, "x y z"), (3, near(c, 1))]
    d = table(spark, [(i, t, None, None, None) for i, t in rows])
    got = near_dedup._named(d, Workspace(spark, "t")).collect()
    name = {(r["doc_id"], r["tkey"]): r["class_id"] for r in got}
    keys = {t: k for (i, t), k in zip(rows, d.select(near_dedup._tkey()).toPandas()["tkey"].tolist())}
    of = [name[i, keys[t]] for i, t in rows]
    assert of[:4] == [6, 7, 6, 7] and of[5] == 6
    assert of[4] == of[7] < 0 and of[6] < 0 and of[4] != of[6]  # ids 3 and 8 stand in several classes
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(spark, d).collect())
    left = [r for r in rows if r[1] in {t for _, t in kept}]
    assert len(kept) == len(set(of)) == 4 and {name[i, keys[t]] for i, t in left} == set(of)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    got = {r["id"]: r["comp"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}
