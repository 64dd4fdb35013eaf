import random

import numpy as np

from skydrift.llm import license_scan as ls
from skydrift.llm.shingles import shingles

from .conftest import docs, table, with_clashes


def texts(seed=0):
    rng = random.Random(seed)
    fill = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit".split()) + str(rng.randrange(99)) for _ in range(n))
    out = [fill(80), None, "", "MIT", ls.TEMPLATES["MIT"][0]]
    for name, forms in ls.TEMPLATES.items():
        for f in forms:
            w = f.split()
            out += [f"{fill(rng.randrange(40))} {f} {fill(rng.randrange(60))}", f.upper() + "\n" + f, " ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2])]
    return [*out, fill(20_000) + " " + ls.TEMPLATES["GPL-3.0"][0]]


def brute(all_texts):
    ix, out = ls.Index(ls.TEMPLATES), set()
    for i, s in enumerate(shingles(all_texts)):
        for t in range(len(ix.templates)):
            name, own, size, least = ix.templates[t]
            best = max((len(set(s[a : a + size].tolist()) & set(own.tolist())) for a in range(len(s))), default=0) if len(np.intersect1d(s, own)) >= least else 0
            if best >= least:
                out.add((i, name))
    return out


def test_against_all_passages(spark):
    t = texts()
    got = ls.scan(with_clashes(docs(spark, t))).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == brute(t)
    assert all(0.8 <= r["containment"] <= 1 and r["n_matches"] >= 1 for r in got)


def test_place_and_number():
    ix = ls.Index({"x": ["one two three four five six seven eight"]})
    t = "a b c one two three four five six seven eight d e one two three four five six seven eight"
    assert list(ls.scan_texts(ix, [t])) == [(0, "x", 1.0, 3, 10, 2)]


def test_short_templates_and_no_rows(spark):
    assert ls.scan(table(spark, [])).collect() == []
    assert ls.scan(docs(spark, ["some words here"]), {}).collect() == []
    got = ls.scan(table(spark, [(None, "Released under the MIT License.", None, None, None)])).collect()
    assert [(r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in got] == [(None, "MIT", 0, 4)]
