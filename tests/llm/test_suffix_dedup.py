import hashlib
import random
import re
from collections import Counter

import numpy as np

from skydrift.llm import suffix_dedup as sd

from .conftest import docs, table, with_clashes


def brute(texts, n=sd.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    short = Counter(b[k : k + sd.PASSAGE] for b in raw for k in range(len(b) - sd.PASSAGE + 1))
    out = []
    for i, b in enumerate(raw):
        cut = sd.removed([(k, k) for k in range(len(b) - n + 1) if seen[b[k : k + n]] > 1])
        common = sd.removed([(k, k) for k in range(len(b) - sd.PASSAGE + 1) if short[b[k : k + sd.PASSAGE]] > 1], sd.PASSAGE)
        long = [len([m for m in re.finditer(rb"(?<!\S)\S+(?!\S)", b) if x <= m.start() and m.end() <= y]) for x, y in common]
        out.append((i, len(b), sum(y - x for x, y in cut), len(cut), hashlib.sha256(sd.kept(b, cut)).hexdigest(), sum(y - x for x, y in common), sum(n > sd.WORDS for n in long)))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefghij éü\n") for _ in range(n))
    p, q = fresh(900), fresh(430)
    texts = [fresh(rng.randrange(50, 1500)) for _ in range(20)]
    texts += [fresh(200) + p + fresh(300), p[100:] + fresh(10), fresh(5) + p[:600] + q + fresh(100) + q, q[3:], q, fresh(399), p, p]
    texts += ["z" * 1500, "z" * 399, "ab" * 600, ("line of text. " * 80), None, ""]
    few = " ".join(fresh(3).replace(" ", "x").replace("\n", "y") for _ in range(55))  # passages below 400 bytes: 55, 51 and 50 words
    texts += [fresh(300) + " " + few + " " + fresh(300), few, "x" + few, few[: len(few) // 2] + fresh(20), " ".join(few.split()[:51]) + " " + fresh(500), fresh(500) + " " + " ".join(few.split()[-50:])]
    wide = " ".join("w%04d" % rng.randrange(10_000) for _ in range(60))
    texts += [fresh(100) + "\n" + wide + "\n" + fresh(100), wide + fresh(30), fresh(450) + " " + wide[:330]]
    base = fresh(3000)
    return texts + [base[:k] + "#" + base[k + 1 :] for k in (100, 900, 1700, 2500)]


def test_against_every_window(spark):
    texts = corpus()
    got = sd.digest(spark, with_clashes(docs(spark, texts)))
    assert sorted(map(tuple, got.collect())) == brute(texts)


def test_small_batches_and_counted_groups_say_the_same(spark):
    texts = corpus(5)
    want = brute(texts)
    assert sorted(map(tuple, sd.digest(spark, docs(spark, texts), batch_bytes=1500).collect())) == want
    assert sorted(map(tuple, sd.digest(spark, docs(spark, texts), wide=2).collect())) == want


def test_columns_against_pairs(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    for segment in (1 << 20, 100):  # one external file, and many
        monkeypatch.setattr(sd, "SEGMENT", segment)
        group, rel, spans = [], [], []
        for g in range(6):
            base = rng.integers(97, 100, 60).astype(np.uint8)
            for _ in range(int(rng.integers(1, 7))):
                s = base.copy()
                s[rng.integers(0, 60, 2)] = 120
                a, b = int(rng.integers(0, 15)), int(rng.integers(45, 60))
                group.append(g)
                rel.append(25 - a)
                spans.append(s[a:b].tobytes())
        got = [[set() for _ in spans] for _ in range(2)]
        for k, i, a, b in sd.repeated_runs(np.array(group), np.array(rel), spans, f"file://{tmp_path}", (5, 9)):
            assert not got[k][i] & set(range(a - 1, b + 2))  # runs don't touch
            got[k][i] |= set(range(a, b + 1))
        for which, n in enumerate((5, 9)):
            for i, s in enumerate(spans):
                want = set()
                for k in range(len(s) - n + 1):
                    c = k - rel[i]
                    if any(j != i and group[j] == group[i] and 0 <= c + rel[j] and spans[j][c + rel[j] : c + rel[j] + n] == s[k : k + n] for j in range(len(spans))):
                        want.add(k)
                assert got[which][i] == want
    assert list(tmp_path.iterdir()) == []


def test_anchors_cover_each_start_once():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (240, 241, 900, 2500)]
    starts = {t: [] for t in range(4)}
    for t, _, at, a, b in sd.anchors(texts):
        assert a <= at <= b + sd.PASSAGE - sd.GRAM and b <= at
        starts[t] += range(a, b + 1)
    assert all(sorted(starts[t]) == list(range(len(x) - sd.PASSAGE + 1)) for t, x in enumerate(texts))


def test_nulls_repeats_strip_and_no_rows(spark):
    p = "".join(random.Random(3).choice("abcdefgh ") for _ in range(700))
    d = table(spark, [(None, p, None, None, None), (7, p, None, None, None), (7, p, None, None, None), (7, "other", None, None, None), (None, None, None, None, None)])
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in sd.digest(spark, d).collect())
    assert got == [(-1, 0, 0), (-1, 700, 700), (7, 5, 0), (7, 700, 700), (7, 700, 700)]
    assert sorted(r["text"] for r in sd.strip(spark, d).collect()) == ["", "", "", "", "other"]
    assert sd.digest(spark, table(spark, [])).collect() == []
