import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skydrift.llm import context_mixing as cm

from .conftest import docs, table, with_clashes

TEXTS = ["The cat sat. The CAT ran!", None, "", "été  où\tça", "one two three " * 300, "x" * 30_000, "unseen-words here"] + [f"the cat number {i} sat on mat {i % 7}" for i in range(60)]


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in cm.score(spark, with_clashes(docs(spark, TEXTS))).collect()}


def tokens(t):
    return cm.tokens_of(t)


def out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_exactly(scored):
    train = Counter(w for i, t in enumerate(TEXTS) if not out(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        r, w = scored[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out(i), len(w), n)
        assert r["n_known"] == sum(train[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))


def test_scores_are_those_of_a_distribution(scored):
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored.values())
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == 1  # their scores differ: a training text's own end is taken out of the counts for it


def random_model(rng, high=50):
    t = cm.Tables([])
    t.counts = [rng.integers(0, high, (1 << b, 2)).astype(np.float32) for b in cm.BITS]
    return cm.Model(t, rng.normal(0.3, 0.2, (cm.GATES, cm.ORDERS)), rng.integers(0, 9, (cm.LEVELS, cm.BUCKETS, 2)).astype(float).cumsum(2))


def test_bits_sum_to_one():
    """Over all words of one or two bytes and all longer beginnings, probabilities sum to one."""
    model = random_model(np.random.default_rng(0))
    e = cm.Events([bytes([0, b]) for b in range(256) if b != 10])
    first = np.zeros(len(e.byte))
    for k, slots, y in e.bits():
        prefix = model.tables.seen[1][slots[-1]]
        dot = (model.weights[cm.gate(model.tables.seen[0][slots[-2]], prefix, k)].T * np.array([model.tables.logit[j][s] for j, s in enumerate(slots)])).sum(0)
        p = 0.5 * cm._squash(dot) + 0.5 * model.apm[prefix, cm._bucket(dot)]
        first += np.log10(np.where(y, p, 1 - p))
    total = sum(10 ** first[e.cells[np.flatnonzero(e.word == i)[0]]] for i in range(e.n_words))
    end = 10 ** model.log10([b"\x00\n"])[0]
    assert total + end == pytest.approx(1, abs=1e-4)


def test_counts_leave_what_they_take():
    """Words by counts and those by spelling sum to one, whatever share of the spelling is of words that were seen."""
    rng = np.random.default_rng(3)
    c, other = rng.integers(0, 4, 40), rng.integers(0, 9, 40)
    spelled = rng.dirichlet(np.ones(41))
    kind = np.full(40, 2)
    base = c + other
    sums = np.zeros((cm.KINDS + 1, 4), np.int64)
    for k, x in ((2, c), (-1, base)):
        sums[k] = x.sum(), (x > 0).sum(), (x == 1).sum(), (x == 2).sum()
    p = 10 ** cm.by_counts(kind, c, base, np.log10(spelled[:-1]), sums)
    rest = 10 ** cm.by_counts(kind[:1], np.zeros(1), np.zeros(1), np.log10(spelled[-1:]), sums)
    assert p.sum() + rest[0] == pytest.approx(1)


def plain_score(value, seen, share, found):
    """A text's probability step by step."""
    totals = []
    for a in (None, *cm.URNS):
        came, run, x = Counter(), 0, 0.0
        for t, (w, v, s, q) in enumerate(zip(*value, seen, share)):
            p = 10.0**v if a is None else (a * 10.0**v + came[w]) / (a + t)
            chance = found[s, min(cm.STREAKS - 1, math.ceil(math.log2(run + 1)))]
            x += math.log10((chance * 2 ** (-int(q) / 16) if q < 255 else 0) + (1 - chance) * p)
            run = run + 1 if q < 255 and s else 0
            came[w] += 1
        totals.append(x)
    return max(totals) + math.log10(np.mean([10.0 ** (x - max(totals)) for x in totals]))


def test_texts_step_by_step():
    rng = np.random.default_rng(4)
    lengths = np.array([40, 1, 25])
    lid, value = rng.integers(0, 6, 66), np.log10(rng.dirichlet(np.ones(6)))
    seen = rng.integers(0, cm.SEEN, 66).astype(np.uint8)
    share = np.where((rng.random(66) < 0.8) & (seen > 0), rng.integers(0, 200, 66), 255).astype(np.uint8)
    found = rng.random((cm.SEEN, cm.STREAKS))
    found[0] = 0
    got = cm.text_scores(lid, lengths, value, seen, share, found)
    for k, (a, z) in enumerate(((0, 40), (40, 41), (41, 66))):
        assert got[k] == pytest.approx(plain_score((lid[a:z], value[lid[a:z]]), seen[a:z], share[a:z], found))


def plain_mixer(t, rows, bits):
    """Slices by the leading bits of the bare word's hash; each learns, and gates are weighed by the decisions they saw."""
    slices = {}
    for r in rows:
        slices.setdefault(xxhash.xxh3_64_intdigest(r[1:].removesuffix(b" ")) >> (64 - bits), []).append(r)
    learnt = [cm.learn_slice(t, x) for x in slices.values()]
    told = sum(x[2] for x in learnt)
    mean = sum(x[0] * x[2][:, None] for x in learnt) / np.maximum(told, 1)[:, None]
    return np.where(told[:, None] > 0, mean, 1.4 / cm.ORDERS), sum(x[1] for x in learnt), len(slices)


@pytest.mark.parametrize("slice_tokens", [cm.SLICE, 100])
def test_whole_scores_against_plain_counts(spark, monkeypatch, slice_tokens):
    """The same model by dictionaries of words, pairs and triples, text by text; with one slice, and with several."""
    monkeypatch.setattr(cm, "SLICE", slice_tokens)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["the", "of", "der", "die"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(40)]
    texts += [texts[3], texts[9] + " tail", "Unseen Words, Here!", None, "the " * 30]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in cm.score(spark, d, block=200).collect()}  # many blocks
    logs, places = cm.learn_kinds(cm.marks(d)), cm._Marks()
    words = [tokens(t) for t in texts]
    of = [cm.kind_of(w, logs, places) for w in words]
    kinds = [[k] * len(w) for k, w in zip(of, words)]
    train = [i for i in range(len(texts)) if not out(i)]
    c = Counter(bytes([k]) + w for i in train for k, w in zip(kinds[i], words[i]))
    base = Counter(w for i in train for w in words[i])
    sums = np.zeros((cm.KINDS + 1, 4), np.int64)
    for k, x in [(k, [n for w, n in c.items() if w[0] == k]) for k in range(cm.KINDS)] + [(-1, list(base.values()))]:
        sums[k] = sum(x), len(x), x.count(1), x.count(2)
    names = sorted({bytes([k]) + w for ks, ws in zip(kinds, words) for k, w in zip(ks, ws)})
    rows, _ = cm.spelled([w for w in names if c[w]])
    t = cm.Tables([])
    e = cm.Events(rows)
    for k, slots, y in e.bits():
        for j, s in enumerate(slots):
            np.add.at(t.counts[j].reshape(-1), 2 * s + y, e.weight)
    t.ready()
    *mixer, n_slices = plain_mixer(t, rows, cm.Scale(sum(map(len, words))).slice_bits)
    assert n_slices > 8 if slice_tokens == 100 else n_slices == 1
    model = cm.Model(t, *mixer)
    value = dict(zip(names, cm.by_counts(np.array([w[0] for w in names]), np.array([c[w] for w in names]), np.array([base[w[1:]] for w in names]), np.array([-np.inf if base[w[1:]] else x for w, x in zip(names, model.log10(names))]), sums)))
    grams = [[((a, b), w) for a, b, w in zip([None, None, *ws], [None, *ws], ws)] for ws in words]
    pairs, triples = Counter(g[0] for i in train for g in grams[i]), Counter(g for i in train for g in grams[i])
    coded = []
    for i, g in enumerate(grams):
        own = (Counter(x[0] for x in g), Counter(g)) if i in train else (Counter(), Counter())
        n = [(pairs[x[0]] - own[0][x[0]], triples[x] - own[1][x]) for x in g]
        coded.append([(min(cm.SEEN - 1, 1 + int(math.log2(p))) if p else 0, math.ceil(-16 * math.log2(m / p) - 1e-9) if m else 255) for p, m in n])
    hits, total = np.zeros((2, cm.SEEN, cm.STREAKS))
    for i in train:
        run = 0
        for s, q in coded[i]:
            cell = s, min(cm.STREAKS - 1, math.ceil(math.log2(run + 1)))
            hits[cell] += q < 255
            total[cell] += 1
            run = run + 1 if q < 255 and s else 0
    found = cm.learn_found(hits, total)
    for i in range(len(texts)):
        keys = [bytes([k]) + w for k, w in zip(kinds[i], words[i])]
        want = plain_score((keys, [value[k] for k in keys]), *zip(*coded[i]), found) + logs[-1][of[i]] / math.log(10)
        assert got[i]["score"] == pytest.approx(want, rel=2e-3, abs=0.02)  # values are sent in steps of 1/512
        assert got[i]["bits"] == pytest.approx(-got[i]["score"] * math.log2(10))
        assert got[i]["bits_per_byte"] == pytest.approx(got[i]["bits"] / max(1, len((texts[i] or "").encode())))


def test_shared_beginnings_change_nothing():
    model = random_model(np.random.default_rng(1))
    words = sorted(bytes([k]) + w for k in (0, 1) for w in (b"a", b"ab", b"abc", b"abd", b"b", b"the", b"then", b"\n", b"z" * 200, b"y" * 10_000))
    together = model.log10(words)
    assert np.allclose(together, [model.log10([w])[0] for w in words])


def test_held_out_texts_teach_nothing(spark):
    k = next(i for i in range(7, len(TEXTS)) if out(i))
    changed = [("zzz " * 9 if i == k else t) for i, t in enumerate(TEXTS)]
    a = {r["doc_id"]: r["score"] for r in cm.score(spark, docs(spark, TEXTS)).collect()}
    b = {r["doc_id"]: r["score"] for r in cm.score(spark, docs(spark, changed)).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a if i != k)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    d = docs(spark, TEXTS)
    a = {r["doc_id"]: (r["score"], r["base_score"]) for r in cm.score(spark, d).collect()}
    b = {r["doc_id"]: (r["score"], r["base_score"]) for r in cm.score(spark, d.repartition(5), block=50).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_keys_go_through_slices():
    scale = cm.Scale(1 << 26)
    assert scale.slice_bits == 5 and cm.Scale(0).slice_bits == 0 and cm.Scale(1 << 60).slice_bits == 39
    h = np.sort(mix_of(1000))
    assert (np.diff(scale.slice_of(h)) >= 0).all() and scale.slice_of(h).max() < 32
    x = np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (cm.from_planes(cm.planes(x)) == x).all()


def mix_of(n):
    return cm.mix(np.arange(n, dtype=np.uint64))


def test_repeated_text_is_learnt(scored):
    known = [i for i in scored if i >= 7 and scored[i]["held_out"]]
    assert known and all(scored[i]["score"] / scored[i]["n_tokens"] > scored[6]["score"] / scored[6]["n_tokens"] for i in known)


def test_copies_are_told_apart_and_own_words_are_not(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 300, 80)) for _ in range(60)]
    texts += texts[:10]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in cm.score(spark, docs(spark, texts)).collect()}
    copies = [got[i] for i in range(10) if not out(60 + i)]
    assert min(copies) > max(got[i] for i in range(10, 60)) / 2


def test_nulls_repeats_and_no_rows(spark):
    d = table(spark, [(None, "a b", None, None, None), (1, "a b", None, None, None), (1, "a b", None, None, None)])
    got = cm.score(spark, d).collect()
    assert len(got) == 3 and {r["train_tokens"] for r in got} == {9 - 3 * sum(out(1) for _ in range(2))}
    assert cm.score(spark, table(spark, [])).collect() == []


def test_long_words(spark):
    rng = np.random.default_rng(6)
    word = bytes(rng.integers(97, 123, 2_000_000, dtype=np.uint8)).decode()
    k = next(i for i in range(20) if out(i))
    got = {r["doc_id"]: r for r in cm.score(spark, docs(spark, [word if i == k else "a b c" for i in range(20)])).collect()}
    assert got[k]["n_tokens"] == 2 and got[k]["bits_per_byte"] > math.log2(26)  # letters nobody has seen


def test_kinds_are_learnt_from_whole_texts(spark):
    """What tells two kinds of texts apart comes after 150 words and 5000 characters that all share."""
    head = " ".join(f"{'header' * 6}{j}" for j in range(150))
    texts = [head + " " + " ".join(f"{'s' if i % 2 else 'i'}{(i * j) % 50}" for j in range(1, 40)) for i in range(120)]
    logs = cm.learn_kinds(cm.marks(docs(spark, texts)))
    kinds = [cm.kind_of(tokens(t), logs, cm._Marks()) for t in texts]
    assert not set(kinds[::2]) & set(kinds[1::2])


def test_words_seen_once_are_entered_everywhere(spark):
    merged = spark.createDataFrame([(cm.pack(b"\x00zebra \x01zebra", np.array([1, 1]), np.array([2, 2])),)], "words binary")
    t = cm.Tables([bytes(r["data"]) for r in cm._counted(merged).orderBy("part").collect()])
    assert [c.sum() for c in t.counts] == [2 * 8 * len("zebra ")] * cm.ORDERS


def test_every_occurrence_is_entered(spark):
    """Words and beginnings that they share count as often as words come in training texts, also where a float would be full."""
    joined, times = b"\x00zebra \x00zebu \x00zen \x01zebra", np.array([3, 5, 0, 20_000_001])
    merged = spark.createDataFrame([(cm.pack(joined, times, times),)], "words binary")
    t = cm.Tables([bytes(r["data"]) for r in cm._counted(merged).orderBy("part").collect()])
    want = 8 * (len("zebra ") * 20_000_004 + len("zebu ") * 5)
    assert [c.sum(dtype=float) for c in t.counts] == pytest.approx([want] * cm.ORDERS, rel=1e-7)
    rows, n = cm.training_rows(joined, times)
    e = cm.Events(rows)
    assert (rows, n.tolist()) == ([b"\x00zebra ", b"\x00zebu ", b"\x01zebra "], [3, 5, 20_000_001])
    assert e.times(n)[e.cells[:3]].tolist() == [8, 8, 8] and e.times(np.ones(3)).tolist() == e.weight.tolist()


def test_unseen_words_are_coded_alike_in_all_slices(spark, monkeypatch):
    """Words of one letter, which no training text has, one in each held-out text: with several slices their chances still
    add up to less than one."""
    train = ["abc abd abe bcd cde", "abc xyz", "xyz abd"] * 8
    held = [i for i in range(4000) if out(i)][:26]
    texts = {i: chr(97 + k) for k, i in enumerate(held)}
    rows = [(i, texts.get(i, train[i % len(train)]), None, None, None) for i in range(max(held) + 1)]
    monkeypatch.setattr(cm, "SLICE", 50)
    got = {r["doc_id"]: r for r in cm.score(spark, table(spark, rows)).collect()}
    assert cm.Scale(sum(r["n_tokens"] for r in got.values())).slice_bits > 2
    assert sum(10 ** got[i]["score"] for i in held) < 1


def test_known_words_go_through_the_bit_mixer(spark):
    """Of two words that one training text has once, the one that is spelled like others is likelier; by counts they are alike."""
    family = [" ".join(f"{a}ation{b}" for a in ("st", "ration", "fix", "rot", "vex")) for b in ("al", "ally", "less", "ism", "ist", "ing")]
    train = [*family, "hesitational donationally citational qzxjkvwpqyhm mutational"]  # most words come once, so counts leave much
    held = dict(zip((i for i in range(99) if out(i)), ("donationally", "qzxjkvwpqyhm")))
    ids = [i for i in range(99) if not out(i)][: len(train)]
    rows = [(i, t, None, None, None) for i, t in [*held.items(), *zip(ids, train)]]
    got = {held[r["doc_id"]]: r for r in cm.score(spark, table(spark, rows)).collect() if r["held_out"]}
    assert [r["n_known"] for r in got.values()] == [2, 2]
    assert got["donationally"]["base_score"] == got["qzxjkvwpqyhm"]["base_score"]
    assert got["donationally"]["score"] > got["qzxjkvwpqyhm"]["score"] + 1 / 512
