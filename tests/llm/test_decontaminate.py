import hashlib
import re

from skydrift.llm import decontaminate

from .conftest import docs, table, with_clashes

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then sleeps all day."), (2, "Short one"), (3, "The quick brown fox jumps over the lazy dog and walks"), (None, "Null item of just words"), (5, None), (6, "...")]
TEXTS = ["Well: the QUICK, brown fox jumps over the lazy dog and then sleeps! End.", "the quick brown fox jumps over the lazy dog", "a short  one here; short\none", "Über short one", "overshort one", None, "", "é short one é", "null item of just words", "x " * 20_000 + "short one", "the quick brown fox jumps over the lazy dog and and then sleeps all day"]


def brute(texts, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in enumerate(texts):
        words, hit, found = w(t), set(), set()
        for key, text in items:
            v = w(text)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add("null" if key is None else str(key))
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id int, text string")


def test_against_brute_force(spark):
    got = decontaminate.verdicts(with_clashes(docs(spark, TEXTS)), bench(spark))
    assert sorted(map(tuple, got.collect())) == brute(TEXTS, ITEMS)


def test_several_automata_say_the_same(spark):
    d, b = docs(spark, TEXTS), bench(spark)
    one = {r["doc_id"]: (r["n_words"], r["runs"], r["items"]) for r in decontaminate.scanned(d, b).collect()}
    many = {r["doc_id"]: (r["n_words"], r["runs"], r["items"]) for r in decontaminate.scanned(d, b, item_bytes=40).collect()}
    assert one == many


def test_clean_and_spans(spark):
    d, b = with_clashes(docs(spark, TEXTS)), bench(spark)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute(TEXTS, ITEMS) if not r[5]]
    spans = {r["doc_id"]: r["passage"] for r in decontaminate.contaminated_spans(docs(spark, TEXTS), b).collect() if r["doc_id"] in (0, 7)}
    assert spans == {0: "the QUICK, brown fox jumps over the lazy dog and then sleeps", 7: "short one"}


def test_no_rows_and_no_items(spark):
    assert decontaminate.verdicts(table(spark, []), bench(spark)).collect() == []
    got = decontaminate.verdicts(docs(spark, TEXTS), bench(spark, [])).collect()
    assert not any(r["contaminated"] for r in got) and len(got) == len(TEXTS)


def test_pieces_of_long_texts_change_nothing():
    import random

    rng = random.Random(3)
    items = [(str(k), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 16)))) for k in range(30)]
    a = decontaminate.automaton(items)
    for n in (1, 9, 10, 11, 200, 4000):
        text = "".join(rng.choice(["a", "B", "c", "d", "E", "f"]) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(n))
        assert decontaminate.scan(a, text, size=1 << 30) == decontaminate.scan(a, text, size=7) == decontaminate.scan(a, text, size=64)


def test_long_texts(spark):
    text = "word " * 4_000_000 + "short one " + "x" * 5_000_000
    got = decontaminate.verdicts(docs(spark, [text, text[:100]]), bench(spark)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [(4_000_003, 2), (20, 0)]
