import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skydrift.llm import token_codes as tc

from .conftest import docs, table, with_clashes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=3000), st.data())
@settings(max_examples=40, deadline=None)
def test_any_token_and_any_span(ids, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=5)))
    sizes = np.diff([0, *cuts, len(ids)]).tolist()
    c = tc.Codes(tc.pack(list(range(len(sizes))), sizes, np.array(ids, np.uint32)))
    assert c.span(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 1 + len(ids) // 50):
        assert c[i] == ids[i]
        j = data.draw(st.integers(i, len(ids)))
        assert c.span(i, j).tolist() == ids[i:j]
    assert np.concatenate([c.document(k) for k in range(c.n_docs)]).tolist() == ids if sizes else True


@given(st.lists(st.text(st.sampled_from("ab éÉ,.'\n\t  1Z \x1c日!<|>"), max_size=40), max_size=20))
@settings(max_examples=150, deadline=None)
def test_pieces_give_what_whole_texts_give(texts):
    enc, t = tc.encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text, got in zip(texts, enc(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_every_character_is_cut_as_the_tokenizer_cuts():
    """Python and the tokenizer may know letters of different Unicode releases; each character stands in words, before
    marks and alone."""
    enc, t = tc.encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    points = [c for c in [*range(0x33480), *range(0xE0000, 0xE01F0)] if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 4000):
        texts = [f"x{chr(c)}y {chr(c)}, z{chr(c)}.\n{chr(c)}" for c in points[a : a + 4000]]
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        for text, got, ids in zip(texts, enc(texts), want):
            assert np.frombuffer(got, "<u4").tolist() == ids, hex(ord(text[1]))


TEXTS = ["Hello, world.", None, "", "a  b\n\nc", "<|endoftext|> x", " lead", "trail ", "don't we'll 'twas. it,", "x\ty", "word " * 5000, "été, où. ça!"]


def test_added_tokens_are_the_tokenizers(tmp_path):
    """A vocabulary with added tokens of its own, within a word, of two words, and with a line feed."""
    t = Tokenizer.from_file(VOCABULARY)
    t.add_special_tokens(["<|turn|>", "<|a b|>"])
    t.add_tokens(["<x>\n"])
    t.save(str(tmp_path / "more.json"))
    texts = ["hi <|turn|> you", "a<|turn|>b, c", "see <|a b|> there <|a", "b|> x", "end <x>\nnext", "<x> \n", "<|endoftext|>", "plain words, here."]
    for text, got in zip(texts, tc.Encoder(str(tmp_path / "more.json"))(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_files_round_trip(spark, whole):
    d = with_clashes(docs(spark, TEXTS, first=3)).repartition(3)
    got = [tuple(r) for r in tc.encode(spark, d, VOCABULARY).orderBy("doc_id").collect()]
    at, want = 0, []
    for i, t in enumerate(TEXTS):
        ids = [*whole(t or ""), 2]
        want.append((i + 3, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_small_files_nulls_and_no_rows(spark, tmp_path, whole):
    d = table(spark, [(1, "b c", None, None, None), (1, "a", None, None, None), (None, "z", None, None, None), (0, "y", None, None, None)])
    m = tc.write_files(d, f"file://{tmp_path}/f", VOCABULARY, 2, tokens_a_file=2)
    m.write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    got = sorted(map(tuple, tc.read_files(m, f"file://{tmp_path}/f").collect()), key=lambda r: r[1])
    assert [(r[0], r[2]) for r in got] == [(None, 2), (0, 2), (1, len(whole("a")) + 1), (1, len(whole("b c")) + 1)]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert m.count() >= 3
    assert tc.encode(spark, table(spark, []), VOCABULARY).collect() == []
