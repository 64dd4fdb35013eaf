import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from skydrift.llm import sentence_pieces as sp

from .conftest import docs, table, with_clashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sp.codec(f.read())


ODD = st.text(st.sampled_from("abcdehinorst  \n\t.,'<>/▁éß日\U0001f600\u0000 ​0123ABC"), max_size=80)


@given(st.one_of(ODD, st.text(max_size=60)))
@settings(max_examples=1500, deadline=None)
def test_ids_of_the_library(library, codec, text):
    text = text.encode("utf-8", "ignore").decode()  # no lone surrogates
    ids = codec.encode(text)
    assert ids.tolist() == library.encode(text)
    assert codec.decode(ids) == library.decode(ids.tolist())


def test_whole_texts_of_the_sample(library, codec, sample):
    for (text,) in sample.select("text").collect():
        assert codec.encode(text or "").tolist() == library.encode(text or "")


def test_runs_of_one_character(library, codec):
    for c in " aeo-=.\n▁é一\U0001f600/0":
        for n in [*range(1, 70), 1000, 1001]:
            for t in (c * n, f"x{c * n}y", f" {c * n} "):
                assert codec.encode(t).tolist() == library.encode(t), (c, n)


def test_each_character_and_piece(library, codec):
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x4E00, 0x5200)) + list(range(0x1F300, 0x1F700))
    for c in points:
        t = f"a{chr(c)}b {chr(c)}"
        assert codec.encode(t).tolist() == library.encode(t), hex(c)
    for i in range(0, 32000, 3):
        t = "a" + library.id_to_piece(i) + library.id_to_piece((i * 7919 + 11) % 32000)
        assert codec.encode(t).tolist() == library.encode(t)


def test_last_tokens_are_those_of_each_prefix(library, codec):
    text = "▁internationalisation▁▁of▁preémption日\U0001f600nnnnnn"
    last = codec.last_tokens(text)
    for i in range(1, len(text) + 1):
        assert codec.merged(text[:i])[-1] == (codec.text[last[i]] if last[i] else text[i - 1])


def test_cuts_change_nothing(codec):
    text = "▁some▁words\n\nand\t▁▁more:▁" + "x" * 300
    assert "".join(codec.cut(text)) == text
    assert b"".join(codec._stretch(p) for p in codec.cut(text)) == codec._stretch(text)


def test_what_is_kept_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(sp, "MOST", 20)
    monkeypatch.setattr(sp, "PAIRS", 50)
    kept = sp._Kept(codec._stretch)
    for i in range(500):
        word = f"▁w{i % 37}"
        assert kept[word] == codec._stretch(word) and len(kept) <= 20 and len(kept.old) <= 20
        assert len(codec.pairs) <= 50 + len(word)
    assert kept["y" * 100] and "y" * 100 not in kept


def test_other_models_are_refused(codec):
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(MODEL, "rb") as f:
        spec = proto.ModelProto.FromString(f.read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="BPE"):
        sp.Codec(spec.SerializeToString())
    spec.trainer_spec.model_type = proto.TrainerSpec.BPE
    spec.pieces[300].type = proto.ModelProto.SentencePiece.USER_DEFINED
    with pytest.raises(ValueError, match="user-defined"):
        sp.Codec(spec.SerializeToString())


def test_table(spark, library):
    texts = ["Hello, world.", None, "", " ", "a  b\n\nc", "<s> x </s>", "été 日本 \U0001f600", "word " * 30000, "q" * 50000]
    df = docs(spark, [*texts, texts[0]]).unionByName(table(spark, [(None, "no id", None, None, None)]))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sp.digest(with_clashes(df), MODEL).collect()}
    want = set()
    for i, t in [*enumerate([*texts, texts[0]]), (None, "no id")]:
        ids = library.encode(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == want
    assert sp.digest(df.limit(0), MODEL).count() == 0


def test_round_trip_of_both_operators(spark, sample):
    back = sp.decode(sp.encode(sample, MODEL).withColumnRenamed("doc_id", "text"), MODEL, to="decoded").join(sample.selectExpr("doc_id AS text", "text AS original"), "text")
    assert back.where("decoded <> coalesce(original, '')").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["text"] for r in sp.decode(nulls, MODEL).collect()} == {""}


def test_a_stretch_without_cuts_is_linear(codec):
    ids = codec.encode("ab" * 200_000)
    assert isinstance(ids, np.ndarray) and len(ids) > 100_000
