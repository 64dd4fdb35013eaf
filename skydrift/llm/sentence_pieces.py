"""SentencePiece BPE ids from a table of prefixes, and texts from ids.

Every prefix of a text has its own encoding, and the last token of that encoding is unique: among the pieces that
end where the prefix ends (one automaton over all pieces finds them) it is the one that is compatible with the
last token of the shorter prefix before it, which is when both, merged alone, stay those two tokens. So one pass
stores a last token for each prefix, and the ids follow backwards from the end, without a queue of merges. A pair
is tested once by merging its two tokens' characters, best score first and of equal scores the leftmost, and kept.

Text is cut first where no piece of the model lies across (see Codec._cutter). What such a stretch gave is kept for the next one that is equal, by each
worker, up to `MOST` stretches of at most `LONG` characters; a model whose pieces span blanks gets whole texts.

Models of kind BPE with identity normalisation and without user-defined or unused pieces are taken, others are
refused. No text is begun or ended with control ids, and the names of control pieces in a text are ordinary text.
Null texts are empty and give no ids; repeated rows and rows without doc_id are encoded like all others; an empty
table gives no rows; columns other than doc_id and text are ignored. Texts have no limit of length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim

BLANK = "▁"
#: Characters that are no piece are tokens from here on.
ALONE = 1 << 21
#: Stretches of text that a worker keeps, twice; how long they are at most; pairs of tokens it keeps.
MOST, LONG, PAIRS = 250_000, 64, 500_000
#: Documents that go to a worker's memory at once.
ROWS = 200


class _Kept(dict):
    """Ids of stretches, in two generations: what comes again moves to the new one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            ids = self.make(stretch)
        if len(stretch) <= LONG:
            if len(self) >= MOST:
                self.old = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


class Codec:
    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        kind = proto.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model isn't BPE with identity normalisation")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.library = SentencePieceProcessor(model_proto=model)
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.text = {i: p for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cut = self._cutter()
        self.kept = _Kept(self._stretch)

    def _cutter(self):
        """How a text falls into stretches that no piece lies across: before a blank that follows something else, around
        characters that no longer piece holds, and between a word's character and a mark that follows it in no piece."""
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            return lambda text: [text] if text else []
        ascii_ = [chr(c) for c in range(128)]
        inside = {c for p in self.score if len(p) > 1 for c in p}
        after = {y for p in self.score for x, y in zip(p, p[1:]) if x.isalnum() or x == "_"}
        some = lambda chars: "".join(map(re.escape, chars))
        alone = some(c for c in ascii_ if c not in inside)
        cut = some(c for c in ascii_ if c in inside and not (c.isalnum() or c == "_") and c not in after)
        word, mark = rf"[^\W{alone}{BLANK}]", rf"[^\w{alone}{BLANK}]"
        joined = f"(?:(?![{cut}]){mark}+)?" if cut else f"{mark}*"
        return re.compile((f"[{alone}]|" if alone else "") + f"(?=.){BLANK}*{mark}*(?:{word}+{joined})*", re.DOTALL).findall

    def merged(self, text: str, edge: int = -1) -> list[str]:
        """The tokens of a short text by merging: the best neighbours first, of equal ones the leftmost. Ends early,
        without a result, where what lies on both sides of a character's end (edge) would merge."""
        get, none = self.score.get, -math.inf
        parts = list(text)
        scores = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            if i == edge:
                return []
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            edge -= i < edge
        return parts

    def _of(self, token: int) -> str:
        return self.text[token] if token < ALONE else chr(token - ALONE)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens that follow each other stay apart."""
        a, b = self._of(left), self._of(right)
        return bool(self.merged(a + b, len(a) - 1))

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix its encoding's last token. A character that no piece ends with stands alone."""
        last, pairs = [0] * (len(text) + 1), self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, (size, token) in self.automaton.iter(text):
            i = end + 1
            if last[i]:
                continue
            j = i - size
            if j:
                before = last[j]
                if not before:  # all pieces that end there have been looked at
                    before = last[j] = ALONE + ord(text[j - 1])
                pair = before << 22 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.compatible(before, token)
                if not fits:
                    continue
            last[i] = token
        return last

    def _stretch(self, text: str) -> bytes:
        last, i, out = self.last_tokens(text), len(text), []
        while i:
            token = last[i]
            if token:
                out.append(token)
                i -= len(self.text[token]) if token < ALONE else 1
                continue
            last[i] = ALONE + ord(text[i - 1])
        return np.array(self._ids(out[::-1]), np.int32).tobytes()

    def _ids(self, tokens: list[int]) -> list[int]:
        """Characters that are no piece become their bytes' pieces, or unknown ones."""
        if not tokens or max(tokens) < ALONE:
            return tokens
        spelled = lambda t: [self.bytes[b] for b in chr(t - ALONE).encode()] if self.bytes else [self.unknown]
        return [i for t in tokens for i in (spelled(t) if t >= ALONE else (t,))]

    def encode(self, text: str) -> np.ndarray:
        whole = self.prefix + text.replace(" ", BLANK) if text else ""
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.cut(whole))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # a vocabulary, some hundred kilobytes, whatever the corpus
        return f.read()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    model = _model(model_path)
    codec(model)  # refuses what it can't encode before any task starts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])
        trim()

    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return docs.select("doc_id", "text").mapInArrow(task, schema)


def decode(tokens: DataFrame, model_path: str, to: str = "text") -> DataFrame:
    """tokens(ids, ...) with the text of their ids; null ids are none."""
    model = _model(model_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                column = part.column(at)
                flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
                texts = [c.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to])
        trim()

    return tokens.mapInArrow(task, T.StructType([*tokens.schema, T.StructField(to, T.StringType(), False)]))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text that they decode to."""
    both = decode(encode(docs, model_path), model_path)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))
