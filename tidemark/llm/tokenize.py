"""Encoding of the whole corpus with a public byte-level BPE vocabulary, by sentencepiece."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens with ids kept per Python worker; beyond it the store is emptied, never the text.
STORE = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable in Latin-1, else from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens by rank; ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == 2 else body)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks.

    Pieces are the tokens in byte letters, scored by negative rank, so the best merge is always the
    one of lowest rank. Normalisation is the identity and no white space is added, removed or
    escaped. One unknown piece follows the vocabulary; byte letters cover every input, so it is
    never used.
    """
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", -float(len(tokens)))) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens)))
    trainer += b"".join(_field(n, 0, _varint(2**64 - 1)) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encodes texts to ids and back."""

    def __init__(self, model: bytes, split: str):
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(split)
        letters = byte_letters()
        self._to = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        self._back = {c: b for b, c in enumerate(letters)}
        self._store: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; empty for an empty or null one. Special tokens' strings are text."""
        if not text:
            return []
        store, out = self._store, []
        for piece in self._split.findall(text):
            ids = store.get(piece)
            if ids is None:
                if len(store) >= STORE:
                    store.clear()
                ids = self._sp.encode(piece.encode("utf-8", "replace").decode("latin-1").translate(self._to))
                if len(piece) <= 64:
                    store[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        letters = "".join(self._sp.id_to_piece(int(i)) for i in ids)
        return bytes(self._back[c] for c in letters).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(digest: str, model: bytes, split: str) -> Codec:
    return Codec(model, split)


def encode_column(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> Column:
    """A column of token ids for ``text_col``.

    The model is built once on the driver from the vocabulary file (about 1 MB, whatever the corpus)
    and broadcast. Arrow batches of texts are encoded in Python workers, whole texts always. Null
    and empty texts give an empty list.
    """
    model = serialise_model(read_ranks(vocabulary or vocabulary_path()))
    shared = df.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model, pattern()))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(*shared.value)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts])

    return ids(F.col(f"`{text_col}`"))


def decode_column(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> Column:
    """The texts of a column of ids, by the inverse byte mapping."""
    model = serialise_model(read_ranks(vocabulary or vocabulary_path()))
    shared = df.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model, pattern()))

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(*shared.value)
        for ids in batches:
            yield pd.Series([codec.decode(i) for i in ids])

    return texts(F.col(f"`{ids_col}`"))
