"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

The rank file of the vocabulary is serialised directly as a sentencepiece BPE model: every piece is
written with its bytes mapped to printable characters and its negative rank as score, so that the
best-scored merge is the lowest rank; normalisation is the identity.  Texts are cut to pre-tokens by
the vocabulary's pattern, each distinct pre-token is encoded once per task, and the ids of a text
are the concatenation.  Decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k"


def tokenizer_folder(folder: str | None = None) -> str:
    """Folder of the public vocabulary files; they are read where they are and never copied."""
    if folder:
        return folder
    if env := os.environ.get("TOKENIZER_DIR"):
        return env
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks, with an unknown piece after them."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must be 0..n-1")
    out = [
        _message(1, _message(1, "".join(chars[b] for b in piece).encode()) + b"\x15" + struct.pack("<f", -float(rank)))
        for piece, rank in order
    ]
    out.append(_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    # trainer: BPE, ids of the special pieces, none but the unknown one
    trainer = _number(3, 2) + _number(40, len(order))
    for field in (41, 42, 43):
        trainer += _varint(field << 3) + b"\xff" * 9 + b"\x01"
    # normalizer: identity, no dummy prefix, white space left alone
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _message(2, trainer) + _message(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary; pre-tokens are cached, up to ``cache`` of them at a time."""

    def __init__(self, vocabulary: str = VOCABULARY, folder: str | None = None, cache: int = 400_000):
        import regex
        import sentencepiece

        import public_tokenizers

        ranks = read_ranks(os.path.join(tokenizer_folder(folder), vocabulary + ".tiktoken"))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.chars = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.pieces = [p for p, _ in sorted(ranks.items(), key=lambda kv: kv[1])]
        self.cache: dict[str, list[int]] = {}
        self.limit = cache
        self.table = {b: c for b, c in enumerate(self.chars)}

    def _learn(self, token: str) -> list[int]:
        mapped = token.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        ids = self.model.encode(mapped)
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, out = self.cache.get, []
        for token in self.find(text):
            out += get(token) or self._learn(token)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None) -> ByteBpe:
    return ByteBpe(vocabulary, folder)


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """(key, ids) of every row: token ids without special tokens, whose spellings are ordinary text.

    Null and empty texts give an empty list; repeated rows stay repeated; a null key stays null.  Only
    the two columns are read, so other columns, whatever their names, don't matter.  The texts are
    encoded where they are read: no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"]
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(
    df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """``keep`` and n_tokens (int) of every row; null and empty texts have 0 tokens."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
