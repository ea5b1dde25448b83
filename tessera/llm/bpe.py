"""Byte-level BPE: token ids of whole texts, and texts of token ids.

A rank file (base64 token and rank per line) is rewritten as a sentencepiece BPE model. Each
byte becomes one character, so a token is a piece of characters; a piece's score is its
negative rank, which makes the best pair the one of least rank; normalisation is the identity.
Texts are split into pre-tokens by a pattern, a pre-token that is a token itself is that
token, and every other one is encoded by the model. Decoding looks up the pieces' bytes.

The model is built once on the driver, checked against ``MODEL_MAX_BYTES`` and broadcast.
Tasks keep the ids of up to ``CACHE`` pre-tokens, which changes the speed and nothing else,
and walk a text some pre-tokens at a time, however long it is.

Defined results: a null or empty text has no tokens. Rows are treated one by one, repeated
ones too; other columns are carried along untouched. No special tokens are made or read.
A null list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_MAX_BYTES = 64 * 1024 * 1024
CACHE = 200_000
# Pre-tokens of a text that are held at a time.
CHUNK = 1 << 16
_TO_CHARS = {b: chr(0x100 + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value % 2**64)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARS)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece, piece i + 1 the token of i-th rank."""
    # Field numbers of the public model format: ModelProto 1 pieces, 2 trainer, 3 normaliser; SentencePiece
    # 1 piece, 2 score, 3 type (2 unknown); TrainerSpec 3 model type (2 BPE), 40 to 43 ids of unknown, start, end
    # and padding; NormalizerSpec 1 name, 3 dummy prefix, 4 extra white space, 5 escaped white space.
    out = [_block(1, _block(1, b"<unk>") + _number(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        score = _varint(2 << 3 | 5) + struct.pack("<f", -rank)
        out.append(_block(1, _block(1, as_piece(token).encode()) + score))
    out.append(_block(2, _number(3, 2) + _number(40, 0) + b"".join(_number(k, -1) for k in (41, 42, 43))))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


def _token_table(pieces: sentencepiece.SentencePieceProcessor, ids: np.ndarray) -> dict[int, bytes]:
    """The bytes of each id, from the pieces of the model."""
    names = (pieces.id_to_piece(i + 1) for i in range(len(ids)))
    return {k: bytes(ord(c) - 0x100 for c in name) for k, name in zip(ids.tolist(), names)}


class Tokenizer:
    """Encodes by a model of :func:`sentencepiece_model`; ``ids`` are the ranks in order."""

    def __init__(self, model: bytes, ids: np.ndarray, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.ids = ids
        self.rank_of = {token: rank for rank, token in _token_table(self.pieces, ids).items()}
        self.cache: dict[str, bytes] = {}  # ids as packed 32-bit numbers

    def _learn(self, pretokens: set[str]) -> None:
        """Put the ids of ``pretokens``, which it lacks, into the cache."""
        split = []
        for t in pretokens:
            rank = self.rank_of.get(t.encode())
            if rank is None:
                split.append(t)
            else:
                self.cache[t] = rank.to_bytes(4, "little")
        if not split:
            return
        found = self.pieces.encode([as_piece(t.encode()) for t in split], num_threads=1)
        ends = np.cumsum([4 * len(f) for f in found]).tolist()
        packed = self.ids[np.fromiter(chain.from_iterable(found), np.int64) - 1].astype("<i4").tobytes()
        for t, a, b in zip(split, [0, *ends], ends):
            self.cache[t] = packed[a:b]

    def _packed(self, pretokens: list[str]) -> list[bytes]:
        """The packed ids of at most ``2 * CHUNK`` pre-tokens."""
        found = list(map(self.cache.get, pretokens))
        if missing := [i for i, f in enumerate(found) if f is None]:
            new = {pretokens[i] for i in missing}
            if len(self.cache) + len(new) > CACHE:
                for old in list(islice(self.cache, CACHE // 2)):  # the first half came first
                    del self.cache[old]
            self._learn(new)
            for i in missing:
                found[i] = self.cache[pretokens[i]]
        return found

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the end of each text's ids in it."""
        parts, ends, base = [], [], 0
        held: list[str] = []  # pre-tokens not yet encoded
        cuts: list[int] = []  # where texts end among them

        def flush() -> None:
            nonlocal base
            packed = self._packed(held)
            total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))) // 4))
            ends.append(base + total[cuts])
            parts.append(np.frombuffer(b"".join(packed), "<i4"))
            base += int(total[-1])
            held.clear()
            cuts.clear()

        for text in texts:
            text = text or ""
            if len(text) <= CHUNK:
                held += self.pattern.findall(text)
            else:
                matches = self.pattern.finditer(text)
                while some := [m[0] for m in islice(matches, CHUNK)]:
                    held += some
                    if len(held) >= CHUNK:
                        flush()
            cuts.append(len(held))
            if len(held) >= CHUNK:
                flush()
        flush()
        return np.concatenate(parts), np.concatenate(ends)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=4)
def _tokenizer(model: bytes, ids: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(model, np.frombuffer(ids, np.int64), pattern)


@lru_cache(maxsize=4)
def _decoder(model: bytes, ids: bytes) -> dict[int, bytes]:
    """The table alone: a task that only decodes does not keep the model."""
    return _token_table(sentencepiece.SentencePieceProcessor(model_proto=model), np.frombuffer(ids, np.int64))


class ByteBPE:
    """The tokenizer of a rank file as column functions."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        model = sentencepiece_model(ranks)
        if len(model) > MODEL_MAX_BYTES:
            raise ValueError(f"a model of {len(model)} bytes is too large to broadcast")
        ids = np.array(sorted(ranks.values()), np.int64).tobytes()
        self._shared = spark.sparkContext.broadcast((model, ids, pattern))

    def encode(self, text: Column | str) -> Column:
        """The ids of a text, as an array of integers."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            ids, ends = _tokenizer(*shared.value).encode_all(t.as_py() for t in texts)
            if len(ids) < 2**31:
                return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids)
            return pa.LargeListArray.from_arrays(np.append(0, ends), ids)

        return encode.asNondeterministic()(text)  # so that no plan computes it twice

    def decode(self, ids: Column | str) -> Column:
        """The bytes of an array of ids."""
        shared = self._shared

        @F.arrow_udf("binary")
        def decode(lists: pa.Array) -> pa.Array:
            token_of = _decoder(*shared.value[:2]).__getitem__
            flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            return pa.array(
                [b"".join(map(token_of, flat[b - n : b].tolist())) for b, n in zip(ends, sizes)], pa.binary()
            )

        return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number and digest of its ids, digest of what they decode to."""
    bpe = ByteBPE(docs.sparkSession, path, pattern)
    tokens = docs.select("doc_id", bpe.encode("text").alias("ids"))
    decoded = tokens.select("doc_id", "ids", bpe.decode("ids").alias("decoded"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
