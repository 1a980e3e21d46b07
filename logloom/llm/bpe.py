"""Byte-level BPE: a sentencepiece model written out from a rank table, encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logloom.llm.blocks import blocks

#: Pieces a worker remembers before it starts anew, and the longest piece remembered.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is visible, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (2**64 - 1))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A BPE model whose piece i is token i, byte-mapped, with score -i.

    Normalisation is the identity: no added space, no removed or replaced white
    space. The unknown piece comes last and is never produced, because all 256
    bytes are tokens.
    """
    chars = byte_characters()
    pieces = b"".join(
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-i)) + _field(3, 1))
        for i, token in enumerate(tokens)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + b"".join(_field(k, -1) for k in (41, 42, 43))
    trainer += _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Pieces(dict):
    """Remembers what a pre-token encodes to, as the bytes of its little-endian ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<u4").tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes texts pre-token by pre-token and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        by_rank = sorted(ranks, key=ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(by_rank))
        self.rank_of = [ranks[t] for t in by_rank]
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.ranks = ranks
        self.table = byte_characters()
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self._piece)

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        # A pre-token that is itself a token needs no merges.
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        mapped = "".join(map(self.table.__getitem__, raw))
        return [self.rank_of[i] for i in self.model.encode(mapped)]

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids of every text of ``docs`` (doc_id, text) and the text decoded from them again.

    ``path`` names a rank table that every executor can read, ``pattern`` the
    pre-token pattern. Returns doc_id, n_tokens, ids and decoded bytes, or with
    ``digests`` their SHA-256 in place of the last two. A map over Arrow batches
    without a shuffle. A null text counts as an empty one, which has no ids;
    repeated rows and null ids keep their rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for block in blocks(batches):
            ids = [use.encode(t or "") for t in block.column("text").to_pylist()]
            decoded = [use.decode(x) for x in ids]
            count = pa.array([len(x) // 4 for x in ids], pa.int64())
            head = [block.column("doc_id").cast(pa.int64()), count]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    head + [pa.array([hashlib.sha256(x).hexdigest() for x in many]) for many in (ids, decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                # Ids of a vocabulary fit a signed 32-bit column.
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(ids), "<i4")),
                )
                yield pa.RecordBatch.from_arrays(
                    head + [lists, pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"]
                )

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {rest}")
