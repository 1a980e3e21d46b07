"""Texts of an Arrow batch as one byte array, cut into bounded blocks, and hashes over them in numpy.

Every operator that runs numpy in Spark tasks takes its texts from here. Documents
lie side by side in ``data``; ``starts`` has their offsets (one more than there
are documents), so that one numpy call covers all documents of a block.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
_RANDOM = np.random.default_rng(20240607)
#: Random odd values of the 256 bytes, and odd multipliers of two independent hashes.
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
FACTORS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))

#: 0x20 and 0x09-0x0D separate words.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False


class Block:
    """Some rows of a batch with the bytes of their texts; a null text is empty."""

    def __init__(self, rows: pa.RecordBatch, column: str = "text"):
        text = pc.fill_null(rows.column(rows.schema.get_field_index(column)).cast(pa.large_string()), "")
        _, offsets, data = text.buffers()
        self.rows = rows
        at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.starts = at - at[0]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[self.starts[1:]] - upto[self.starts[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last-plus-one byte of each word, and the first word of each document (one more at the end)."""
        solid = SOLID[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.starts] = True
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        begin = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return begin, end, np.searchsorted(begin, self.starts)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batches' rows in blocks of at most ``size`` bytes of text (or one row)."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        upto = np.concatenate([[0], np.cumsum(length.to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1)
            yield Block(batch.slice(at, to - at), column)
            at = to


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns freed memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return what numpy and Arrow have freed: a worker lives on after its task and would hold it."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back when its task's input has ended."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Seconds between two returns of memory within a task; each one costs the pages that are touched again.
PAUSE = 1.0
_returned = 0.0


def _now_and_then() -> None:
    global _returned
    if time.monotonic() - _returned >= PAUSE:
        give_back()
        _returned = time.monotonic()


def tidy_group(run: Callable) -> Callable:
    """A function over one or two tables of a group that gives memory back now and then."""
    if run.__code__.co_argcount == 1:

        @wraps(run)
        def one(table: pa.Table) -> pa.Table:
            out = run(table)
            _now_and_then()
            return out

        return one

    @wraps(run)
    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        _now_and_then()
        return out

    return two


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(count: int, factor: int) -> np.ndarray:
    out = np.full(count, factor, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def piece_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: np.uint64 = FACTORS[0]) -> np.ndarray:
    """A 64-bit hash of the bytes of each piece ``begin`` to ``end``; pieces are disjoint and in order."""
    length = end - begin
    full = length > 0
    out = np.zeros(len(begin), U64)
    if full.any():
        size = length[full]
        first = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(first, size)
        source = inside + np.repeat(begin[full], size)
        power = _powers(1 << int(size.max()).bit_length(), int(factor))
        out[full] = np.add.reduceat(BYTE_VALUE[data[source]] * power[inside], first)
    return mix(out + length.astype(U64) * FACTORS[1])


def gram_hashes(values: np.ndarray, n: int, factor: np.uint64 = FACTORS[0]) -> np.ndarray:
    """Rolling hash of every run of ``n`` values, from hashes of doubled lengths; unmixed."""
    power, have, out = np.array([factor]), 1, values  # an array wraps without a warning
    while have * 2 <= n:
        out = out[:-have] * power + out[have:]
        power, have = power * power, have * 2
    if have < n:
        # Two overlapping runs name the longer one.
        shift = n - have
        out = out[:-shift] * (power * U64(3)) + out[shift:]
    return out


def repeats(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered(count: int, begin: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions inside a run of ``length`` from any of the places in ``begin``."""
    step = np.zeros(count + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + length, -1)
    return np.cumsum(step[:-1]) > 0
