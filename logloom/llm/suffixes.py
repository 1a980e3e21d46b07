"""Removal of byte strings that an earlier document holds, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.blocks import BYTE_VALUE, U64, Block, gram_hashes, mix, piece_hashes
from logloom.llm.windows import Units, find_and_remove

#: Bytes of a string, and of the anchors that strings are dealt by.
DEPTH, ANCHOR = 50, 16
#: Bytes of a digit of the sort.
DIGIT = 8


def radix_groups(data: np.ndarray, suffix: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places in ``data``) whose first ``depth`` bytes another one shares, and their group numbers.

    Most significant digit first: each pass sorts the groups of the pass before
    by their next eight bytes and drops suffixes that are alone in their group,
    so only what is still equal is looked at again. The last digit may overlap
    the one before it; no byte beyond ``depth`` is read.
    """
    live = np.arange(len(suffix))
    group = np.zeros(len(suffix), np.int64)
    for offset in [*range(0, depth - DIGIT, DIGIT), depth - DIGIT]:
        key = digits(data, suffix[live] + offset)
        order = np.lexsort((key, group))
        key, ordered = key[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (ordered[1:] != ordered[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1
        live, group = live[order[many]], number[many]
        if not len(live):
            break
    return live, group


def digits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do."""
    out = np.zeros(len(at), U64)
    for k in range(DIGIT):
        out = out << U64(8) | data[at + k]
    return out


def candidates(data: np.ndarray, suffix: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places in ``suffix`` whose string may occur again: another one falls into the bin of its rolling hash.

    This only rules out; equal strings fall into one bin. A count of bins needs no sort.
    """
    if len(suffix) < 2:
        return np.zeros(0, np.int64)
    bits = U64(64 - int(8 * len(suffix)).bit_length())
    place = (mix(gram_hashes(BYTE_VALUE[data], depth)[suffix]) >> bits).astype(np.int64)
    return np.flatnonzero(np.bincount(place)[place] > 1)


def equal_contexts(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first one of every kind of context, and the kind of each; equal ones have equal bytes, not hashes alone."""
    start = np.cumsum(size) - size
    head, kind = np.unique(piece_hashes(data, start, start + size), return_index=True, return_inverse=True)[1:]
    first = head[kind]
    follows = np.flatnonzero(first != np.arange(len(size)))
    length = size[follows]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    if (size[first] != size).any() or (
        data[np.repeat(start[follows], length) + inside] != data[np.repeat(start[first[follows]], length) + inside]
    ).any():
        return np.arange(len(size)), np.arange(len(size))
    return head, kind


def judge(ident, at, many, size, data: np.ndarray) -> np.ndarray:
    """Strings that also start in a document with a smaller id.

    Contexts with the same bytes go through the sort as one, for the smallest
    of their documents; each of their strings has an owner at least as small.
    """
    head, kind = equal_contexts(data, size)
    own = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(own, kind, ident)
    count, length = many[head], size[head]
    begin, first = np.cumsum(length) - length, np.cumsum(count) - count
    data = data[np.arange(length.sum()) + np.repeat((np.cumsum(size) - size)[head] - begin, length)]
    which = np.repeat(np.arange(len(head)), count)
    suffix = np.arange(len(which)) + np.repeat(begin - first, count)
    least = own[which]
    maybe = candidates(data, suffix)
    live, group = radix_groups(data, suffix[maybe])
    live = maybe[live]
    if len(live):
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        smallest = np.minimum.reduceat(least[live], edge)
        least[live] = np.repeat(smallest, np.diff(np.append(edge, len(live))))
    each = np.repeat(np.arange(len(many)), many)
    place = first[kind][each] + np.arange(len(each)) - (np.cumsum(many) - many)[each]
    return ident[each] > least[place]


def _kept(block: Block, gone: np.ndarray) -> list[bytes]:
    return [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.starts[:-1], block.starts[1:])]


def _finish(block: Block, begin, end, first, gone) -> pa.RecordBatch:
    fresh = gone.copy()
    fresh[1:] &= ~gone[:-1]
    inner = block.starts[1:-1]
    inner = inner[inner < len(gone)]
    fresh[inner] = gone[inner]
    return pa.RecordBatch.from_arrays(
        [
            block.column("doc_id").cast(pa.int64()), pa.array(np.diff(block.starts), pa.int64()),
            pa.array(block.sums(gone)), pa.array(block.sums(fresh)), pa.array(_kept(block, gone), pa.binary()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def _digest(*args) -> pa.RecordBatch:
    whole = _finish(*args)
    digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in whole.column("kept")]
    return pa.RecordBatch.from_arrays(
        [*whole.columns[:4], pa.array(digest, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def remove_earlier_strings(docs: DataFrame, digests: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) without the bytes covered by a string of ``DEPTH`` bytes that an earlier document holds.

    Earlier: with a smaller doc_id. Strings overlap, do not cross documents and
    are judged on the input. Suffixes with equal anchors (``windows``) are
    ordered through ``DEPTH`` bytes only, by ``radix_groups``; equal groups are
    exactly the repeated strings.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the
    kept bytes (``digests``: their SHA-256). A null text has no bytes. Rows that
    share a doc_id count as one document. Null ids come after all others; equal
    texts among them count as one document. Columns in ``carry`` come along.
    """
    kept = "kept_sha256 string" if digests else "kept binary"
    return find_and_remove(
        docs, Units(False, DEPTH, ANCHOR), judge, False, _digest if digests else _finish,
        f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}", "suffixes", carry=carry,
    )
