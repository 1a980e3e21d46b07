"""Removal of word windows that occur more than once, by level-wise doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.blocks import SOLID, Block
from logloom.llm.windows import Units, find_and_remove

#: Words of a window, and of the anchors that windows are dealt by.
WINDOW, ANCHOR = 35, 8


def repeated_runs(names: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Marks the places where a run of ``length`` names starts that starts elsewhere too.

    ``left``: names from here to the end of its text. Level by level: only
    places whose run is repeated at one length, and followed by another repeated
    one, are named at twice that length; the last level joins two overlapping
    runs. Names are ranks of pairs of names, so equality is exact.
    """
    now, have = names.astype(np.int64), 1
    live = np.flatnonzero(left >= length)
    alive = np.ones(len(names), bool)
    while have < length and len(live):
        step = min(have, length - have)
        # Both halves must be repeated at this length.
        live = np.flatnonzero(alive[: max(0, len(now) - step)] & alive[step:] & (left[: max(0, len(now) - step)] >= have + step))
        pair = now[live] * (int(now.max(initial=0)) + 1) + now[live + step]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        alive = np.zeros(len(names), bool)
        again = count[rank] > 1
        alive[live[again]] = True
        now = np.zeros(len(names), np.int64)
        now[live] = rank
        have += step
    out = np.zeros(len(names), bool)
    if have >= length:
        out = alive & (left >= length)
    return out


def judge(ident, at, many, size, data: np.ndarray) -> np.ndarray:
    """Windows whose word sequence starts elsewhere too."""
    first = np.cumsum(size) - size
    solid = SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    edge[-1] = True
    begin = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1
    compact = data[solid]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(compact.tobytes())]
    ).dictionary_encode()
    names = words.indices.to_numpy(zero_copy_only=False)
    bounds = np.searchsorted(begin, np.append(first, len(data)))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(begin))
    found = repeated_runs(names, left, WINDOW)
    which = np.repeat(np.arange(len(many)), many)
    return found[bounds[which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]]


def _finish(block: Block, begin, end, first, gone) -> pa.RecordBatch:
    keep = ~gone
    size = (end - begin)[keep]
    doc = np.repeat(np.arange(len(block)), np.diff(first))[keep]
    # Kept words with one space after each, cut to their documents.
    upto = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.arange(upto[-1]) + np.repeat(begin[keep] - upto[:-1], size + 1)
    joined = block.data[np.minimum(source, max(len(block.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    joined = joined.copy()
    joined[upto[1:] - 1] = 0x20
    edge = upto[np.searchsorted(doc, np.arange(len(block) + 1))]
    texts = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    removed = np.bincount(np.repeat(np.arange(len(block)), np.diff(first))[gone], minlength=len(block))
    return pa.RecordBatch.from_arrays(
        [
            block.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()),
            pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_text"],
    )


def _digest(*args) -> pa.RecordBatch:
    whole = _finish(*args)
    digest = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in whole.column("kept_text")]
    return pa.RecordBatch.from_arrays(
        [*whole.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
    )


def remove_repeated_windows(docs: DataFrame, digests: bool = False) -> DataFrame:
    """docs (doc_id, text) without the words covered by a repeated window of ``WINDOW`` words.

    A window is that many consecutive words of one document; it is repeated if
    its words, unchanged, also start anywhere else, in the same document too.
    Windows are judged on the input. Which windows repeat is found by doubling
    (``repeated_runs``) among windows with equal anchors (``windows``).

    Returns doc_id, n_words, n_removed and the kept words joined by one space
    (``digests``: their SHA-256). A null text has no words. Repeated rows repeat
    each other. Rows that share a doc_id, or have none, are documents of their own.
    """
    kept = "kept_sha256 string" if digests else "kept_text string"
    return find_and_remove(
        docs, Units(True, WINDOW, ANCHOR), judge, True, _digest if digests else _finish,
        f"doc_id long, n_words long, n_removed long, {kept}", "substrings", rows=True,
    )
