"""Quality rules by repetition coverage: characters inside repeated n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.blocks import FACTORS, U64, Block, blocks, covered, mix, piece_hashes, repeats, tidy

#: Shortest and longest word run that is measured.
LENGTHS = (5, 6, 7, 8, 9, 10)
#: The runs of the base rule, its smallest word count, and the share of repeated words it allows.
BASE_RUN, BASE_WORDS, BASE_SHARE = 8, 20, 0.30
#: A text goes if a larger share of its word characters lies in repeated runs of that length.
GRAM_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: A text goes if a larger share of its characters lies in lines that repeat an earlier one.
LINE_LIMIT = 0.30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in LENGTHS)
)


def _lines(block: Block, word_begin: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines equal to an earlier line of their document, and the characters in those, per document."""
    breaks = np.flatnonzero(block.data == 0x0A)
    begin = np.sort(np.concatenate([block.starts[:-1], breaks + 1]))
    end = np.sort(np.concatenate([block.starts[1:], breaks]))
    worded = np.searchsorted(word_begin, begin) < np.searchsorted(word_begin, end)
    begin, end = begin[worded], end[worded]
    doc = np.searchsorted(block.starts, begin, "right") - 1
    key = mix(piece_hashes(block.data, begin, end) ^ mix(doc.astype(U64)))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    size = chars[end] - chars[begin]
    count = np.bincount(doc[later], minlength=len(block))
    return count, np.bincount(doc[later], size[later], len(block)).astype(np.int64)


def measure(block: Block) -> dict[str, np.ndarray]:
    """The measures of each document of the block.

    A run of n words counts if its rolling hash occurs again in its document.
    Runs longer by a word are looked for only where two neighbouring runs repeat.
    """
    begin, end, first = block.words()
    words = np.diff(first)
    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80, dtype=np.int64)])
    size = chars[end] - chars[begin]
    doc = np.repeat(np.arange(len(block)), words)
    out = {
        "n_words": words,
        "word_chars": np.bincount(doc, size, len(block)).astype(np.int64),
        "n_symbols": block.sums(SYMBOL[block.data]),
    }
    out["n_dup_lines"], out["dup_line_chars"] = _lines(block, begin, chars)
    word = piece_hashes(block.data, begin, end)
    seed = mix(doc.astype(U64) + U64(77))
    left = first[1:][doc] - np.arange(len(doc))  # words from here to the end of the document
    spots = np.flatnonzero(left >= LENGTHS[0])
    for n in LENGTHS:
        key = word[spots]
        for k in range(1, n):
            key = key * FACTORS[0] + word[spots + k]
        spots = spots[repeats(mix(key ^ seed[spots]))]
        inside = covered(len(doc), spots, n)
        out[f"dup_{n}gram_chars"] = np.bincount(doc[inside], size[inside], len(block)).astype(np.int64)
        if n == BASE_RUN:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=len(block))
        follows = np.zeros(len(doc) + 1, bool)
        follows[spots] = True
        spots = spots[follows[spots + 1] & (left[spots] > n)]
    return out


def repetition_coverage(
    docs: DataFrame,
    gram_limits: Mapping[int, float] = GRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    min_words: int = BASE_WORDS,
    max_repeat_share: float = BASE_SHARE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row of measures and a verdict for every row of ``docs`` (doc_id, text).

    A map over Arrow batches without a shuffle. A null text has no words, fails
    the base rule (too short) and is not kept; so does an empty one. Repeated
    rows each get their row; an empty table gives an empty result; columns other
    than doc_id and text are ignored, unless named in ``carry``: those follow the
    measures, so that a filter on the verdict needs no join.

    ``base_failed``: fewer than ``min_words`` words, or more than the given share
    of words in repeated runs of eight. ``kept``: the base rule holds, and for no
    run length, nor for lines, repeated text covers more than its limit.
    """
    share = round(100 * max_repeat_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            got = measure(block)
            words = got["n_words"]
            failed = (words < min_words) | (100 * got["n_repeat_words"] > share * words)
            total = block.sums((block.data & 0xC0) != 0x80)
            bad = got["dup_line_chars"] > line_limit * total
            for n, limit in gram_limits.items():
                bad |= got[f"dup_{n}gram_chars"] > limit * got["word_chars"]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64())]
                + [pa.array(got[k], pa.int64()) for k in names]
                + [pa.array(failed), pa.array(~failed & ~bad)]
                + [pa.array(got[k], pa.int64()) for k in ("dup_line_chars", *(f"dup_{n}gram_chars" for n in LENGTHS))]
                + [block.column(c) for c in carry],
                names=[
                    "doc_id", *names, "base_failed", "kept", "dup_line_chars",
                    *(f"dup_{n}gram_chars" for n in LENGTHS), *carry,
                ],
            )

    further = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *carry]))
    return rows.mapInArrow(tidy(run), SCHEMA + further)
