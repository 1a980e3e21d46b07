"""Search for repeated windows of a fixed number of units (words or bytes) over all documents.

The stages that substring and suffix-array removal share; they differ in how
the windows that may repeat are told apart (``judge``) and in what goes.

1. *Anchors.* Every window names the least-hashed run of a few units inside it.
   Equal windows name the same run, so neighbouring windows that share an anchor
   travel as one, and a window whose anchor occurs once cannot repeat. Anchors
   are dealt by hash; an anchor that a block holds several times is decided in
   the block and sends one mark, so that a passage of very many documents adds
   an entry per block of text at most.
2. *Contexts.* Documents meet their surviving anchors by bucket of their id and
   send the text around each one. Equal contexts of a block are sent once.
3. *Judgement.* The contexts of one anchor meet in one part, where ``judge`` finds
   the windows to remove.
4. *Removal.* Documents meet their spans by bucket again.

The number of parts and buckets follows the volume of text, so parts stay small
at any size. A part or bucket travels as a few rows of packed numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import BYTE_VALUE, U64, Block, blocks, gram_hashes, mix, piece_hashes, repeats, tidy, tidy_group
from logloom.session import written_once

#: Bytes of text per part and per bucket.
PART_BYTES = 2 << 20
ANCHORS = "part int, key binary, ident binary, at binary"
CONTEXTS = "part int, ident binary, at binary, many binary, size binary, context binary"
SPANS = "bucket int, ident binary, start binary, stop binary"
ID = "__ident"


@dataclass(frozen=True)
class Units:
    """What a window counts, how many of them it has, and how many an anchor has."""

    words: bool
    window: int
    anchor: int

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last-plus-one byte and hash of each unit, and the first unit of each document (one more at the end)."""
        if self.words:
            begin, end, first = block.words()
            return begin, end, piece_hashes(block.data, begin, end), first
        begin = np.arange(len(block.data))
        return begin, begin + 1, BYTE_VALUE[block.data], block.starts


@dataclass
class Runs:
    """Neighbouring windows of a block with one anchor: window starts ``low`` to ``high``, in units of the block."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def runs(hashes: np.ndarray, first: np.ndarray, units: Units) -> Runs:
    """The windows of a block by anchor: the leftmost run of ``units.anchor`` units with the least hash."""
    n, k, window = len(hashes), units.anchor, units.window
    if n < window:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(U64), none)
    key = mix(gram_hashes(hashes, k))
    bits = U64(int(n).bit_length())
    least = (key >> bits << bits) | np.arange(len(key), dtype=U64)
    span, width = 1, window - k + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(first[1:][doc] - np.arange(n) >= window)
    at = (least[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(start) != 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(start)) - 1 if len(low) else low
    return Runs(start[low], start[high], at[low], key[at[low]], doc[start[low]])


def _packed(part: np.ndarray, columns: dict[str, np.ndarray], name: str = "part") -> pa.RecordBatch:
    """A row for each value of ``part`` with the bytes of its elements of every column, in their order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = np.concatenate([[0], cut, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    arrays = [pa.array(part[edges[:-1]], pa.int32())]
    for values in columns.values():
        arrays.append(_bytes(values[order], edges))
    return pa.RecordBatch.from_arrays(arrays, names=[name, *columns])


def _bytes(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((edges * values.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _column(table: pa.Table | pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def identified(docs: DataFrame, rows: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) with an id that is never null: null ids are named by their text, above all others.

    ``rows``: every row is a document of its own. Where ids are null or shared,
    the rows are numbered and written once, so that numbers stay as they are.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    if rows and not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return written_once(docs.withColumn(ID, F.monotonically_increasing_id()), "rows")
    far = F.lit(2**63 - 1) - F.abs(F.xxhash64("text") % F.lit(2**60))
    return docs.withColumn(ID, F.coalesce("doc_id", far))


def parts_for(docs: DataFrame) -> int:
    """One part per ``PART_BYTES`` of text."""
    return 1 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES


def anchor_survivors(docs: DataFrame, units: Units, parts: int) -> DataFrame:
    """Anchors that occur twice or more anywhere, packed by document bucket: bucket, ident, at (unit of the document)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            _, _, hashes, first = units.of(block)
            found = runs(hashes, first, units)
            ident = block.column(ID).to_numpy(zero_copy_only=False)[found.doc]
            at = (found.at - first[found.doc]).astype(np.int32)
            part = (found.key % U64(parts)).astype(np.int32)
            # Parts grow with the text, so that 32 more bits tell the anchors of a part apart.
            short = mix(found.key).astype(np.uint32)
            again = repeats(found.key)
            marks = np.unique(found.key[again])
            alone = ~again
            yield _packed(
                np.concatenate([part[alone], (marks % U64(parts)).astype(np.int32)]),
                {
                    "key": np.concatenate([short[alone], mix(marks).astype(np.uint32)]),
                    "ident": np.concatenate([ident[alone], np.zeros(len(marks), np.int64)]),
                    "at": np.concatenate([at[alone], np.full(len(marks), -1, np.int32)]),
                },
            )
            # Decided here: any part may pass them on.
            if again.any():
                spread = (ident[again] % parts).astype(np.int32)
                empty = np.zeros(again.sum(), "V0")
                yield _packed(spread, {"key": empty, "ident": ident[again], "at": at[again]})

    def count(table: pa.Table) -> pa.Table:
        sent = pc.greater(pc.binary_length(table.column("key")), 0)
        here, passed = table.filter(sent), table.filter(pc.invert(sent))
        ident, at = _column(here, "ident", np.int64), _column(here, "at", np.int32)
        # A mark (-1) stands for two or more of its key.
        many = repeats(_column(here, "key", np.uint32)) & (at >= 0)
        ident = np.concatenate([ident[many], _column(passed, "ident", np.int64)])
        at = np.concatenate([at[many], _column(passed, "at", np.int32)])
        packed = _packed((ident % parts).astype(np.int32), {"ident": ident, "at": at}, "bucket")
        return pa.Table.from_batches([packed])

    sent = docs.select(ID, "text").mapInArrow(tidy(send), ANCHORS)
    return sent.groupBy("part").applyInArrow(tidy_group(count), "bucket int, ident binary, at binary")


def _by_bucket(docs: DataFrame, parts: int) -> DataFrame:
    return docs.withColumn("bucket", F.pmod(F.col(ID), F.lit(parts)).cast("int"))


def _holders(block: Block, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``ident``, document of the block): rows that share an id are all meant by it."""
    own = block.column(ID).to_numpy(zero_copy_only=False)
    order = np.argsort(own, kind="stable")
    low, high = (np.searchsorted(own[order], ident, side) for side in ("left", "right"))
    many = high - low
    which = np.repeat(np.arange(len(ident)), many)
    return which, order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))]


def contexts(docs: DataFrame, survivors: DataFrame, units: Units, parts: int, same_too: bool) -> DataFrame:
    """The text around each surviving anchor, packed by the anchor's part.

    ident, at (first window), many (windows), size (bytes) and the bytes. ``at``
    is negative, -1 - at, for what is decided already: all its windows repeat.
    ``same_too``: equal contexts of one document count as repeats of each other.
    Of equal contexts in a bucket the one of the smallest document is sent.
    """

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known, spot = _column(right, "ident", np.int64), _column(right, "at", np.int32)
        for block in blocks(iter(left.to_batches())):
            begin, end, hashes, first = units.of(block)
            found = runs(hashes, first, units)
            ident = block.column(ID).to_numpy(zero_copy_only=False)
            which, where = _holders(block, known)
            where = first[where] + spot[which]
            alive = np.zeros(len(hashes), bool)
            alive[where[where < len(hashes)]] = True
            keep = alive[found.at]
            if not keep.any():
                continue
            low, high, doc, key = found.low[keep], found.high[keep], found.doc[keep], found.key[keep]
            a, b = begin[low], end[high + units.window - 1]
            name = piece_hashes(block.data, a, b) ^ mix(key)
            who = ident[doc]
            at, many = low - first[doc], high - low + 1
            # Of equal contexts the smallest document's goes on; the others are decided.
            order = np.lexsort((at, who, name))
            head = np.append(True, name[order][1:] != name[order][:-1])
            group = np.cumsum(head) - 1
            goes, decided = np.zeros(len(low), bool), np.zeros(len(low), bool)
            if same_too:
                # A repeated context is decided for its head as well, which still has to meet other buckets.
                goes[order] = head
                decided[order] = np.bincount(group)[group] > 1
            else:
                decided[order] = who[order] > who[order][head][group]
                goes = ~decided
            part = (key % U64(parts)).astype(np.int32)
            # What is decided needs no text and is passed on by any part.
            for mask, done in ((goes, False), (decided, True)):
                if not mask.any():
                    continue
                size = np.zeros(mask.sum(), np.int64) if done else (b - a)[mask]
                place = (who[mask] % parts).astype(np.int32) if done else part[mask]
                order_ = np.argsort(place, kind="stable")
                packed = _packed(place, {
                    "ident": who[mask],
                    "at": (-1 - at[mask] if done else at[mask]).astype(np.int32),
                    "many": many[mask].astype(np.int32),
                    "size": size.astype(np.int32),
                })
                start = a[mask][order_]
                size = size[order_]
                upto = np.cumsum(size) - size
                source = np.arange(size.sum()) + np.repeat(start - upto, size)
                sorted_place = place[order_]
                edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate(
                    [[0], np.flatnonzero(np.diff(sorted_place)) + 1, [len(sorted_place)]])]
                out.append(packed.append_column("context", _bytes(block.data[source], edges)))
        if not out:
            return CONTEXT_TYPE.empty_table()
        return pa.Table.from_batches(out)

    docs = _by_bucket(docs, parts)
    return (
        docs.select("bucket", ID, "text").groupBy("bucket")
        .cogroup(survivors.groupBy("bucket")).applyInArrow(tidy_group(send), CONTEXTS)
    )


CONTEXT_TYPE = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("ident", "at", "many", "size", "context")]])

#: Gets the contexts of a part (document, first window, windows, sizes and bytes); returns which windows, in order, go.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def spans(sent: DataFrame, judge: Judge, units: Units, parts: int) -> DataFrame:
    """Units covered by windows to remove, packed by document bucket: ident, start, stop."""

    def run(table: pa.Table) -> pa.Table:
        ident, at = _column(table, "ident", np.int64), _column(table, "at", np.int32).astype(np.int64)
        many = _column(table, "many", np.int32).astype(np.int64)
        size, data = _column(table, "size", np.int32).astype(np.int64), _column(table, "context", np.uint8)
        done = at < 0
        owner, start, stop = [ident[done]], [-1 - at[done]], [-1 - at[done] + many[done] - 1 + units.window]
        if not done.all():
            ident, at, many, size = ident[~done], at[~done], many[~done], size[~done]
            gone = judge(ident, at, many, size, data)
            which = np.repeat(np.arange(len(many)), many)
            place = at[which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]
            which, place = which[gone], place[gone]
            new = np.ones(len(which), bool)
            new[1:] = (np.diff(which) != 0) | (np.diff(place) != 1)
            low = np.flatnonzero(new)
            high = np.append(low[1:], len(which)) - 1 if len(low) else low
            owner.append(ident[which[low]])
            start.append(place[low])
            stop.append(place[high] + units.window)
        owner, start, stop = map(np.concatenate, (owner, start, stop))
        order = np.lexsort((start, owner))
        owner, start, stop = owner[order], start[order], stop[order]
        # Joined spans are fewer.
        joins = np.zeros(len(owner), bool)
        joins[1:] = (owner[1:] == owner[:-1]) & (start[1:] <= stop[:-1])
        low = np.flatnonzero(~joins)
        if len(low):
            owner, start, stop = owner[low], start[low], np.maximum.reduceat(stop, low)
        return pa.Table.from_batches([
            _packed((owner % parts).astype(np.int32), {
                "ident": owner, "start": start.astype(np.int32), "stop": stop.astype(np.int32)}, "bucket")
        ])

    return sent.groupBy("part").applyInArrow(tidy_group(run), SPANS)


def removed_units(block: Block, table: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Marks the units of the block that lie in a span of their document."""
    which, doc = _holders(block, table["ident"])
    step = np.zeros(first[-1] + 1, np.int64)
    begin = np.minimum(first[doc] + table["start"][which], first[doc + 1])
    end = np.minimum(first[doc] + table["stop"][which], first[doc + 1])
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def remove(
    docs: DataFrame, spans_: DataFrame, units: Units, parts: int,
    finish: Callable[[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``finish`` (block, begin, end, first unit per document, removed units) over all documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = {"ident": _column(right, "ident", np.int64)}
        table |= {c: _column(right, c, np.int32).astype(np.int64) for c in ("start", "stop")}
        out = []
        for block in blocks(iter(left.to_batches())):
            begin, end, _, first = units.of(block)
            here = np.isin(table["ident"], block.column(ID).to_numpy(zero_copy_only=False))
            gone = removed_units(block, {k: v[here] for k, v in table.items()}, first)
            made = finish(block, begin, end, first, gone)
            out.append(pa.RecordBatch.from_arrays([*made.columns, *map(block.column, carry)], names=[*made.schema.names, *carry]))
        if not out:
            none, empty = np.zeros(0, np.int64), Block(pa.RecordBatch.from_pylist([], left.schema))
            made = finish(empty, none, none, np.zeros(1, np.int64), none.astype(bool))
            out.append(pa.RecordBatch.from_arrays([*made.columns, *map(empty.column, carry)], names=[*made.schema.names, *carry]))
        return pa.Table.from_batches(out)

    docs = _by_bucket(docs, parts)
    return docs.groupBy("bucket").cogroup(spans_.groupBy("bucket")).applyInArrow(tidy_group(run), schema)


def find_and_remove(
    docs: DataFrame, units: Units, judge: Judge, same_too: bool, finish, schema: str, purpose: str,
    rows: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """All four stages; what passes from one to the next is written to the shared scratch folder.

    ``rows``: rows that share an id are different documents. Columns in
    ``carry`` come back beside those of ``finish``.
    """
    docs = identified(docs, rows, carry)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carry}
    schema += "".join(f", {c} {k}" for c, k in kinds.items())
    parts = parts_for(docs)
    survivors = written_once(anchor_survivors(docs, units, parts), purpose)
    found = written_once(spans(contexts(docs, survivors, units, parts, same_too), judge, units, parts), purpose)
    return remove(docs, found, units, parts, finish, schema, carry)
