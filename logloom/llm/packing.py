"""Packing of token pieces into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.blocks import blocks, tidy
from logloom.llm.bpe import Pieces, byte_characters
from logloom.session import written_once

#: Tokens of a sequence, and the id put after each document.
CAPACITY, END_ID = 1024, 0
#: Lengths are planned in classes of so many tokens, rounded up, which bounds the program to 128 rows.
GRAIN = 8
#: Pieces of one class that are ranked together in a task, and groups that are numbered together.
RANKED, GROUPS = 256, 4096


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """A function from text to ids (little-endian 32-bit), from a tokenizer file; special tokens are ordinary text."""
    import regex
    from tokenizers import Tokenizer

    model, table = Tokenizer.from_file(path).model, byte_characters()
    pieces = Pieces(lambda p: [t.id for t in model.tokenize("".join(map(table.__getitem__, p.encode())))])
    split = regex.compile(pattern).findall
    return lambda text: b"".join(map(pieces.__getitem__, split(text)))


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's tokens, closed by the end id, in pieces of ``capacity`` and a rest.

    doc_id, start, length, ids_crc32, doc_tokens and, on request, the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path, pattern), np.array([END_ID], "<u4").tobytes()
        for block in blocks(batches):
            which, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(block.column("text").to_pylist()):
                raw = encode(text or "") + end
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at : at + 4 * capacity]
                    which.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [block.column("doc_id").cast(pa.int64()).take(pa.array(which, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the best multiset of lengths within every capacity, and the last length put in.

    Dynamic programming over the capacity; values are not negative.
    """
    worth = np.zeros(capacity + 1)
    worth[lengths] = values
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        options = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(options.argmax())
        best[c], take[c] = options[k], k + 1
    return best, take


def filling(take: np.ndarray, listed: set[int], capacity: int) -> dict[int, int]:
    """The multiset that ``knapsack`` found for a capacity."""
    out: dict[int, int] = {}
    while capacity > 0:
        n = int(take[capacity])
        if n in listed:
            out[n] = out.get(n, 0) + 1
        capacity -= n
    return out


def fullest(left: dict[int, float], capacity: int) -> dict[int, int]:
    """The longest length that is left, and the fullest filling of the rest with lengths as often as they are left."""
    longest = max(left)
    used, room = {longest: 1}, capacity - longest
    # reach[c]: the last length put in to fill exactly c, and what was filled before it.
    reach: dict[int, tuple[int, int]] = {0: (0, 0)}
    for n in sorted((n for n in left if n <= room), reverse=True):
        have = int(left[n]) - (n == longest)
        for c in sorted(reach):
            for k in range(1, min(have, (room - c) // n) + 1):
                if c + k * n in reach:
                    break
                reach[c + k * n] = (n, c + (k - 1) * n)
        if room in reach:
            break
    c = max(reach)
    while c:
        n, c = reach[c]
        used[n] = used.get(n, 0) + 1
    return used


class Program:
    """The covering program: patterns, as few as possible, that hold at least the demand of every length.

    Revised simplex. It begins with one pattern for each length, as many of it
    as fit. A column is a pattern of cost 1 or, where a dual is negative, the
    surplus of a length at no cost; so duals end up not negative. Demands are
    raised by distinct parts of a ten-millionth, which no two bases share, so
    that no pivot is of length 0 and none repeats.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.where = {int(n): i for i, n in enumerate(lengths)}
        fits = capacity // lengths
        self.patterns: list[dict[int, int] | None] = [{int(n): int(k)} for n, k in zip(lengths, fits)]
        self.cost, self.inverse = np.ones(len(lengths)), np.diag(1.0 / fits)
        self.amount = demand * (1 + 1e-7 * np.random.default_rng(3).random(len(lengths))) / fits
        self.generated = 0
        self._price()

    def _price(self) -> None:
        self.duals = self.cost @ self.inverse

    def _enter(self, column: np.ndarray, cost: float, pattern: dict[int, int] | None) -> None:
        rises = column > 1e-9
        ratio = np.where(rises, self.amount / np.where(rises, column, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        self.amount = np.maximum(self.amount - step * column, 0)
        self.amount[out] = step
        row = self.inverse[out] / column[out]
        self.inverse -= np.outer(column, row)
        self.inverse[out] = row
        self.cost[out], self.patterns[out] = cost, pattern
        self._price()

    def drop_surplus(self) -> None:
        while (low := int(self.duals.argmin())) >= 0 and self.duals[low] < -1e-9:
            self._enter(-self.inverse[:, low], 0.0, None)

    def add(self, pattern: dict[int, int]) -> None:
        """Take a pattern in if it is worth more than it costs by the duals as they are now."""
        at, many = [self.where[n] for n in pattern], np.array(list(pattern.values()))
        if self.duals.min() > -1e-9 and float(self.duals[at] @ many) > 1 + 1e-9:
            self.generated += 1
            self._enter(self.inverse[:, at] @ many, 1.0, pattern)


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], Program]:
    """Patterns (length -> how many) and how often the solved program uses each.

    Every round prices all patterns by the duals with one ``knapsack`` and takes
    in those that are worth more than 1, the best one that holds each length. No
    pattern worth more than 1 is left at the end, which proves the optimum.
    """
    program, listed = Program(lengths, demand, capacity), {int(n) for n in lengths}
    while True:
        program.drop_surplus()
        best, take = knapsack(np.maximum(program.duals, 0), lengths, capacity)
        if best[capacity] <= 1 + 1e-9:
            break
        worth = program.duals + best[capacity - lengths]
        for j in np.argsort(-worth):
            if worth[j] <= 1 + 1e-9:
                break
            pattern = filling(take, listed, capacity - int(lengths[j]))
            pattern[int(lengths[j])] = pattern.get(int(lengths[j]), 0) + 1
            program.add(pattern)
    amounts = program.inverse @ demand
    return [(p, float(x)) for p, x in zip(program.patterns, amounts) if p and x > 1e-9], program


def fill(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Sequences for what is left after rounding, each as full as it can be."""
    left = {int(n): int(k) for n, k in zip(lengths, demand) if k}
    out = []
    while left:
        out.append(fullest(left, capacity))
        for n, k in out[-1].items():
            left[n] -= k
            if not left[n]:
                del left[n]
    return out


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole-number pattern counts that use every piece exactly once.

    The program's amounts are rounded down and cut to what is left of each
    length; the rest, about one sequence per pattern and so bounded by the
    number of lengths, is filled piece by piece.
    """
    left = dict(zip(lengths.tolist(), demand.tolist()))
    out = []
    for pattern, amount in column_generation(lengths, demand.astype(float), capacity)[0]:
        times = min([int(amount + 1e-9), *(left[n] // k for n, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times
    rest = np.array([left[n] for n in lengths.tolist()])
    return out + [(p, 1) for p in fill(lengths, rest, capacity)]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks per class: rank ``first`` + copy * per + j is the piece ``slot`` + j of sequence ``sequence`` + copy."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        slot = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, taken.get(n, 0), k, sequence, slot))
            taken[n] = taken.get(n, 0) + k * times
            slot += k
        sequence += times
    rows.sort()
    return dict(zip(("class", "first", "per", "sequence", "slot"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(
    docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with the sequence and offset they take.

    1. A pass tokenises and cuts only what is longer than a sequence. The pieces
       are written once.
    2. The driver gets a histogram of piece lengths in classes of ``GRAIN``
       tokens, 128 rows at most for a capacity of 1024, and solves the
       cutting-stock program over it. A piece takes the room of its class, which
       pads a sequence by less than ``GRAIN`` tokens a piece.
    3. Pieces of one class are ranked: each class is dealt into groups of about
       ``RANKED`` pieces by hash, groups are numbered by running counts on two
       levels, so no class, however common, meets in one task.
    4. A piece's class and rank name its sequence and slot. The slot table is
       bounded by the number of classes and patterns, not by the data. Offsets
       are the lengths of the earlier slots of the sequence, added up.

    Within a sequence offsets are gapless from 0. A null text counts as empty and
    is one piece with the end id alone; repeated rows and null ids are packed
    like any other; no documents give no rows.
    """
    grain = GRAIN if capacity % GRAIN == 0 else 1
    pieces = written_once(token_pieces(docs, path, pattern, capacity, with_ids), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    classes = np.array(sorted(counts), np.int64)
    table = slots(plan(classes, np.array([counts[n] for n in classes.tolist()]), capacity // grain) if counts else [])
    groups = F.array(*[F.lit(-(-counts.get(n, 0) // RANKED) or 1) for n in range(1, capacity // grain + 1)])
    order = [F.xxhash64("doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start")]
    dealt = pieces.withColumn("part", F.pmod(order[0], F.element_at(groups, F.col("class"))))
    sizes = dealt.groupBy("class", "part").count().withColumn("upper", F.expr(f"part DIV {GROUPS}"))
    uppers = sizes.groupBy("class", "upper").agg(F.sum("count").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("class").orderBy("upper")) - F.col("all")
    inside = F.sum("count").over(Window.partitionBy("class", "upper").orderBy("part")) - F.col("count")
    before = sizes.withColumn("inside", inside).join(uppers.withColumn("earlier", earlier), ["class", "upper"]).select(
        "class", "part", (F.col("inside") + F.col("earlier")).alias("before")
    )
    place = Window.partitionBy("class", "part").orderBy(*order)
    ranked = (
        dealt.withColumn("place", F.row_number().over(place) - 1).join(before, ["class", "part"])
        .withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")
    )
    key = table["class"] << 40 | table["first"] if counts else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns))
            kind, rank = (get[c].to_numpy(zero_copy_only=False) for c in ("class", "rank"))
            slot = np.searchsorted(key, kind.astype(np.int64) << 40 | rank, "right") - 1
            copy, inside = np.divmod(rank - table["first"][slot], table["per"][slot])
            get["sequence_id"] = pa.array(table["sequence"][slot] + copy)
            get["slot"] = pa.array(table["slot"][slot] + inside)
            yield pa.RecordBatch.from_arrays([get[c] for c in names], names=names)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    out += ", ids array<int>" * with_ids
    names = [x.split()[0] for x in out.split(", ")]
    # A sequence has ``capacity`` pieces at most.
    filled = Window.partitionBy("sequence_id").orderBy("slot")
    offset = (F.sum("length").over(filled) - F.col("length")).alias("offset")
    last = ["ids"] * with_ids
    return ranked.mapInArrow(tidy(run), out).select(*names[:6], offset, *last)
