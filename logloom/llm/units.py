"""Integer vectors dealt into bounded units of rows that queries stream past.

Exact searches over vectors (``topk``, ``negatives``) hold one unit of members at
a time in a task; queries follow in the sort order of the partition, so neither
side is ever held whole and no member is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a unit, about, components of all its members at most, and queries that meet them at once.
UNIT, COMPONENTS, QUERIES = 8192, 1 << 20, 256
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def units_for(count: Column, dimension: Column, most: int = UNIT) -> Column:
    """The number of units for so many vectors: long vectors lie in smaller units, so that memory stays bounded."""
    fits = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(COMPONENTS) / F.greatest(F.lit(1), dimension))))
    return F.ceil(count / fits).cast("int")


def quantised(vectors: DataFrame, *columns: str) -> DataFrame:
    """``rid, <columns>, dimension, y`` of usable vectors: y holds floor(256 x) of each component x as a double.

    Vectors that are null or hold a null or non-finite component are left out.
    ``rid`` tells repeated rows apart; write the result before reading it twice.
    """
    usable = F.expr("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    rows = vectors.select(*columns, F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    kept = rows.select(F.monotonically_increasing_id().alias("rid"), *columns, "embedding")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            with np.errstate(over="ignore"):
                flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
            offsets = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            y = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.clip(flat, -1.7e308, 1.7e308)))
            lengths = pa.array(np.diff(offsets), pa.int32())
            names = [*batch.schema.names[:-1], "dimension", "y"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lengths, y], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    given = ", ".join(f"{c} {kinds[c]}" for c in ["rid", *columns])
    return kept.mapInArrow(scaled, f"{given}, dimension int, y array<double>")


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """One row per vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def products(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as doubles where they fit and as Python integers in a long's range else."""
    if not queries.size or not members.size:
        return np.zeros((len(queries), len(members)))
    if np.abs(queries).max() * np.abs(members).max() * queries.shape[1] < EXACT:
        return queries @ members.T
    whole = np.vectorize(int, otypes=[object])
    return np.vectorize(as_long, otypes=[object])(whole(queries) @ whole(members).T)


def best_first(scores: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order of the scores, highest first, ties by place."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], place[i])), np.int64)
    return np.lexsort((place, -scores))


def as_long(score) -> int:
    """The score as a long; beyond its range, the nearest end."""
    return max(LONG.min, min(LONG.max, int(score)))


def ranks(ids: pa.Array | pa.ChunkedArray, rids: np.ndarray) -> np.ndarray:
    """The place of every member by id, nulls last; repeated ids by row."""
    names = ids.to_numpy() if not ids.null_count else np.array([LONG.max if x is None else x for x in ids.to_pylist()], np.int64)
    missing = np.asarray(ids.is_null())
    order = np.lexsort((rids, names, missing))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def meetings(
    batches: Iterator[pa.RecordBatch], keys: list[str], prepare: Callable[[pa.Table], object]
) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(unit, some of its queries) from rows sorted by ``keys`` and ``kind`` (0 members, 1 queries)."""
    at, members, unit = None, [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in [*keys, "kind"]]
        turn = np.zeros(max(batch.num_rows - 1, 0), bool)
        for column in columns:
            turn |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(int(c[a]) for c in columns[:-1])
            if key != at:
                at, members, unit = key, [], None
            if columns[-1][a] == 0:
                members.append(batch.slice(a, b - a))
            elif members or unit is not None:
                if unit is None:
                    unit, members = prepare(pa.Table.from_batches(members)), []
                for i in range(a, b, QUERIES):
                    yield unit, batch.slice(i, min(QUERIES, b - i))


def met(members: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides in one table, dealt by ``keys``, members before queries."""
    both = members.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "kind")
