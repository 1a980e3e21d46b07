"""Exact highest inner products through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.units import UNIT, as_long, best_first, matrix, meetings, met, products, quantised, ranks, units_for
from logloom.session import written_once

#: Vectors that the pivots are fitted on, and pivots at most (of one vector length).
SAMPLE, PIVOTS = 4096, 512
#: Members of an annulus.
RING = 256


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Means of the sample's nearest groups after a few rounds; the first rows start them."""
    count = max(1, min(count, len(sample)))
    pivots = sample[:count].copy()
    for _ in range(rounds if count > 1 else 0):
        near = nearest(sample, pivots)[0]
        size = np.bincount(near, minlength=count)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return pivots


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(pivots)))
    for j, pivot in enumerate(pivots):
        out[:, j] = np.sqrt(((rows - pivot) ** 2).sum(axis=1))
    return out


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = distances(rows, pivots)
    home = far.argmin(axis=1)
    return home, far[np.arange(len(rows)), home]


def bound(norm: np.ndarray, largest: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The highest product that a vector may have whose squared length and distance are bounded so.

    From |q - y|^2 = |q|^2 + |y|^2 - 2 q.y, raised by more than rounding may take off.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        top = norm + largest
        out = (top - apart**2) / 2 + 1e-7 * top + 1
    return np.where(np.isnan(out), np.inf, out)  # lengths beyond a double bound nothing


class Cell:
    """Members of one pivot in the order of their distance to it, cut into rings."""

    def __init__(self, table: pa.Table):
        far = table.column("far").to_numpy()
        order = np.argsort(far, kind="stable")
        self.table = table.take(pa.array(order))
        self.far = far[order]
        self.dimension = table.column("dimension")[0].as_py()
        self.y = matrix(self.table.column("y"), self.dimension)
        self.rid = self.table.column("rid").to_numpy()
        self.place = ranks(self.table.column("vec_id").combine_chunks(), self.rid)
        self.ids = self.table.column("vec_id").to_pylist()
        self.starts = np.arange(0, len(self.rid), RING)
        norms = (self.y**2).sum(axis=1)
        self.norm = np.maximum.reduceat(norms, self.starts)
        self.low, self.high = self.far[self.starts], self.far[np.append(self.starts[1:], len(self.rid)) - 1]

    def search(self, queries: np.ndarray, rids: np.ndarray, far: np.ndarray, least: np.ndarray, k: int) -> list[tuple]:
        """Members among each query's best ``k``, ring by ring from the most promising one.

        A ring is left out, and with it all that follow, once the triangle
        inequality shows that its products lie below the k-th found or ``least``.
        """
        with np.errstate(invalid="ignore"):
            apart = np.maximum(0, np.maximum(far[:, None] - self.high, self.low - far[:, None]))
        most = bound((queries**2).sum(axis=1)[:, None], self.norm, apart)
        order = np.argsort(-most, axis=1, kind="stable")
        found = [np.zeros(0, np.int64) for _ in queries]
        scores = [np.zeros(0) for _ in queries]
        floor = least.copy()
        todo = np.arange(len(queries))
        self.visited = 0
        for step in range(len(self.starts)):
            todo = todo[most[todo, order[todo, step]] >= floor[todo]]
            if not len(todo):
                break
            for ring in np.unique(order[todo, step]):
                asked = todo[order[todo, step] == ring]
                at = np.arange(self.starts[ring], min(self.starts[ring] + RING, len(self.rid)))
                self.visited += len(asked) * len(at)
                for i, row in zip(asked, products(queries[asked], self.y[at])):
                    good = (row >= floor[i]) & (self.rid[at] != rids[i])
                    if not good.any():
                        continue
                    where, value = np.append(found[i], at[good]), np.append(scores[i], row[good])
                    best = best_first(value, self.place[where])[:k]
                    found[i], scores[i] = where[best], value[best]
                    if len(best) == k and value.dtype != object:
                        floor[i] = max(floor[i], value[best[-1]])
        return list(zip(found, scores))


def top_products(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row of ``vectors`` (vec_id, embedding).

    Components become floor(256 x). Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all other rows, of which those of
    another vector length have no product. Ties go to the smaller vec_id, a
    null one last. Rows that are null or hold null or non-finite components take
    no part; a repeated row is a query and a candidate of its own; empty vectors
    have the product 0 with each other. Scores are exact at any size; one beyond
    a long counts as the long's end. An empty table gives an empty result.

    1. Index: pivots are fitted on ``SAMPLE`` rows, the smallest by hash of the
       id. Every row is keyed by its nearest pivot and the distance to it, and
       lies in one unit of about ``UNIT`` rows (fewer of long vectors) of its
       pivot's cell; a hot cell has many units. The summary of cells has at most ``PIVOTS`` rows a length.
    2. A query first searches its own cell, then every cell whose bound
       reaches its k-th score. In a unit rings of sorted distance are expanded
       from the most promising one until the triangle inequality rules out the rest.

    Returns query_id, rank, vec_id, score.
    """
    rows, pivots = _keyed(written_once(quantised(vectors, "vec_id"), "vectors"))
    index = written_once(rows, "pivots")
    cells = index.groupBy("dimension", "cell").agg(
        F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("norm").alias("norm")
    )
    cells = cells.withColumn("salts", units_for(F.col("n"), F.col("dimension"), UNIT))
    units = ["dimension", "cell", "salt"]
    members = index.join(cells.select("dimension", "cell", "salts"), ["dimension", "cell"]).withColumn(
        "salt", F.pmod(F.xxhash64("rid"), "salts").cast("int")
    ).select(*units, "rid", "vec_id", "far", "y")
    members = written_once(members, "members")
    # At most PIVOTS rows for each vector length.
    held: dict[int, dict] = {}
    for r in cells.collect():
        held.setdefault(r["dimension"], {})[r["cell"]] = r
    queries = index.where(F.col("vec_id") % every == 0).select("dimension", "cell", "rid", "vec_id", "y")

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {n: [] for n in ("row", "cell", "salt", "far")}
                dims = batch.column(0).to_numpy()
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    part = batch.take(pa.array(rows))
                    cell = list(held[int(d)].values())
                    names = np.array([c["cell"] for c in cell])
                    y = matrix(part.column(4), int(d))
                    far = distances(y, pivots[int(d)][names])
                    low, high, norm = (np.array([c[x] for c in cell]) for x in ("low", "high", "norm"))
                    home = part.column(1).to_numpy()[:, None] == names
                    if not first:
                        with np.errstate(invalid="ignore"):
                            apart = np.maximum(0, np.maximum(far - high, low - far))
                        least = part.column(5).to_numpy(zero_copy_only=False)
                        home = ~home & (bound((y**2).sum(axis=1)[:, None], norm, apart) >= least[:, None])
                    for i, j in zip(*np.nonzero(home)):
                        for salt in range(cell[j]["salts"]):
                            out["row"].append(rows[i])
                            out["cell"].append(int(names[j]))
                            out["salt"].append(salt)
                            out["far"].append(far[i, j])
                for a in range(0, len(out["row"]), 4096):
                    cut = slice(a, a + 4096)
                    took = batch.take(pa.array(out["row"][cut], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [took.column(0), pa.array(out["cell"][cut], pa.int32()), pa.array(out["salt"][cut], pa.int32()), took.column(2),
                         took.column(3), pa.array(out["far"][cut], pa.float64()), took.column(4), took.column(5)],
                        names=["dimension", "cell", "salt", "rid", "vec_id", "far", "y", "least"],
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, part in meetings(batches, units, Cell):
            get = dict(zip(part.schema.names, part.columns))
            rids = get["rid"].to_numpy()
            out = cell.search(
                matrix(get["y"], cell.dimension), rids, get["far"].to_numpy(), get["least"].to_numpy(zero_copy_only=False).copy(), k
            )
            asked = np.repeat(np.arange(len(out)), [len(f) for f, _ in out])
            where = np.concatenate([f for f, _ in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids[asked]), get["vec_id"].take(pa.array(asked)), pa.array(cell.rid[where]),
                 pa.array([cell.ids[i] for i in where], pa.int64()), pa.array([as_long(x) for _, s in out for x in s], pa.int64())],
                names=["qid", "query_id", "rid", "vec_id", "score"],
            )

    routed = "dimension int, cell int, salt int, rid long, vec_id long, far double, y array<double>, least double"
    result = "qid long, query_id long, rid long, vec_id long, score long"

    def searched(asks: DataFrame, first: bool) -> DataFrame:
        return met(members, asks.mapInArrow(route(first), routed), units).mapInArrow(search, result)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = written_once(best(searched(queries.withColumn("least", F.lit(float("-inf"))), True)).drop("rank"), "near")
    floor = near.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
    asks = queries.join(floor, queries["rid"] == floor["qid"], "left").select(
        *queries.columns, F.coalesce("least", F.lit(float("-inf"))).alias("least")
    )
    return best(near.unionByName(searched(asks, False))).select("query_id", "rank", "vec_id", "score")


def _keyed(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Every row with its nearest pivot, the distance to it, and its squared length; the pivots by vector length."""
    lengths = {r["dimension"]: r["n"] for r in rows.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
    drawn: dict[int, list] = {}
    for r in rows.select("dimension", "y", F.xxhash64("vec_id").alias("h"), "rid").orderBy("h", "rid").limit(SAMPLE).collect():
        drawn.setdefault(r["dimension"], []).append(r["y"])
    # A length that the sample misses is keyed by the distance to the origin.
    pivots = {}
    for d, n in lengths.items():
        sample = drawn.get(d, [[0.0] * d])
        pivots[d] = fit_pivots(np.array(sample, float).reshape(len(sample), d), min(PIVOTS, -(-n // UNIT)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                y = matrix(part.column(3), int(d))
                with np.errstate(over="ignore", invalid="ignore"):
                    home, far = nearest(y, pivots[int(d)])
                    norm = (y**2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home, pa.int32()), pa.array(far), pa.array(norm)],
                    names=["rid", "vec_id", "dimension", "y", "cell", "far", "norm"],
                )

    schema = "rid long, vec_id long, dimension int, y array<double>, cell int, far double, norm double"
    return rows.mapInArrow(keyed, schema), pivots


def top_sql() -> str:
    """The same by brute force."""
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.y, v.y) AS BIGINT) AS score
        FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
