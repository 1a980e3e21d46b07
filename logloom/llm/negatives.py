"""Hard negatives by the threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.units import UNIT, as_long, best_first, matrix, meetings, met, products, quantised, ranks, units_for
from logloom.session import written_once

#: Entries of each list in the first round of sorted access; every round doubles the depth.
DEPTH = 64


class Lists:
    """The candidates of a unit, sorted by each dimension."""

    def __init__(self, table: pa.Table):
        self.dimension = table.column("dimension")[0].as_py()
        self.y = matrix(table.column("y"), self.dimension)
        self.rid = table.column("rid").to_numpy()
        self.label = table.column("label").to_numpy()
        self.ids = table.column("vec_id").to_pylist()
        self.place = ranks(table.column("vec_id").combine_chunks(), self.rid)
        self.order = np.argsort(self.y, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.y, self.order, axis=0)

    def search(self, anchors: np.ndarray, allowed: np.ndarray, windows: list[list[tuple]], k: int) -> list[list[tuple]]:
        """The best ``k`` allowed members of each anchor's windows, as (rows, scores) of each window.

        A list is read from its top where the anchor's component is positive and
        from its bottom where it is negative. Every row met is scored in full
        (random access). An anchor stops once what no list has shown yet must
        score strictly below the k-th of each window, or below the window.
        """
        n, count = len(self.rid), len(anchors)
        seen, scored = np.zeros((count, n), bool), np.zeros(n, bool)
        scores = np.full((count, n), -np.inf)
        floor = [min((w[0] for w in ws), default=np.inf) for ws in windows]
        answer: list[list[tuple]] = [[] for _ in windows]
        todo = np.array([i for i, ws in enumerate(windows) if ws], np.int64)
        self.read, depth, before = 0, DEPTH, 0
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        while len(todo):
            to = min(depth, n)
            for d in range(self.dimension):
                top, bottom = todo[up[todo, d] > 0], todo[down[todo, d] < 0]
                if len(top):
                    seen[np.ix_(top, self.order[n - to : n - before, d])] = True
                if len(bottom):
                    seen[np.ix_(bottom, self.order[before:to, d])] = True
            if to == n:
                seen[todo] = True
            self.read += len(todo) * (to - before)
            fresh = np.flatnonzero(seen[todo].any(axis=0) & ~scored)
            scored[fresh] = True
            got = products(anchors, self.y[fresh])
            if got.dtype == object:
                scores = scores.astype(object)
            scores[:, fresh] = got
            # Rounding must not lower the threshold; sums of products of integers are exact below 2^53.
            with np.errstate(over="ignore", invalid="ignore"):
                high, low = self.sorted[n - to], self.sorted[to - 1]
                parts = up[todo] * high + down[todo] * low
                most = parts.sum(axis=1) + 1e-9 * np.abs(parts).sum(axis=1)
            most = np.where(np.isnan(most), np.inf, most)
            left = []
            for i, limit in zip(todo, most):
                at = np.flatnonzero(seen[i] & allowed[i])
                at = at[scores[i, at] >= floor[i]]
                at = at[best_first(scores[i, at], self.place[at])]
                value = scores[i, at]
                answer[i] = []
                done = to == n
                ready = True
                for low_end, high_end in windows[i]:
                    inside = np.flatnonzero((value >= low_end) & (value <= high_end))[:k]
                    answer[i].append((at[inside], value[inside]))
                    ready &= limit < low_end or (len(inside) == k and limit < value[inside[-1]])
                if not done and not ready:
                    left.append(i)
            todo, before, depth = np.array(left, np.int64), to, 2 * depth
        return answer


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95
) -> DataFrame:
    """Rows of another label that score close below an anchor's positives (vec_id, embedding, label).

    Components become floor(256 x); a score is the integer inner product with
    the anchor; higher ones come first, ties by smaller vec_id, a null one last.
    Anchors are the rows whose vec_id is divisible by ``every``. Positives of an
    anchor are the first ``positives`` other rows of its label. For each, the
    first ``negatives`` rows of another label are returned whose score lies
    from ``least`` to ``most`` hundredths of the positive's; no row does so
    below a negative score. Rows with a null label or vector, or with a null or
    non-finite component, take no part. Vectors of different length do not
    meet; a repeated row is an anchor and a candidate of its own. Scores beyond
    a long count as the long's end. An empty table gives an empty result.

    Candidates lie in units of about ``UNIT`` rows (fewer of long vectors) with
    a sorted list for each dimension: by label for the positives (a hot label has many units), over all
    labels for the negatives. Anchors stream past the units; each unit is
    searched by the threshold algorithm, and the best of all units remain.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = written_once(quantised(vectors.where("label IS NOT NULL"), "vec_id", "label"), "vectors")
    names = written_once(rows.select("label", "dimension").groupBy("label", "dimension").agg(F.count("*").alias("n")), "labels")
    # Labels of any type are compared by a number: the smallest row of the label.
    code = rows.groupBy("label").agg(F.min("rid").alias("code"))
    rows = written_once(
        rows.join(code, "label").join(names, ["label", "dimension"]).select(
            "rid", "vec_id", "code", "dimension", "y",
            F.pmod(F.xxhash64("rid"), units_for(F.col("n"), F.col("dimension"), UNIT)).cast("int").alias("salt"),
            units_for(F.col("n"), F.col("dimension"), UNIT).alias("salts"),
        ).withColumnRenamed("code", "label"),
        "vectors",
    )
    anchors = rows.where(F.col("vec_id") % every == 0)
    columns = ["rid", "vec_id", "label", "dimension", "y"]

    def of_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in meetings(batches, ["dimension", "label", "salt"], Lists):
            get = dict(zip(part.schema.names, part.columns))
            rids = get["rid"].to_numpy()
            everything = [[(-np.inf, np.inf)]] * len(rids)
            found = unit.search(matrix(get["y"], unit.dimension), rids[:, None] != unit.rid, everything, positives)
            asked = np.repeat(np.arange(len(rids)), [len(f[0][0]) for f in found])
            at = np.concatenate([f[0][0] for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids[asked]), pa.array(unit.rid[at]), pa.array([unit.ids[i] for i in at], pa.int64()),
                 pa.array([as_long(x) for f in found for x in f[0][1]], pa.int64())],
                names=["anchor", "rid", "vec_id", "score"],
            )

    asks = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    same = met(rows.select(*columns, "salt"), asks.select(*columns, "salt"), ["dimension", "label", "salt"])
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "rid"]
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    near = same.mapInArrow(of_label, "anchor long, rid long, vec_id long, score long").withColumn("at", first)
    # At most ``positives`` to an anchor.
    chosen = near.where(F.col("at") <= positives).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("positives")
    )
    asked = written_once(
        anchors.join(chosen, anchors["rid"] == chosen["anchor"]).select(*columns, "positives"), "anchors"
    )
    # All candidates of a length, in units of any label.
    sizes = names.groupBy("dimension").agg(F.sum("n").alias("n"))
    sizes = sizes.select("dimension", units_for(F.col("n"), F.col("dimension"), UNIT).alias("units"))
    pool = rows.select(*columns).join(sizes, "dimension").withColumn("unit", F.pmod(F.xxhash64("rid", F.lit(1)), "units").cast("int")).drop("units")
    sent = asked.join(sizes, "dimension").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in meetings(batches, ["dimension", "unit"], Lists):
            get = dict(zip(part.schema.names, part.columns))
            rids, labels = get["rid"].to_numpy(), get["label"].to_numpy()
            picked = [[(p["at"], p["score"]) for p in x] for x in get["positives"].to_pylist()]
            picked = [[(at, s, *window(s, least, most)) for at, s in x if s >= 0] for x in picked]
            windows = [[w[2:] for w in x] for x in picked]
            found = unit.search(matrix(get["y"], unit.dimension), labels[:, None] != unit.label, windows, negatives)
            out = {c: [] for c in ("anchor", "at", "rid", "vec_id", "score")}
            for rid, x, hits in zip(rids.tolist(), picked, found):
                for (at, *_), (where, scores) in zip(x, hits):
                    out["anchor"] += [rid] * len(where)
                    out["at"] += [at] * len(where)
                    out["rid"] += unit.rid[where].tolist()
                    out["vec_id"] += [unit.ids[i] for i in where]
                    out["score"] += [as_long(s) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if c == "at" else pa.int64()) for c, v in out.items()], names=list(out)
            )

    hits = met(pool, sent, ["dimension", "unit"]).mapInArrow(others, "anchor long, at int, rid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "at").orderBy(*order))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hits.join(asked.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives"), "anchor").select(
        "anchor_id",
        F.col("positives")[F.col("at") - 1]["vec_id"].alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("positives")[F.col("at") - 1]["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Smallest and largest integer score from ``least`` to ``most`` hundredths of ``score``."""
    return -(-least * score // 100), most * score // 100


def negatives_sql() -> str:
    """The same by brute force, with the labels of the registered query."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings WHERE label IS NOT NULL
        AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.y, v.y) AS BIGINT) AS score
        FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *,
        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same) WHERE i <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3"""
