"""Near-duplicate vectors by robust-pruned flat graphs on cluster shards that overlap by those who ask in them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import FACTORS, U64, mix, tidy
from logloom.llm.graph import components
from logloom.llm.units import meetings, met, units_for
from logloom.session import written_once

#: Vectors of the sample that the pivots are fitted on, and pivots at most.
SAMPLE, PIVOTS = 20_000, 1024
#: Vectors that have a pivot as their nearest, members that a graph is built on, and members of a search; each about.
SHARD, GRAPH, PART = 4000, 1500, 8000
#: Neighbours kept of so many candidates, the slack of the pruning rule, and the first beam of a search.
DEGREE, CANDIDATES, SLACK, BEAM = 24, 64, 1.2, 32
#: Vectors whose id this number divides are audited against brute force.
AUDIT = 20
#: Vectors out of range that a search expands at once, askers that meet a part in one task, about, and directions of a sketch.
AT_ONCE, TURN, SKETCH = 8, 32_000, 16
#: Components that one wave moves: so many times those of all vectors, or the least number; what a row's keys take besides.
WAVE, WAVE_LEAST, ROW = 1.5, 1 << 24, 16


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Unit centres of the sample by a few rounds of spherical k-means."""
    count = min(count, len(sample))
    centres = sample[np.random.default_rng(5).choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def robust_graph(unit: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists: per vector the nearest candidates, without those that a chosen one is nearer to by the slack.

    All vectors are pruned at once. Reverse edges follow, and what the medoid
    cannot reach is linked from its nearest reached vector.
    """
    n = len(unit)
    if n == 1:
        return [np.zeros(0, np.int64)]
    # Squares of distances; single precision does for a graph, hits are judged by the vectors.
    single = unit.astype(np.float32)
    far = single @ single.T
    far *= -2
    far += 2
    np.maximum(far, 0, out=far)
    np.fill_diagonal(far, np.inf)
    width = min(CANDIDATES, n - 1)
    near = np.argpartition(far, width - 1, axis=1)[:, :width]
    own = np.take_along_axis(far, near, axis=1)
    order = own.argsort(axis=1)
    near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
    alive, rows = np.ones(near.shape, bool), np.arange(n)
    edges = []
    for _ in range(min(DEGREE, width)):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        chosen = near[rows, pick]
        edges.append(np.stack([rows[some], chosen[some]]))
        alive[rows, pick] = False
        alive &= far[chosen[:, None], near] > own / SLACK**2
        alive &= some[:, None]
    pairs = np.concatenate(edges, axis=1)
    pairs = np.unique(np.concatenate([pairs[0] * n + pairs[1], pairs[1] * n + pairs[0]]))
    lists = np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n))
    reached, front = np.zeros(n, bool), np.array([medoid(unit)])
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return lists
        known = np.flatnonzero(reached)
        gate = known[far[lost[0], known].argmin()]
        lists[gate] = np.append(lists[gate], lost[0])
        front = lost[:1]


def medoid(unit: np.ndarray) -> int:
    """The vector nearest to the mean."""
    return int((unit @ unit.mean(axis=0)).argmax())


def range_search(query: np.ndarray, unit: np.ndarray, lists: list[np.ndarray], start, beam: int, least: float) -> np.ndarray:
    """Vectors with a cosine of ``least`` or more: a greedy beam search from one or several starts, expanded over every hit.

    The beam holds the best vectors out of range, some of which are expanded at a time until
    none is left. It widens as hits come: any vector in range is expanded, however many.
    """
    seen = np.zeros(len(unit), bool)
    seen[start] = True
    fresh = np.flatnonzero(seen)
    hits, close, names, todo = [], np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
    while True:
        cosine = unit[fresh] @ query
        inside = cosine >= least
        front = fresh[inside]
        if len(fresh):
            close, names = np.append(close, cosine[~inside]), np.append(names, fresh[~inside])
            todo = np.append(todo, np.ones(len(close) - len(todo), bool))
            if len(close) > beam:
                best = np.argpartition(close, -beam)[-beam:]
                close, names, todo = close[best], names[best], todo[best]
        if len(front):
            hits.append(front)
        else:
            wait = np.flatnonzero(todo)
            if not len(wait):
                return np.concatenate([*hits, names[:0]])
            if len(wait) > AT_ONCE:
                wait = wait[np.argpartition(close[wait], -AT_ONCE)[-AT_ONCE:]]
            todo[wait] = False
            front = names[wait]
        fresh = np.concatenate([lists[i] for i in front])
        fresh = np.unique(fresh[~seen[fresh]])
        seen[fresh] = True


def _searched(ids, queries, start: Callable[[int], np.ndarray], unit, lists, least: float) -> tuple[list[np.ndarray], int]:
    """Hits of every query and the beam used: the audited queries must miss nothing, else the beam doubles."""
    beam = BEAM
    audit = np.flatnonzero(ids % AUDIT == 0)
    truth = [np.flatnonzero(unit @ queries[i] >= least) for i in audit]
    while beam < len(unit):
        tried = {i: range_search(queries[i], unit, lists, start(i), beam, least) for i in audit}
        if all(len(np.setdiff1d(t, tried[i])) == 0 for i, t in zip(audit, truth)):
            found = [tried[i] if i in tried else range_search(q, unit, lists, start(i), beam, least) for i, q in enumerate(queries)]
            return found, beam
        beam *= 2
    return [np.flatnonzero(unit @ q >= least) for q in queries], len(unit)


def united(ids: np.ndarray, unit: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The lists of a graph over all vectors, united from overlapping pieces of about twice ``size``, and where to start.

    Each vector lies in two pieces, dealt by id, so that the lists lead from any piece to the others.
    """
    n = len(unit)
    count = -(-n // size)
    piece = (mix(ids.view(U64)) % U64(count)).astype(np.int64)
    also = (piece + 1 + (mix(ids.view(U64) * FACTORS[1]) % U64(max(count - 1, 1))).astype(np.int64)) % count
    links, start = [], []
    for p in range(count):
        inside = np.flatnonzero((piece == p) | (also == p))
        if len(inside):
            lists = robust_graph(unit[inside])
            source = np.repeat(inside, [len(x) for x in lists])
            links.append(source * n + inside[np.concatenate(lists)])
        own = np.flatnonzero(piece == p)
        if len(own):
            start.append(own[medoid(unit[own])])
    pairs = np.unique(np.concatenate(links))
    return np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n)), np.array(start)


def sketch_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal directions in which the sample differs most, as rows."""
    some = sample[:512]
    return np.linalg.svd(some - some.mean(axis=0), full_matrices=False)[2][:SKETCH]


class Part:
    """Members of a shard that a task holds: their graph, their sketches, and the components of what was found so far.

    Between sketches, vectors are at most as far apart as they are: whoever is
    linked with a member lies within the length of a link from its sketch.
    """

    def __init__(self, table: pa.Table, axes: np.ndarray, size: int, least: float):
        self.dimension, self.least = table.column("dimension")[0].as_py(), least
        self.ids, self.copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        self.unit = _vectors(table.column("embedding").combine_chunks(), self.dimension)
        self.lists, self.start = united(self.ids, self.unit, size)
        self.axes = axes
        drawn = self.unit @ axes.T
        self.drawn = np.column_stack([drawn, -(drawn**2).sum(axis=1) / 2]).astype(np.float32).T
        self.order = np.argsort(self.ids)
        self.root = np.arange(len(self.ids))
        self.asks: list[np.ndarray] = []
        self.queries: list[np.ndarray] = []

    def sketches(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A score of each member's sketch for each query, and the least score of one within the length of a link.

        |a - b|^2 <= 2 - 2 least if and only if a.b - |b|^2 / 2 >= (|a|^2 - 2 + 2 least) / 2; rounding gets a margin.
        """
        drawn = queries @ self.axes.T
        return np.column_stack([drawn, np.ones(len(drawn))]).astype(np.float32) @ self.drawn, (drawn**2).sum(axis=1) / 2 - 1 + self.least - 1e-4

    def ask(self, rows: pa.RecordBatch) -> int:
        """Keep the askers whose sketch is near that of another member, and return how many are kept."""
        get = dict(zip(rows.schema.names, rows.columns))
        asks, queries = get["rep"].to_numpy(), _vectors(get["embedding"], self.dimension)
        near, bound = self.sketches(queries)
        at = np.minimum(np.searchsorted(self.ids, asks, sorter=self.order), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[self.order[at]] == asks)
        near[own, self.order[at[own]]] = -np.inf
        may = near.max(axis=1) >= bound
        # The audit covers the sketches as well.
        audited = np.flatnonzero(~may & (asks % AUDIT == 0))
        true = self.unit @ queries[audited].T >= self.least
        may[audited] = (true & (self.ids[:, None] != asks[audited])).any(axis=0)
        if may.any():
            self.asks.append(asks[may])
            self.queries.append(queries[may])
        return sum(map(len, self.asks))

    def starts(self, query: np.ndarray) -> np.ndarray:
        """Where a search begins: the medoids, and every member whose sketch is near."""
        near, bound = self.sketches(query[None])
        return np.append(self.start, np.flatnonzero(near[0] >= bound[0]))

    def answer(self) -> pa.RecordBatch:
        """Counts of the kept askers, and edges of a forest that joins them with what they are linked with."""
        out = {"rep": [], "n": [], "edge": []}
        if self.asks:
            asks, queries = np.concatenate(self.asks), np.concatenate(self.queries)
            self.asks, self.queries = [], []
            hits, _ = _searched(asks, queries, lambda i: self.starts(queries[i]), self.unit, self.lists, self.least)
            for ask, found in zip(asks, hits):
                other = found[self.ids[found] != ask]
                if not len(other):
                    continue
                out["rep"] += [int(ask)] * 2
                out["n"] += [int(self.copies[other].sum()), None]
                out["edge"] += [None, int(self.ids[other[0]])]
                roots = np.unique(self.root[other])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
                    out["rep"] += self.ids[roots[1:]].tolist()
                    out["n"] += [None] * (len(roots) - 1)
                    out["edge"] += [int(self.ids[roots[0]])] * (len(roots) - 1)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Links, components and a verdict for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null and their
    cosine, in double precision, is at least ``least``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; nor do
    vectors of different length.

    1. Equal vectors of a label are folded into one that carries their number.
    2. Pivots are fitted on at most ``SAMPLE`` vectors, the smallest by hash of
       the id. Every vector is a member of the shard of its nearest pivot, its
       home, and an asker there and in every shard whose border is as near as a
       link is long: by the triangle inequality both ends of a link meet once in
       the home of either. Members lie in parts of about ``PART``.
    3. Graphs are robust-pruned and built on pieces of a part, of about twice
       ``GRAPH`` members; where there are several, each member is put into two.
       The lists that a vector has from its pieces are united. A sketch is a
       projection on ``SKETCH`` directions. A search starts at the medoids of the
       pieces and at the members whose sketches are as near as a link is long,
       among which every hit is, and expands over all hits; an asker without
       such a member has no link in the part and is not searched for.
    4. Every 20th id is audited by brute force within its part, whatever its
       sketch; a miss doubles the beam for all, at last to an exact scan. Hits
       are cosines above the threshold, hence verified. ``audit`` measures the
       recall over all rows.

    A task holds one part, and askers stream past. It returns counts and
    a spanning forest of its links, never the pairs. Parts and their askers are
    moved in waves of about ``WAVE`` times the vectors, and what a wave has
    moved is gone when the next begins: in many dimensions most borders are
    near, and the vectors put into all their shards at once would take many
    times the disk of the input.

    Returns vec_id, n_links, component_id, kept (vec_id = component_id).
    Repeated rows each get their row and count as different vectors. Labels may
    be of any type that has a text form, by which they are compared.
    """
    rows = _labelled(vectors)
    named = rows.select(
        "vec_id", "label", "given", "good", F.xxhash64("label", "embedding").alias("k1"),
        F.xxhash64(F.lit(7), "embedding", "label").alias("k2"),
    )
    folded = written_once(
        named.where("good").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("given").alias("embedding"),
        ).select("*", F.size("embedding").alias("dimension"), F.xxhash64("label").alias("code"), F.xxhash64(F.lit(7), "label").alias("code2")),
        "vectors",
    )
    # One pivot set per vector length; labels share it.
    found = _links(folded, least)
    counts = found.where("edge IS NULL").groupBy("rep").agg(F.sum("n").alias("others"))
    parts = components(found.where("edge IS NOT NULL").select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    whole = (
        folded.select("k1", "k2", "rep", "copies").join(counts, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
                F.coalesce("component", "rep").alias("part"))
    )
    plain = named.select("vec_id", F.when(F.col("good"), F.col("k1")).alias("k1"), F.when(F.col("good"), F.col("k2")).alias("k2"))
    return plain.join(whole, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("part", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("part", "vec_id")).alias("kept"),
    )


def _labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), embedding, the same as it was given if in floats, and whether the row can link at all."""
    good = F.expr(
        "label IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) "
        "OR abs(x) = double('infinity')) AND exists(embedding, x -> x != 0)"
    )
    double = F.col("embedding").cast("array<double>")
    # Floats are doubles of half the size.
    given = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else double
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), double.alias("embedding"), given.alias("given"))
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.98, every: int = AUDIT) -> DataFrame:
    """One row: the links of every ``every``-th id by brute force over all rows, how many ``found`` has, and the recall.

    ``found`` is the result of ``near_vectors``. Queries stream past bounded units of members.
    """
    rows = _labelled(vectors).where("good").select(
        F.monotonically_increasing_id().alias("rid"), "vec_id", F.xxhash64("label").alias("code"),
        F.size("embedding").alias("dimension"), "embedding",
    )
    rows = written_once(rows, "audit")
    sizes = rows.groupBy("code", "dimension").agg(F.count("*").alias("n"))
    sizes = sizes.select("code", "dimension", units_for(F.col("n"), F.col("dimension")).alias("salts"))
    rows = rows.join(sizes, ["code", "dimension"])
    members = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), "salts").cast("int")).drop("salts")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(table: pa.Table):
            dimension = table.column("dimension")[0].as_py()
            return dimension, table.column("rid").to_numpy(), _vectors(table.column("embedding").combine_chunks(), dimension)

        for (dimension, rids, own), part in meetings(batches, ["code", "dimension", "salt"], unit):
            get = dict(zip(part.schema.names, part.columns))
            near = _vectors(get["embedding"], dimension) @ own.T >= least
            near &= get["rid"].to_numpy()[:, None] != rids
            yield pa.RecordBatch.from_arrays([get["vec_id"], pa.array(near.sum(axis=1))], names=["vec_id", "n"])

    true = met(members, asked, ["code", "dimension", "salt"]).mapInArrow(count, "vec_id long, n long")
    true = true.groupBy("vec_id").agg(F.sum("n").alias("n"))
    had = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.sum("n_links").alias("had"))
    both = true.join(had, "vec_id").agg(F.sum("n").alias("links"), F.sum("had").alias("found_links"))
    return both.withColumn("recall", F.when(F.col("links") > 0, F.col("found_links") / F.col("links")).otherwise(F.lit(1.0)))


def _links(folded: DataFrame, least: float) -> DataFrame:
    """(rep, n, null): how many vectors link to rep in one part; (rep, null, edge): an edge of the forest."""
    lengths = folded.groupBy("label", "dimension").count().groupBy("dimension").agg(F.max("count").alias("n"), F.sum("count").alias("all")).collect()
    # One sample for all lengths; a length that it misses has one pivot, whichever.
    drawn: dict[int, list] = {}
    hashed = folded.select("dimension", "embedding", F.xxhash64("rep").alias("h"), "rep")
    # The smallest hashes lie below this, and hardly any more.
    below = -(1 << 63) + int((1 << 64) * min(1.0, 2 * SAMPLE / max(1, sum(r["all"] for r in lengths)))) - 1
    picked = hashed.where(F.col("h") <= below).orderBy("h", "rep").limit(SAMPLE)
    for r in picked.select("dimension", "embedding").collect():
        drawn.setdefault(r["dimension"], []).append(r["embedding"])
    pivots, axes = {}, {}
    for dimension, largest in ((r["dimension"], r["n"]) for r in lengths):
        sample = _vectors(pa.array(drawn.get(dimension, [[1.0] * dimension]), pa.list_(pa.float64())), dimension)
        pivots[dimension], axes[dimension] = fit_pivots(sample, min(PIVOTS, -(-largest // SHARD))), sketch_axes(sample)
    # The length of a link, and a little more than rounding may add to it.
    border = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    part_size, turn_size, graph_size = PART, TURN, GRAPH

    def placed(batches: Iterator[pa.RecordBatch]):
        """(dimension, its rows of a batch, home of each; row and pivot of each asker)."""
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dimension")).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                unit, centres = _vectors(rows.column("embedding"), int(d)), pivots[int(d)]
                cosine = unit @ centres.T
                home = cosine.argmax(axis=1)
                best = cosine[np.arange(len(unit)), home]
                apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))[home]
                yield int(d), rows, home, *np.nonzero((best[:, None] - cosine) / apart <= border)

    def shards(rows: pa.RecordBatch, row: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """A hash of label, dimension and pivot."""
        code, dimension = rows.column("code").to_numpy()[row].view(U64), rows.column("dimension").to_numpy()[row].astype(U64)
        return mix(mix(code + dimension * FACTORS[0]) + pivot.astype(U64) * FACTORS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dimension, rows, home, row, pivot in placed(batches):
            at = np.arange(len(home))
            keys, place = np.unique(np.concatenate([shards(rows, at, home), shards(rows, row, pivot)]), return_inverse=True)
            homes, asks = np.bincount(place[: len(at)], minlength=len(keys)), np.bincount(place[len(at) :], minlength=len(keys))
            yield pa.RecordBatch.from_pydict({
                "shard": keys.view(np.int64), "dimension": pa.array(np.full(len(keys), dimension), pa.int32()), "homes": homes, "asks": asks,
            })

    given = folded.select("code", "code2", "dimension", "rep", "copies", "embedding")
    sizes = given.mapInArrow(tidy(count), "shard long, dimension int, homes long, asks long")
    sizes = sizes.groupBy("shard").agg(F.max("dimension").alias("dimension"), F.sum("homes").alias("homes"), F.sum("asks").alias("asks"))
    sizes = written_once(
        sizes.withColumns({
            c: F.greatest(F.lit(1), F.ceil(F.col(n) / most).cast("int")) for c, n, most in (("parts", "homes", part_size), ("turns", "asks", turn_size))
        }),
        "shards",
    )
    # One of these holds more than a part of the members or a turn of the askers, so they are few.
    large = sizes.where("parts > 1 OR turns > 1").select("shard", "parts", "turns").orderBy("shard").collect()
    moved = sizes.agg(F.sum(F.expr(f"({ROW} + dimension) * (asks * parts + homes * turns)"))).first()[0] or 0
    waves = max(1, math.ceil(moved / max(WAVE_LEAST, WAVE * sum((ROW + r["dimension"]) * r["all"] for r in lengths))))
    known = np.array([r["shard"] for r in large], np.int64)
    split = np.array([(r["parts"], r["turns"]) for r in large], np.int64).reshape(-1, 2)

    def dealt(wave: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows, home, row, pivot in placed(batches):
                for kind, row, pivot in ((0, np.arange(len(home)), home), (1, row, pivot)):
                    shard = shards(rows, row, pivot)
                    size = np.ones((len(row), 2), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, shard.view(np.int64)), len(known) - 1)
                        size = np.where((known[at] == shard.view(np.int64))[:, None], split[at], size)
                    # A member lies in one part and meets all turns of the askers; an asker has one turn at all parts.
                    fixed, free = (size[:, 0], size[:, 1]) if kind == 0 else (size[:, 1], size[:, 0])
                    name = mix(rows.column("rep").to_numpy().view(U64)[row] * FACTORS[0] + U64(kind))
                    own = np.repeat((name % fixed.astype(U64)).astype(np.int64), free)
                    every = np.arange(len(own)) - np.repeat(np.cumsum(free) - free, free)
                    row, pivot, shard = np.repeat(row, free), np.repeat(pivot, free), np.repeat(shard, free)
                    part, turn = (own, every) if kind == 0 else (every, own)
                    now = mix(shard + part.astype(U64) * FACTORS[0] + turn.astype(U64) * FACTORS[1]) % U64(waves) == U64(wave)
                    out = rows.take(pa.array(row[now]))
                    for column, value in (("pivot", pivot), ("part", part), ("turn", turn), ("kind", np.full(len(row), kind))):
                        out = out.append_column(column, pa.array(value[now], pa.int32()))
                    # Rows are multiplied here, so they go on in small batches.
                    yield from (out.slice(i, 2048) for i in range(0, out.num_rows, 2048))

        return deal

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prepare(table: pa.Table) -> Part:
            return Part(table, axes[table.column("dimension")[0].as_py()], graph_size, least)

        part = None
        for now, rows in meetings(batches, keys, prepare):
            if part is not None and part is not now:
                yield part.answer()
            part = now
            if part.ask(rows) >= part_size:
                yield part.answer()
        if part is not None:
            yield part.answer()

    keys = ["code", "code2", "dimension", "pivot", "part", "turn"]
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    put = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pivot int, part int, turn int, kind int"
    tasks = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for wave in range(waves):
        # A number of their own: partitions are searched at length, however few bytes they have.
        both = given.mapInArrow(tidy(dealt(wave)), put).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind")
        found.append(written_once(both.mapInArrow(tidy(search), "rep long, n long, edge long"), "links"))
    return reduce(DataFrame.union, found)
