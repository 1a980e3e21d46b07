"""Knowledge retrieval: loading once, similarity, diverse answers, fallback, context."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_once
from ..sizing import rows_if_small
from .keyword_index import keyword_search

# Fixed value: candidates of which diverse answers are chosen.
FETCH = 20

# Queries up to this many travel to every task; more are met block by block.
MAX_INLINE_QUERIES = 2_000
CELL_ROWS = 50_000


def load_once(docs: DataFrame, seen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose content was not loaded before, one per content.

    Copies are folded on (hash, key) pairs only, so a text with many copies
    moves no text; the text is read again for the keys that are left.
    """
    hashed = docs.select(F.md5(text).alias("md5"), key)
    fresh = hashed.groupBy("md5").agg(F.min(key).alias(key)).join(seen.select("md5"), "md5", "left_anti")
    return docs.join(fresh, key)


def topk_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    min_score: float | None = None,
    max_inline: int = MAX_INLINE_QUERIES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The ``k`` most similar corpus rows per query by cosine, exact.

    ``queries(query_id, embedding)``, ``corpus(item_id, embedding)``; result
    ``query_id, rank, item_id, score``, ties by item id. A vector that is null,
    empty or holds a null or non-finite component takes no part; vectors of
    different length do not meet; one of length zero scores 0. Every task keeps the
    best ``k`` per query of its own rows, so the shuffle carries k rows per
    query and task, never all pairs. Up to ``max_inline`` queries are sent along
    with the tasks; above that both sides are cut into blocks of bounded size
    and every pair of blocks is one task.
    """
    spark = queries.sparkSession
    queries, corpus = queries.where(_usable()), corpus.where(_usable())
    types = (queries.schema["query_id"].dataType.simpleString(), corpus.schema["item_id"].dataType.simpleString())
    schema = f"query_id {types[0]}, item_id {types[1]}, score double"
    small = rows_if_small(queries.select("query_id", "embedding"), max_inline)
    if small is not None:
        if not small:
            best = spark.createDataFrame([], schema)
        else:
            ids = [r.query_id for r in small]
            vectors = [np.array(r.embedding, dtype=float) for r in small]

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                kept = None
                for batch in batches:
                    found = _best(ids, vectors, batch, k)
                    kept = found if kept is None else _cut(pd.concat([kept, found]), k)
                if kept is not None:
                    yield kept

            best = corpus.select("item_id", "embedding").mapInPandas(scan, schema)
    else:

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
            return _best(list(left["query_id"]), list(left["embedding"]), right, k)

        best = _blocks(queries, corpus, cell, schema, max_inline, cell_rows, ["embedding"], ["embedding"])
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "item_id", "score")


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=float)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(ids: list, vectors: list[np.ndarray], batch: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` rows of one batch for every query of their vector length; unusable rows have no score."""
    parts = [pd.DataFrame({"query_id": pd.Series([], dtype=object), "item_id": [], "score": []})]
    lengths = np.array([-1 if v is None else len(v) for v in batch["embedding"]])
    for length in {len(v) for v in vectors}:
        asked = [i for i, v in enumerate(vectors) if len(v) == length]
        held = batch[lengths == length]
        if not len(held):
            continue
        rows = np.array(list(held["embedding"]), dtype=float).reshape(len(held), length)
        usable = np.isfinite(rows).all(axis=1)
        items, rows = held["item_id"].to_numpy()[usable], rows[usable]
        take = min(k, len(items))
        if not take:
            continue
        scores = _unit(rows) @ _unit(np.array([vectors[i] for i in asked])).T
        # Everything at least as good as the k-th score, so that ties are cut by id below.
        bounds = np.partition(scores, len(items) - take, axis=0)[len(items) - take]
        for q, i in enumerate(asked):
            column = scores[:, q]
            found = np.flatnonzero(column >= bounds[q])
            found = found[np.lexsort((items[found], -column[found]))][:take]
            parts.append(pd.DataFrame({"query_id": ids[i], "item_id": items[found], "score": column[found]}))
    full = [p for p in parts if len(p)]
    return pd.concat(full, ignore_index=True) if full else parts[0]


def _usable(embedding: str = "embedding") -> Column:
    """True where a vector has a component and none that is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _blocks(
    queries: DataFrame,
    corpus: DataFrame,
    cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    query_rows: int,
    corpus_rows: int,
    query_columns: Sequence[str],
    corpus_columns: Sequence[str],
) -> DataFrame:
    """Meet two large tables block by block.

    Hashes spread both sides over blocks of about the given size; each query
    block visits each corpus block once, so no task holds more than one block of
    either side.
    """
    n_query = max(1, math.ceil(queries.count() / query_rows))
    n_corpus = max(1, math.ceil(corpus.count() / corpus_rows))

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def all_blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("query_id", *query_columns, block("query_id", n_query).alias("_q")).withColumn(
        "_c", all_blocks(n_corpus)
    )
    right = corpus.select("item_id", *corpus_columns, block("item_id", n_corpus).alias("_c")).withColumn(
        "_q", all_blocks(n_query)
    )

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        types = {"query_id": a.schema.field("query_id").type, "item_id": b.schema.field("item_id").type}
        found = cell(a.to_pandas(), b.to_pandas())
        return pa.table({c: pa.array(found[c].tolist(), types.get(c, pa.float64())) for c in found.columns})

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, schema)


def diverse(
    candidates: DataFrame, k: int = 3, weight: float = 0.5
) -> DataFrame:
    """Maximal marginal relevance: ``k`` of each query's candidates that are similar to it but not to each other.

    ``candidates(query_id, item_id, score, embedding)``, a bounded number
    for each query, as ``topk_similar`` gives them. The first choice has the
    highest score; each further one the highest ``weight * score -
    (1 - weight) * (its highest cosine with a chosen one)``, ties by item id.
    Cosines of all pairs of a query's candidates come from one self-join; the
    choice is a fold over them. Returns ``query_id, rank, item_id, score``.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = written_once(candidates.select("query_id", "item_id", "score", vector.alias("v")), "candidates")
    a, b = rows.alias("a"), rows.alias("b")
    cosine = _cosine(F.col("a.v"), F.col("b.v"))
    near = a.join(b, F.col("a.query_id") == F.col("b.query_id")).groupBy("a.query_id", "a.item_id").agg(
        F.first("a.score").alias("score"), F.array_sort(F.collect_list(F.struct("b.item_id", cosine.alias("cosine")))).alias("near")
    )
    listed = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "score", "near"))).alias("all"))

    def value(c: Column, chosen: Column) -> Column:
        closest = F.array_max(F.transform(chosen, lambda x: F.filter(c["near"], lambda y: y["item_id"] == x["item_id"])[0]["cosine"]))
        return F.when(F.size(chosen) == 0, c["score"]).otherwise(weight * c["score"] - (1 - weight) * closest)

    def choose(chosen: Column, _: Column) -> Column:
        left = F.filter("all", lambda c: ~F.exists(chosen, lambda x: x["item_id"] == c["item_id"]))
        # Highest value first; the list is in order of the ids, so the first of equal ones has the smallest.
        valued = F.transform(left, lambda c, i: F.struct(value(c, chosen).alias("value"), (-i).alias("i"), c["item_id"].alias("item_id"), c["score"].alias("score")))
        best = F.array_max(valued)
        return F.when(F.size(left) == 0, chosen).otherwise(F.concat(chosen, F.array(F.struct(best["item_id"].alias("item_id"), best["score"].alias("score")))))

    item = rows.schema["item_id"].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<item_id:{item},score:double>>")
    chosen = listed.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), nothing, choose).alias("chosen"))
    return chosen.select("query_id", F.posexplode("chosen").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "c.item_id", "c.score"
    )


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def similar_and_diverse(
    queries: DataFrame, corpus: DataFrame, k: int = 3, fetch: int = FETCH, weight: float = 0.5, min_score: float | None = None
) -> DataFrame:
    """The ``fetch`` most similar rows of each query, cut to ``k`` by ``diverse``."""
    found = topk_similar(queries, corpus, fetch, min_score)
    return diverse(found.join(corpus.select("item_id", "embedding"), "item_id"), k, weight)


def retrieve_with_fallback(
    queries: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    k: int = 3,
    min_score: float | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Similar rows per query; keyword hits for queries without any; else an empty answer.

    ``queries(query_id, text, embedding)``; result ``query_id, source, rank,
    item_id, score``.
    """
    similar = written_once(topk_similar(queries, corpus, k, min_score), "similar")
    answered = similar.select("query_id").distinct()
    rest = queries.select("query_id", "text").join(answered, "query_id", "left_anti")
    found = written_once(keyword_search(rest, docs, key), "words")
    none = rest.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    item = similar.schema["item_id"].dataType.simpleString()
    vector = similar.select("query_id", F.lit("vector").alias("source"), "rank", "item_id", "score")
    word = found.select(
        "query_id",
        F.lit("keyword").alias("source"),
        F.lit(None).cast("int").alias("rank"),
        F.col("item_id").cast(item).alias("item_id"),
        F.lit(None).cast("double").alias("score"),
    )
    empty = none.select(
        "query_id",
        F.lit("none").alias("source"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast(item).alias("item_id"),
        F.lit(None).cast("double").alias("score"),
    )
    return vector.unionByName(word).unionByName(empty)


def context_text(ranked: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One context per query: its chunks numbered by rank, with their source.

    ``ranked`` holds at most k rows per query, so a context is short.
    """
    line = F.concat(
        F.lit("[参考资料"), F.col("rank").cast("string"), F.lit("]:参考资料:"), F.col(text),
        F.lit(" | 参考源数据："), F.col(source), F.lit("\n"),
    )
    lines = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")
    )
    return lines.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("context"))
