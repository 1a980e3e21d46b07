"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import FACTORS, U64, Block, blocks, mix, piece_hashes, tidy, tidy_group
from logloom.llm.graph import components
from logloom.session import written_once

#: Shingles are hashed into this universe before the two permutations.
UNIVERSE_BITS = 20
#: A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**6)**32 < 3e-7;
#: at 0.8 with six-row bands (1 - 0.8**6)**32 < 6e-5.
BANDS, ROWS = 32, 6
#: Sets of a family block.
BLOCK = 64
#: Names of rows without an id begin here.
UNNAMED = 2**63 - 1 - 2**60

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one in all its shifted windows (views of one array)."""
    size = 1 << UNIVERSE_BITS
    random = np.random.default_rng(11)
    first = random.permutation(size).astype(np.int32)
    second = random.permutation(size).astype(np.uint32)
    return first, sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """Each document's distinct n-word shingles as sorted hashes; with fewer words the whole sequence is one."""
    data = LOWER[block.data]
    begin, end, first = block.words()
    word = piece_hashes(data, begin, end)
    gram = word.copy()
    if len(word) >= n:
        head = word[: len(word) - n + 1]
        for k in range(1, n):
            head = head * FACTORS[0] + word[k : len(word) - n + 1 + k]
        gram[: len(head)] = mix(head)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            whole = word[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole * FACTORS[1] + word[k : k + 1])
            out.append(mix(whole + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k, over the set's places after the first."""
    first, shifted = _permutations(coordinates)
    place = first[(shingles >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full(coordinates, 1 << UNIVERSE_BITS, np.uint32)
    for at in range(0, len(place), 2048):
        np.minimum(out, shifted[place[at : at + 2048]].min(axis=0), out=out)
    return out


def _band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=U64)
    for column in sign.reshape(bands, rows).T.astype(U64):
        key = mix(key * FACTORS[1] + column)
    return key.astype(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, ident, size of the shingle set, a digest of the set, and one key per band (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(block, n)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = [_band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").cast(pa.int64()),
                    block.column("ident"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "ident", "n_shingles", "set_key", "bands"],
            )

    return docs.select("doc_id", "ident", "text").mapInArrow(
        tidy(run), "doc_id long, ident long, n_shingles long, set_key binary, bands array<long>"
    )


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in blocks(iter([batch]), "left", 1 << 20):
                ones, others = shingle_sets(half, n), shingle_sets(Block(half.rows, "right"), n)
                good = []
                for x, y in zip(ones, others):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield half.rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the component of its near-duplicate links.

    Two documents are linked if 100 * intersection >= percent * union holds for
    their sets of distinct n-word shingles (letters A-Z in lower case).

    1. One pass makes a digest of the set and the circulant MinHash bands.
       Documents with equal sets are folded on the digest into one, so copies
       meet no further and a group of any size costs one row.
    2. Sets meet in buckets of equal band keys. Each bucket is first joined with
       its smallest id only (a star), the pairs are verified on the full sets,
       and what they link becomes components.
    3. Buckets that still hold several components go on. Shingles that no other
       such set holds bound what a set can share with any other; sets that
       cannot reach the similarity by that bound are done (an exact test). The
       rest is compared on full sets, across components only, family by family
       in pairs of small blocks. The joins are plain equi-joins, so adaptive
       execution splits a hot bucket. No bucket is capped, no member dropped.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself
    included), kept (doc_id = component_id). A null or wordless text has an
    empty set and is linked with nothing. Rows that share a doc_id count as one
    document and each get their row. A null doc_id never represents a
    component that holds a document with an id; it takes the smallest id of the
    documents that it reaches, or null without any. Ids lie below ``UNNAMED``.
    """
    # Rows without an id go by their text, above all ids.
    unnamed = F.lit(2**63 - 1) - F.abs(F.xxhash64("text") % F.lit(2**60))
    docs = docs.select("doc_id", "text").withColumn("ident", F.coalesce("doc_id", unnamed))
    rows_of = written_once(signatures(docs, n, bands, rows), "minhash")
    sets = (
        rows_of.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("ident").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    )
    sets = written_once(sets, "minhash")
    members = sets.select("rep", "size", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.struct("rep", "size")).alias("hub")
    ).where("n > 1").select("bucket", "hub")
    shared = written_once(members.join(heads, "bucket"), "minhash")
    # The texts of all sets that meet another one, written once for both verifications.
    met = shared.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    named = docs.select(F.col("ident").alias("doc_id"), "text")
    texts = written_once(named.join(met, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "minhash")
    near = f"100 * least(x, y) >= {percent} * greatest(x, y) AND a != b"
    star = written_once(
        shared.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("hub.size").alias("x"),
                      F.col("size").alias("y")).where(near).select("a", "b").distinct(),
        "minhash",
    )
    links = written_once(verified(star, texts, n, percent), "minhash")
    parts = components(links)
    labelled = written_once(
        shared.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
            "bucket", "rep", "size", F.coalesce("component", "rep").alias("part")
        ),
        "minhash",
    )
    # Members of one component need no pair among themselves: a bucket goes on
    # only if it has two components, and only across them.
    open_ = labelled.groupBy("bucket").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.min("size").alias("smallest")
    ).where("low != high")
    rest = labelled.join(open_.select("bucket", "smallest"), "bucket")
    own = own_counts(texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), n)
    # What a set shares with others bounds every intersection: most can be ruled out alone.
    rest = written_once(
        rest.join(own, "rep", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
        .withColumn("other", F.greatest("smallest", "common"))
        .where(f"100 * common >= {percent} * (size + other - common)").drop("other", "smallest"),
        "minhash",
    )
    # Sets that still meet, over any number of buckets, form a family.
    low = rest.groupBy("bucket").agg(F.min("rep").alias("a"))
    family = components(rest.join(low, "bucket").select("a", F.col("rep").alias("b")))
    more = written_once(family_links(rest.select("rep", "part").distinct(), family, texts, n, percent), "minhash")
    whole = components(links.union(more)).withColumnRenamed("node", "rep")
    by_set = sets.join(whole, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    return (
        rows_of.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce(F.when(F.col("component_id") < UNNAMED, F.col("component_id")), "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def family_links(members: DataFrame, family: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) across the parts of each family: a spanning forest of them per pair of blocks.

    A family is dealt into blocks; every pair of blocks is compared in a task
    as one product of two small matrices over the shingles they share, so that
    pairs are counted and not listed.
    """
    placed = members.join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    sizes = placed.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = (
        placed.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "part", "text")
    )

    def compare(table: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for block in blocks(iter(table.to_batches())):
            sets += shingle_sets(block, n)
        reps, part, own = (table.column(c).to_numpy() for c in ("rep", "part", "own"))
        size = np.array([len(s) for s in sets], np.float32)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size.astype(int))
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.append(False, flat[1:] != flat[:-1]))
        several = np.bincount(column)[column] > 1
        column, owner = np.unique(column[several], return_inverse=True)[1], owner[several]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, 4096):
            here = (column >= at) & (column < at + 4096)
            held = np.zeros((len(sets), 4096), np.float32)
            held[owner[here], column[here] - at] = 1
            both += held @ held.T
        good = 100 * both >= percent * (size[:, None] + size - both)
        good &= part[:, None] != part
        i = table.column("i")[0].as_py()
        if (own != i).any():
            good &= (own == i)[:, None] & (own != i)
        part, edges = part.copy(), []
        for a, b in zip(*np.nonzero(good)):
            if part[a] != part[b]:
                edges.append((reps[a], reps[b]))
                part[part == part[b]] = part[a]
        return pa.table({k: pa.array([e[x] for e in edges], pa.int64()) for x, k in enumerate("ab")})

    return dealt.groupBy("family", "i", "j").applyInArrow(tidy_group(compare), "a long, b long")


def own_counts(texts: DataFrame, n: int) -> DataFrame:
    """For each text with any, how many of its shingles occur in no other one of them: (rep, own).

    Shingles are counted, those with one owner are charged to it; partial sums
    keep a shingle of all texts from gathering anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(block, n)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            owner = np.repeat(np.arange(len(sets)), sizes.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).astype(np.int64)), block.column("doc_id").take(pa.array(owner))],
                names=["shingle", "rep"],
            )

    owned = texts.select("doc_id", "text").mapInArrow(tidy(run), "shingle long, rep long")
    counts = owned.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    return counts.where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
