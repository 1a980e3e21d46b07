import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import chunking as ch
from logloom.operators import keyword_index as ki
from logloom.operators import retrieval as rt
from logloom.plans.knowledge import contexts, load_knowledge, retrieve


def test_load_once(spark, values):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "c")], "doc_id long, text string")
    seen = spark.createDataFrame([("c",)], "text string").select(F.md5("text").alias("md5"))
    assert [r[:2] for r in values(rt.load_once(docs, seen), "doc_id", "text")] == [(1, "a"), (2, "b")]
    chunks = load_knowledge(docs, seen)
    assert values(chunks, "doc_id", "chunk_no", "chunk") == [(1, 0, "a"), (2, 0, "b")]


def chunked(spark, texts, size, overlap, separators=ch.SEPARATORS):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    found = rows.select("doc_id", ch.chunks(F.col("text"), size, overlap, separators).alias("c")).collect()
    return [r.c for r in sorted(found, key=lambda r: r.doc_id)]


def test_chunks_of_ten(spark):
    cases = {
        "aaa. bbb. ccc": ["aaa. bbb", ". ccc"],
        "aaaa\n\nbbbb": ["aaaa\n\nbbbb"],
        "aaaaa\n\nbbbb": ["aaaaa", "bbbb"],
        "": [],
        "   ": [],
        "x" * 25: ["x" * 25],
        "ab.cd\nef.gh.ij.kl.mn": ["ab.cd", "ef.gh.ij", ".ij.kl.mn"],
        "\u3000é. \x1f": ["é."],
    }
    assert chunked(spark, cases, 10, 3) == list(cases.values())


def reference_chunks(text, size, overlap, separators):
    """Brute force: the same rules, by index arithmetic over whole strings."""
    separator = next((s for s in separators if s in text), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    starts = [0] + [i for i in range(len(text)) if text.startswith(separator, i)]
    if len(separator) > 1:
        kept, last = [0], -len(separator)
        for i in starts[1:]:
            if i >= last + len(separator):
                kept.append(i)
                last = i
        starts = kept
    pieces = [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)]) if text[a:b]]
    out, run = [], []

    def flush():
        first, last = 0, 0
        while last < len(run):
            while last < len(run) and (last == first or sum(map(len, run[first : last + 1])) <= size):
                last += 1
            out.append("".join(run[first:last]).strip())
            if last == len(run):
                break
            while first < last and (
                sum(map(len, run[first:last])) > overlap or sum(map(len, run[first : last + 1])) > size
            ):
                first += 1
        run.clear()

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            flush()
            out.extend(reference_chunks(piece, size, overlap, finer) if finer else [piece])
    flush()
    return [c for c in out if c]


@pytest.mark.parametrize("size, overlap", [(2, 0), (5, 6), (8, 3), (12, 5)])
def test_chunks_equal_brute_force(spark, size, overlap):
    seps = ["\n\n", "\n", ".", "!"]
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab .\n!") for _ in range(rng.randrange(80))) for _ in range(300)]
    assert chunked(spark, texts, size, overlap, seps) == [reference_chunks(t, size, overlap, seps) for t in texts]


def test_every_chunk_is_part_of_its_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    chunks = ch.chunk_documents(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert chunks.where(~F.col("text").contains(F.col("chunk"))).count() == 0
    assert chunks.where("length(trim(chunk)) = 0").count() == 0
    assert chunks.select("doc_id").distinct().count() == docs.where("length(trim(text)) > 0").count()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    corpus = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    corpus += [(1000 + i, corpus[i][1]) for i in range(5)] + [(2000, [0.0] * 4)]
    queries = [(f"q{i}", f"word{i}", [float(x) for x in rng.normal(size=4)]) for i in range(12)]
    return (
        spark.createDataFrame(queries, "query_id string, text string, embedding array<double>"),
        spark.createDataFrame(corpus, "item_id long, embedding array<double>").repartition(5),
        queries,
        corpus,
    )


def brute(queries, corpus, k):
    out = {}
    for q, _, v in queries:
        scores = []
        for i, w in corpus:
            n = np.linalg.norm(w) * np.linalg.norm(v)
            scores.append((-round(float(np.dot(v, w)) / n, 9) if n else 0.0, i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("inline", [100, 5])
def test_topk_equals_brute_force_on_both_paths(spark, vectors, inline):
    queries, corpus, q, c = vectors
    got = {}
    for r in rt.topk_similar(queries, corpus, 4, max_inline=inline, cell_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == brute(q, c, 4)


def test_topk_with_a_hot_copy_and_ties(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "item_id long, embedding array<double>").repartition(7)
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.item_id for r in rt.topk_similar(queries, corpus, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert rt.topk_similar(queries, corpus, 3, min_score=1.1).count() == 0
    assert rt.topk_similar(queries.where("false"), corpus).count() == 0


@pytest.mark.parametrize("inline", [100, 1])
def test_unusable_vectors_take_no_part(spark, inline):
    nan = float("nan")
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0]), (6, []), (7, [0.5, 0.5]), (8, [2.0, 0.0, 0.0])],
        "item_id long, embedding array<double>",
    )
    queries = spark.createDataFrame(
        [("a", [3.0, 0.0]), ("b", None), ("c", [0.0, 1.0, 0.0]), ("d", [None, 1.0]), ("e", [5.0]), ("f", [1.0] * 9)], "query_id string, embedding array<double>"
    )
    got = {(r.query_id, r.rank, r.item_id) for r in rt.topk_similar(queries, corpus, 3, max_inline=inline).collect()}
    assert got == {("a", 1, 1), ("a", 2, 7), ("c", 1, 8), ("e", 1, 5)}


def test_keyword_search_by_postings(spark, values):
    rng = random.Random(2)
    words = ["Disk", "node", "E1", "replica", "a_b", "e", "xdis", "nod e12"]
    docs = [(i, " ".join(rng.choice(["xdiskx", "NODE", "none", "e12", "é a_B", "zz"]) for _ in range(3))) for i in range(60)]
    queries = [(f"q{i}", f"{w} 怎么?") for i, w in enumerate(words)] + [("both", "disk node"), ("blank", "？")]
    d = spark.createDataFrame([*docs, (99, None), (100, "")], "doc_id long, text string")
    q = spark.createDataFrame([*queries, ("null", None)], "query_id string, text string")
    import re

    want = sorted(
        (k, i) for k, t in queries for i, x in docs if any(w.lower() in x.lower() for w in re.findall("[a-zA-Z0-9_]+", t))
    )
    assert sorted(values(ki.keyword_search(q, d))) == want
    stored = ki.gram_postings(d).persist()
    assert sorted(values(ki.keyword_search(q, d, postings=stored, part_rows=7))) == want
    assert ki.keyword_search(q.where("false"), d).count() == 0 and ki.keyword_search(q, d.where("false")).count() == 0


def test_keyword_search_looks_at_each_word_of_the_texts_once(spark, values):
    """However many texts hold a word, it has one set of runs; keys come twice or are null."""
    d = spark.createDataFrame([(i % 200, "Disk-full disk ſ \u212aelvin") for i in range(400)] + [(None, "node"), (7, "xNODEs")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "node"), (2, "KELVIN 磁"), (None, "full")], "query_id int, text string")
    want = sorted([(1, 7), *[(2, i) for i in range(200)], *[(None, i) for i in range(200)]], key=repr)
    assert values(ki.keyword_search(q, d)) == want
    assert values(ki.keyword_search(q, d, postings=ki.gram_postings(d))) == want
    written = []
    before, ki.written_once = ki.written_once, lambda df, purpose: written.append((purpose, df)) or before(df, purpose)
    try:
        ki.keyword_search(q, d)
    finally:
        ki.written_once = before
    assert dict(written)["postings"].count() < 20  # and not some for each of 400 texts


def test_diverse_answers_equal_a_plain_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(q, i, [float(x) for x in rng.normal(size=5)]) for q in range(3) for i in range(12)]
    rows += [(0, 50 + i, rows[2][2]) for i in range(3)] + [(4, 1, [0.0] * 5), (4, 2, [1.0] * 5)]
    asked = {q: rng.normal(size=5) for q in range(5)}

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    scored = [(q, i, cos(asked[q], v), v) for q, i, v in rows]
    found = rt.diverse(spark.createDataFrame(scored, "query_id int, item_id long, score double, embedding array<double>"), 4, 0.3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    want = {}
    for q in {r[0] for r in rows}:
        left, chosen = {i: (s, v) for p, i, s, v in scored if p == q}, []
        while left and len(chosen) < 4:
            best = min(left, key=lambda i: (-round(0.3 * left[i][0] - 0.7 * max(cos(left[i][1], v) for _, v in chosen), 12) if chosen else -left[i][0], i))
            chosen.append((best, left.pop(best)[1]))
        want[q] = [i for i, _ in chosen]
    assert got == want


def test_retrieval_falls_back_to_words_then_to_nothing(spark):
    queries = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "disk", [0.0, 1.0]), (3, "zzz", [0.0, 1.0])], "query_id int, text string, embedding array<double>")
    corpus = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.0])], "item_id long, embedding array<double>")
    docs = spark.createDataFrame([(7, "a disk", "s7"), (8, "b", "s8")], "doc_id long, text string, source string")
    found = retrieve(queries, corpus, docs, k=2, min_score=0.5)
    got = sorted((r.query_id, r.source, r.rank or 0, r.item_id or 0) for r in found.collect())
    assert got == [(1, "vector", 1, 8), (1, "vector", 2, 7), (2, "keyword", 0, 7), (3, "none", 0, 0)]
    assert [tuple(r) for r in contexts(found, docs).collect()] == [
        (1, "[参考资料1]:参考资料:b | 参考源数据：s8\n[参考资料2]:参考资料:a disk | 参考源数据：s7\n")
    ]
