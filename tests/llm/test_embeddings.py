import math

import numpy as np

from logloom.llm.embeddings import near_vectors, range_search, robust_graph, medoid

SCHEMA = "n int, vec_id long, embedding array<float>, label int, pivot int, block int"


def test_against_brute_force(spark, small, group):
    real = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").limit(250).collect()]
    random = np.random.default_rng(2)
    unit = random.normal(size=64)
    near = [(2000 + i, [float(x) for x in np.float32(unit + random.normal(size=64) * s)], 1) for i, s in enumerate(np.linspace(0.02, 0.25, 150))]
    rows = real + near + [
        (3000, near[0][1], 1), (3001, near[0][1], 1), (3002, near[0][1], 2), (3003, [2 * x for x in near[0][1]], 1), (3004, None, 1),
        (3005, [0.0] * 64, 1), (3006, [math.nan] + near[0][1][1:], 1), (3007, near[0][1], None), (3008, [None] + near[0][1][1:], 1),
        (3009, near[0][1][:32], 1), (3010, [math.inf] + near[0][1][1:], 1), (3011, [], 1), (3012, [-x for x in near[0][1]], 1),
    ]
    usable = {
        i: (label, np.array(v, float) / np.linalg.norm(v)) for i, v, label in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }
    links = [
        (a, b) for a in usable for b in usable
        if a < b and usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= 0.98
    ]
    assert len(links) > 500
    whole = group([r[0] for r in rows], links)
    table = spark.createDataFrame([(0, i, v, label, 1, 1) for i, v, label in rows], SCHEMA)
    got = {r["vec_id"]: r for r in near_vectors(table).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["n_links"] == sum(i in x for x in links)
        assert got[i]["component_id"] == whole[i] and got[i]["kept"] == (whole[i] == i)
    assert near_vectors(table.where("false")).count() == 0


def test_graph_search_reaches_everything():
    random = np.random.default_rng(4)
    unit = random.normal(size=(400, 16))
    unit[200:] = unit[:200] + 0.01 * random.normal(size=(200, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lists = robust_graph(unit)
    start = medoid(unit)
    missed = sum(len(np.setdiff1d(np.flatnonzero(unit @ q >= 0.98), range_search(q, unit, lists, start, 32, 0.98))) for q in unit)
    assert missed <= 8


def test_several_shards_and_graphs_lose_no_link(spark, group, monkeypatch):
    """Few dimensions: links reach over every border between pivots."""
    from logloom.llm import embeddings

    for name, value in (("SHARD", 250), ("GRAPH", 150), ("PART", 400)):
        monkeypatch.setattr(embeddings, name, value)
    random = np.random.default_rng(9)
    rows = [(i, [float(x) for x in random.normal(size=4)], "ab"[i % 2]) for i in range(2400)]
    table = spark.createDataFrame([(0, i, v, label, 1, 1) for i, v, label in rows], SCHEMA.replace("label int", "label string"))
    unit = np.array([v for _, v, _ in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (same[:, None] == same) & ~np.eye(len(rows), dtype=bool)
    assert near.sum() > 4_000
    whole = group(range(len(rows)), zip(*np.nonzero(near)))
    found = near_vectors(table).persist()
    got = {r["vec_id"]: r for r in found.collect()}
    wrong = [i for i in range(len(rows)) if got[i]["n_links"] != near[i].sum() or got[i]["component_id"] != whole[i]]
    assert not wrong
    checked = embeddings.audit(table, found).first()
    assert checked["links"] == near[::20].sum() and checked["recall"] == 1.0


def test_labels_beyond_an_integer(spark):
    rows = [(1, [1.0, 0.0], 2**40), (2, [1.0, 0.001], 2**40), (3, [1.0, 0.0], 2**40 + 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_copies_in_shards_go_in_waves(spark, group, monkeypatch):
    """Many dimensions: most borders are near, and every vector asks in most shards."""
    import os
    from urllib.parse import urlparse

    from logloom.llm import embeddings

    for name, value in (("SHARD", 80), ("GRAPH", 60), ("PART", 100), ("TURN", 300), ("WAVE_LEAST", 0)):
        monkeypatch.setattr(embeddings, name, value)
    random = np.random.default_rng(12)
    vectors = random.normal(size=(1500, 24))
    vectors[1000:] = vectors[random.integers(0, 100, 500)] + random.normal(size=(500, 24)) * np.linspace(0.02, 0.2, 500)[:, None]
    vectors = vectors.astype(np.float32)
    rows = [(0, i, [float(x) for x in v], 1, 1, 1) for i, v in enumerate(vectors)]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(unit), dtype=bool)
    assert near.sum() > 2_000
    whole = group(range(len(unit)), zip(*np.nonzero(near)))
    written, before = [], embeddings.written_once

    def spy(df, purpose):
        out = before(df, purpose)
        written.append((purpose, sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(embeddings, "written_once", spy)
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [i for i in range(len(unit)) if got[i]["n_links"] != near[i].sum() or got[i]["component_id"] != whole[i]]
    # The tables hold the vectors once (in floats, and ids and hashes), not once for each shard.
    assert sum(size for _, size in written) < 3 * vectors.nbytes
    assert sum(purpose == "links" for purpose, _ in written) > 3


def test_sketches_lead_to_every_hit():
    """Hits that no list leads to are found, and who has none is not searched for."""
    import pyarrow as pa

    from logloom.llm import embeddings

    random = np.random.default_rng(6)
    raw = random.normal(size=(600, 40))
    raw[300:] = raw[:300] + 0.03 * random.normal(size=(300, 40)) * np.linspace(0, 10, 300)[:, None]
    rows = pa.table({
        "rep": np.arange(600), "copies": np.ones(600, np.int64), "dimension": pa.array([40] * 600, pa.int32()),
        "embedding": pa.array(list(raw), pa.list_(pa.float64())),
    })
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    part = embeddings.Part(rows, embeddings.sketch_axes(unit), 100, 0.98)
    part.lists = [np.zeros(0, np.int64)] * 600
    near = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert (near > 0).sum() <= part.ask(rows.to_batches()[0]) < 600
    found = {r["rep"]: r["n"] for r in part.answer().to_pylist() if r["n"] is not None}
    assert found == {i: n for i, n in enumerate(near.tolist()) if n}
