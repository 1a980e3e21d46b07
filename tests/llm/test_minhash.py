from itertools import combinations

import numpy as np
import pytest

from llm.conftest import words
from logloom.llm.graph import components
from logloom.llm.minhash import near_duplicates, signature


def sets_of(rows, n):
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, text in rows:
        w = words((text or "").translate(small))
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        out.setdefault(i, []).append(runs)
    return out


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_against_brute_force(docs, rows, group, n, percent):
    named = [(i, t) for i, t in rows if i is not None]
    sets = {i: s[0] for i, s in sets_of(named, n).items()}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    assert links
    whole = group(sets, links)
    got = near_duplicates(docs, n=n, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), whole[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_members_that_miss_the_first_star(spark, group):
    """Links among texts that are too far from their bucket's smallest id."""
    random = np.random.default_rng(3)
    base = [f"v{i}" for i in range(400)]

    def changed(text, share):
        text = list(text)
        for at in random.choice(len(text), int(share * len(text)), replace=False):
            text[at] = f"n{random.integers(1 << 40)}"
        return text

    far = changed(base, 0.09)
    texts = [base, far, changed(far, 0.02), changed(far, 0.02), changed(base, 0.01)] + [changed(base, 0.06) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: s[0] for i, s in sets_of(rows, 3).items()}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == group(sets, links)


def test_no_rows(nothing):
    assert near_duplicates(nothing).count() == 0


def test_signatures_estimate_similarity():
    random = np.random.default_rng(1)
    a = random.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:800], random.integers(0, 2**63, 200, dtype=np.uint64)])
    assert abs((signature(a, 192) == signature(b, 192)).mean() - 800 / 1200) < 0.15


def test_components_of_chains(spark, group):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 3), (7, 7)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == group(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id_take_the_id_they_reach(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text + " more"), (None, text), (None, "quite another text " * 3), (None, "quite another text " * 3)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == [(3, 0, True), (3, 0, True), (56, 7, False), (56, 7, True), (57, 7, False)]
