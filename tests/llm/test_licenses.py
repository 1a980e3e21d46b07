import duckdb
import pandas as pd

from logloom.llm import licenses
from logloom.llm.licenses import TEMPLATES, cover_words, license_scan, license_sql, template_shingles


def test_against_sql(spark, docs, nothing):
    filler = " ".join(f"filler{i}" for i in range(500))
    texts = [(7000 + i, f"{filler} {text} {filler}") for i, text in enumerate(TEMPLATES.values())]
    texts += [(7100 + i, text.upper().replace(",", " ;")) for i, text in enumerate(TEMPLATES.values())]
    half = TEMPLATES["mit-text"].split()
    texts += [(7200, " ".join(half[: len(half) // 2])), (7201, " ".join(half[:85])), (7202, "mit license released"), (7203, None), (7204, "")]
    table = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(
        spark.createDataFrame(texts, "doc_id long, text string"))
    documents = table.toPandas()
    db = duckdb.connect()
    db.register("documents", documents)
    cols = ["doc_id", "license_id", "n_shingles", "n_found", "containment"]
    want = sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({license_sql()})").fetchall())
    got = license_scan(table)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want
    names = {(i, name) for i, name, *_ in want}
    assert all((7000 + i, name) in names and (7100 + i, name) in names for i, name in enumerate(TEMPLATES))
    assert not any(i == 7200 for i, _ in names) and (1016, "mit-notice") in names
    assert license_scan(nothing).count() == 0
    assert license_scan(table.union(table)).count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_cover_words_are_lossless():
    for shingles in template_shingles(TEMPLATES).values():
        words = cover_words(shingles, 0.8)
        without = [s for s in shingles if words.isdisjoint(s.split())]
        assert len(without) < 0.8 * len(shingles)


def test_templates_of_any_length(spark):
    """A text of 1300 words, whole, with changes, in part, and beside a short notice; a table too large to copy."""
    import random

    rng = random.Random(1)
    words = [f"term{rng.randrange(4000)}" for _ in range(1300)]
    changed = [w if i % 40 else "other" for i, w in enumerate(words)]
    filler = [f"fill{i % 97}" for i in range(3000)]
    texts = [
        (1, " ".join(filler + words + filler)), (2, " ".join(filler[:700] + changed)), (3, " ".join(words[:600] + filler)),
        (4, " ".join(filler) + " Released under the MIT License."), (5, None), (6, ""),
    ]
    templates = {"whole-text": " ".join(words), "mit-notice": licenses.TEMPLATES["mit-notice"]}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    want = sorted(db.execute(licenses.license_sql(templates)).fetchall())
    assert [r[:2] for r in want] == [(1, "whole-text"), (2, "whole-text"), (4, "mit-notice")]
    for most in (licenses.COPIED, 0):
        licenses.COPIED, before = most, licenses.COPIED
        got = sorted(tuple(r) for r in licenses.license_scan(docs, templates).collect())
        licenses.COPIED = before
        assert got == want
