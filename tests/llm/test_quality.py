from collections import Counter

from llm.conftest import words
from logloom.llm.quality import repetition_coverage


def brute(text):
    text = text or ""
    w = words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed


def test_against_brute_force(docs, rows):
    got = repetition_coverage(docs).collect()
    key = lambda r: repr(r)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in got), key=key) == sorted(
        ((i, *brute(t)) for i, t in rows), key=key
    )
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_longer_runs_and_verdict(spark, nothing):
    clean = " ".join(f"word{i}" for i in range(200))
    lines = "\n".join(["the same line of some words here now"] * 3 + [f"other {i}" for i in range(30)])
    phrase = " ".join(f"p{i}" for i in range(12))
    table = spark.createDataFrame([(1, clean), (2, lines), (3, f"{phrase} x {phrase} " + " ".join(f"q{i}" for i in range(90)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition_coverage(table).collect()}
    assert got[1]["kept"] and got[3]["kept"] and not got[3]["base_failed"]
    size = len(phrase.replace(" ", ""))
    assert [got[3][f"dup_{n}gram_chars"] for n in (5, 8, 10)] == [2 * size] * 3
    assert got[2]["n_dup_lines"] == 2 and got[2]["dup_line_chars"] == 2 * len("the same line of some words here now")
    assert not repetition_coverage(table, gram_limits={10: 0.05}).where("doc_id = 3").first()["kept"]
    assert repetition_coverage(nothing).count() == 0
