import hashlib
import re
from collections import Counter

from llm.conftest import words
from logloom.llm.substrings import remove_repeated_windows
from logloom.llm.suffixes import remove_earlier_strings


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_word_windows_against_brute_force(docs, rows, nothing):
    lists = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + 35]) for _, w in lists for k in range(len(w) - 34))
    want = []
    for i, w in lists:
        gone = bytearray(len(w))
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = b"\1" * 35
        want.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    got = remove_repeated_windows(docs, digests=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 1000
    texts = {sha(r["kept_text"].encode()) for r in remove_repeated_windows(docs).collect()}
    assert texts == {x[3] for x in want}
    assert remove_repeated_windows(nothing, digests=True).count() == 0


def test_byte_strings_against_brute_force(docs, rows, nothing):
    far = 1 << 40
    order = [(far + hash(t) % 1000 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for rank, _, b in sorted(order):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], rank)
    want = []
    for rank, i, b in order:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    got = remove_earlier_strings(docs, digests=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 1000
    assert remove_earlier_strings(nothing, digests=True).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"x{i}" for i in range(40))
    rows = spark.createDataFrame([(1, long), (1, other), (2, long), (None, other + " y"), (None, "z " + long)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in remove_repeated_windows(rows).collect()))
    assert got == [(0, 41, 40), (0, 41, 40), (1, 40, 40), (1, 40, 40), (2, 40, 40)]
    alone = rows.where("doc_id = 1").union(rows.where("doc_id = 2"))
    assert sorted((r["doc_id"], r["n_removed"]) for r in remove_repeated_windows(alone).collect()) == [(1, 0), (1, 40), (2, 40)]
