import re
import zlib
from collections import Counter

import pytest

from logloom.llm.spelling import near_words, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, noise=31):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w, c in words.items():
        around = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        form = min(around, key=lambda x: (-words[x], x), default=None)
        out[w] = (form if form and words[form] >= 10 * c else None, c, len(around))
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return sorted(((w, f, root(w), c, k, words[f] if f else None) for w, (f, c, k) in out.items()), key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.fixture(scope="module")
def chained():
    long = "x" * 40_000
    return [
        (1, "internet " * 2), (2, "internets Internets " * 20 + "xinternets " * 450), (3, None), (4, ""), (None, "internet Émigrés émigrés emigres émigrés×"),
        (5, "aaaaaaa " * 5 + "aaaaaaaa " * 60 + "aaaaaaab baaaaaaa " * 3), (5, "aaaaaaa " * 5), (6, f"{long} {long} {long}y {long}y y{long}"),
        (7, "abcdefg gfedcba abcdefg gfedcba bacdefg bacdefg"), (8, "seven77letters sevenletters-sevenletters"), (9, " \n\t 12345678 "),
        (10, "tiebreaka tiebreakb " * 30 + "tiebreakz " * 2),
    ]


def test_forms_against_brute_force(spark, chained, values):
    rows = spark.createDataFrame([(i, t, "n", 1) for i, t in chained], "doc_id long, text string, word string, n int").repartition(3)
    got = values(spelling_variants(rows), *COLUMNS)
    assert got == brute(chained)
    roots = {r[0]: r[2] for r in got}
    assert roots["internet"] == "xinternets" and roots["tiebreakz"] == "tiebreaka"
    assert spelling_variants(rows.where("false")).count() == 0


@pytest.mark.parametrize("noise", [31, 2])
def test_documents_against_brute_force(spark, docs, rows, values, noise):
    want = brute(rows, noise)
    assert len(want) > 300 and sum(r[4] > 0 for r in want) > 10
    assert values(spelling_variants(docs, noise=noise), *COLUMNS) == want


def test_near_words_need_one_change(spark, values):
    words = ["listener", "listens", "listener", "silentre", "listenerz", "xlistener", "listenes", "listaner", "lisener", "ilstener", "éistener"]
    table = spark.createDataFrame([(w, 2) for w in set(words)], "word string, n long")
    want = sorted((a, b) for a in set(words) for b in set(words) if near(a, b))
    assert values(near_words(table)) == sorted(want, key=repr)
