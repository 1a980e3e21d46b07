import hashlib
import re

from logloom.llm import queries, secrets
from logloom.session import scratch_dir

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


ODD = [
    (6001, "token: password: hunter22 token:token:abcdef"), (6002, "SECRET='aB+/_.=-' passwd=short"), (6003, "AKIAAKIA AKIA" + "Z" * 16),
    (6004, "deadbeef" * 3 + "xyz" + "deadbeef" * 2), (6005, "tokſen=abcdefgh api-key=abcdefgh apiKEY:abcdefgh"),
    (6006, "é€😀 ghp_" + "a1B2" * 10 + " password=é"), (6007, None), (6008, ""),
]


def test_against_brute_force(spark, docs, rows, tmp_path, monkeypatch):
    table = docs.select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    monkeypatch.setattr(queries, "_table", lambda *a: table)
    got = queries.op4_secret_ledger(spark, "").collect()
    all_rows = rows + ODD
    assert len(got) == len(all_rows)
    want = []
    for i, text in all_rows:
        spans = base_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((i, *[sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(line.encode()).hexdigest()))
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want, key=repr)
    assert "hub_token" in next(r["spans"] for r in got if r["doc_id"] == 6006)


def test_ledger_scans_only_what_is_new(spark, nothing):
    ledger = scratch_dir(spark, "ledger")
    first = spark.createDataFrame([("a", 1, "password=abcdef"), ("b", 1, "password=abcdef"), ("c", 1, "clean")], "path string, version int, text string")
    one = secrets.scan(first, ledger, secrets.BASE_RULES, ("path", "version"))
    assert {(r["path"], len(r["findings"])) for r in one.collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert secrets.read_ledger(spark, ledger).count() == 2
    second = first.union(spark.createDataFrame([("a", 2, "token: zyxwvu"), ("d", 1, "clean")], first.schema))
    two = secrets.scan(second, ledger, secrets.BASE_RULES, ("path", "version"))
    assert {(r["path"], r["version"], len(r["findings"])) for r in two.collect()} == {
        ("a", 1, 1), ("b", 1, 1), ("c", 1, 0), ("a", 2, 1), ("d", 1, 0)}
    assert secrets.read_ledger(spark, ledger).count() == 3
    # A new rule is scanned alone over all blobs.
    secrets.scan(second, ledger, secrets.BASE_RULES + (secrets.Rule("clean", 1, "clean"),), ("path", "version")).collect()
    added = secrets.read_ledger(spark, ledger).where("array_contains(rules, 'clean/1')")
    assert added.count() == 3 and added.where("size(rules) = 1").count() == 3
    assert secrets.scan(nothing, scratch_dir(spark, "ledger")).count() == 0


def test_mask_joins_overlaps():
    assert secrets.mask("0123456789", [(2, 5), (4, 7), (8, 9)], "#") == "01#7#9"


def test_findings_are_those_of_the_current_rule_versions(spark):
    ledger = scratch_dir(spark, "ledger")
    texts = spark.createDataFrame([(1, "k1 k22 k1 o"), (2, "k22"), (3, "k1 k22 k1 o")], "doc_id long, text string")
    old = (secrets.Rule("k", 1, r"k\d+"), secrets.Rule("o", 1, "o"))
    new = (secrets.Rule("o", 1, "o"), secrets.Rule("k", 2, r"k\d\d"))
    secrets.scan(texts, ledger, old).collect()
    for rules in (new, old, (secrets.Rule("k", 2, r"k\d\d"),)):
        after = sorted(map(str, secrets.scan(texts, ledger, rules).collect()))
        fresh = sorted(map(str, secrets.scan(texts, scratch_dir(spark, "ledger"), rules).collect()))
        assert after == fresh
    few = secrets.scan(texts.where("doc_id = 2"), ledger, old).collect()
    assert [[f["kind"] for f in r["findings"]] for r in few] == [["k"]]
