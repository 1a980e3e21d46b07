import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import patterns as p
from logloom.operators import template_index as ti
from logloom.operators.classify import anchor_word, classify_lines, match_by_anchor, match_counters

TEMPLATES = [
    ("E1", "Adding an already existing block [*]"),
    ("E5", "Receiving block [*] src: [*] dest: [*]"),
    ("E26", "BLOCK* NameSystem.addStoredBlock: blockMap updated: [*] is added to [*] size [*]"),
    ("E30", "cost (a+b) [*] $1"),
    ("E31", "Receiving block [*]"),
]

LINES = [
    (1, "081109 1 INFO n: Receiving block blk_1 src: /a dest: /b"),
    (2, "BLOCK* NameSystem.addStoredBlock: blockMap updated: x is added to blk_-2 size 9"),
    (3, "Receiving block blk-123 from nowhere"),
    (4, "cost (a+b) 7 $1 blk_4"),
    (5, "request TimeOut blk9"),
    (6, "session opened"),
    (7, "Adding an already existing block "),
    (8, "disk failed"),
]


def lines(spark):
    return spark.createDataFrame(LINES, "line_no int, line string")


def python_match(text, mode="literal"):
    """The expected matches, by Python's own regular expressions."""
    out = []
    for event, template in TEMPLATES:
        if mode == "literal":
            pattern = re.escape(template).replace(r"\[\*\]", "(.*?)")
        else:
            pattern = template.replace("[*]", r"([^\s]+)")
        if re.search(pattern, text):
            out.append(event)
    return out


@pytest.mark.parametrize("mode", ["literal", "raw"])
def test_all_matches_follow_python(spark, mode):
    got = {r.line_no: r.m for r in lines(spark).select("line_no", p.all_matches(F.col("line"), TEMPLATES, mode).alias("m")).collect()}
    assert got == {n: python_match(t, mode) for n, t in LINES}


def test_one_line_may_match_two_templates_and_the_first_wins(spark):
    row = lines(spark).where("line_no = 1").select(
        p.all_matches(F.col("line"), TEMPLATES).alias("a"), p.first_match(F.col("line"), TEMPLATES).alias("f"),
        p.first_match(F.col("line"), TEMPLATES[::-1]).alias("r"),
    ).first()
    assert row.a == ["E5", "E31"] and row.f == "E5" and row.r == "E31"


def test_raw_mode_never_matches_a_starred_word(spark):
    got = lines(spark).where(p.matches(F.col("line"), TEMPLATES[2][1], "raw")).count()
    assert got == 0 and lines(spark).where(p.matches(F.col("line"), TEMPLATES[2][1])).count() == 1


def test_quoting_survives_an_end_marker(spark):
    template = r"path \E [*] end"
    df = spark.createDataFrame([(r"path \E x end",), ("path  x end",)], "line string")
    assert [r.line for r in df.where(p.matches(F.col("line"), template)).collect()] == [r"path \E x end"]


def test_no_templates(spark):
    row = lines(spark).select(p.first_match(F.col("line"), []).alias("f"), p.all_matches(F.col("line"), []).alias("a")).first()
    assert row.f is None and row.a == []


def test_unknown_mode():
    with pytest.raises(ValueError):
        p.template_regex("x", "fuzzy")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab[]*+.$ ", min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.text("ab[]*+.$ ", max_size=14), min_size=1, max_size=6))
def test_literal_patterns_equal_python_for_any_text(spark, templates, texts):
    named = [(f"E{i}", t) for i, t in enumerate(templates)]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = [r.m for r in df.select(p.all_matches(F.col("line"), named).alias("m")).collect()]
    want = [
        [e for e, t in named if re.search("(.*?)".join(re.escape(x) for x in t.split("[*]")), text)] for text in texts
    ]
    assert got == want


def test_classifier_with_and_without_error_words(spark, values):
    full = classify_lines(lines(spark), TEMPLATES)
    got = {r.line_no: (r.match_type, r.event_id, r.type, r.block_id) for r in full.collect()}
    assert got == {
        1: ("template", "E5", "normal", None),
        2: ("template", "E26", "normal", None),
        3: ("template", "E31", "normal", None),
        4: ("template", "E30", "normal", None),
        5: ("keyword_fallback", "E_UNKNOWN_ERR", "anomaly", "blk9"),
        6: ("unknown", None, "unknown", None),
        7: ("template", "E1", "anomaly", "unknown"),
        8: ("keyword_fallback", "E_UNKNOWN_ERR", "anomaly", "unknown"),
    }
    counts = match_counters(full).first().asDict()
    assert counts == {"total": 8, "template": 5, "keyword_fallback": 2, "anomaly": 3, "normal": 4, "unknown": 1, "matched": 7}
    bare = match_counters(classify_lines(lines(spark), TEMPLATES, keyword_fallback=False)).first()
    assert (bare.unknown, bare.keyword_fallback, bare.matched) == (3, 0, 5)


def test_match_by_anchor_equals_inline_matching(spark, values):
    templates = [*TEMPLATES, ("E40", "Receiving[*]"), ("E41", "cost [*]")]
    rows = [(e, t, anchor_word(t)) for e, t in templates]
    assert None in [a for *_, a in rows]
    assert dict((e, a) for e, _, a in rows)["E5"] == "block"
    table = spark.createDataFrame(rows, "event_id string, template string, anchor string")
    inline = lines(spark).select("line_no", F.explode(p.all_matches(F.col("line"), templates)).alias("event_id"))
    assert values(match_by_anchor(lines(spark), table, "line_no")) == values(inline)


def test_index_equals_inline_matching_over_many_templates(spark, values):
    """Words, runs of three, single characters, nothing at all; parts in order; lines that match several or none."""
    rng = random.Random(4)
    words = ["disk", "node", "block", "read", "a.b", "x", "é", "77", "[", "*", "blk_1", "\\E", "ok?"]
    made = lambda n, gap: gap.join(rng.choice(words) for _ in range(n))
    texts = [(i, made(rng.randrange(1, 9), rng.choice([" ", "", "-"]))) for i in range(400)] + [(900, ""), (901, None), (902, "aaa")]
    templates = [(f"E{i}", rng.choice(["", " "]).join(rng.choice([made(1, ""), "[*]", " " + made(1, "") + " "]) for _ in range(rng.randrange(1, 5)))) for i in range(300)]
    templates += [("E900", "[*]"), ("E901", ""), ("E902", "[*][*]"), ("E903", "aa[*]aa"), ("E904", "never seen word [*]")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "line_no long, line string, position int").repartition(3)
    table = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(templates)], "position long, event_id string, template string")
    inline = df.select("line_no", F.explode(p.all_matches(F.col("line"), templates)).alias("event_id"))
    want = values(inline)
    assert len(want) > 1000
    for copied in (10_000, 0):
        assert values(ti.indexed_matches(df, table, "line_no", copied=copied).select("line_no", "event_id")) == want
        first = df.select("line_no", p.first_match(F.col("line"), templates).alias("event_id")).where("event_id IS NOT NULL")
        assert values(ti.first_matches(df, table, "line_no", copied=copied)) == values(first)
    classes = ["line_no", "match_type", "event_id", "type", "block_id"]
    few = table.where("position < 20")
    assert values(classify_lines(df, few, key="line_no"), *classes) == values(classify_lines(df, templates[:20]), *classes)
    assert ti.indexed_matches(df, table.where("false"), "line_no").count() == 0
    assert ti.indexed_matches(df.where("false"), table, "line_no").count() == 0
    with pytest.raises(ValueError):
        classify_lines(df, table)


def test_index_takes_the_rarest_term(spark):
    rows = [(i, f"common rare{i} common word here") for i in range(50)]
    df = spark.createDataFrame(rows, "line_no long, line string")
    table = spark.createDataFrame([(1, "E1", "[*] rare7 common word [*]"), (2, "E2", "[*] gone common [*]")], "position long, event_id string, template string")
    index = ti.build_index(df, table).collect()
    assert [(r.position, r.term) for r in index] == [(1, "wrare7")]


def test_a_part_of_the_index_is_copied_and_rare_terms_alone_are_moved(spark, values):
    """Lines and templates of many users; any number of copied rows, lines that come twice or have no key."""
    users = range(60)
    rows = [(i, f"common word {i % 7} user_{i % 60} said {i % 11} times") for i in range(200)] + [(5, "common word user_5 said"), (None, "a user_7 said ")]
    df = spark.createDataFrame(rows, "line_no long, line string")
    templates = [(f"U{u}", f"[*] user_{u} said[*]") for u in users] + [("C", "common[*]word[*]said[*]1[*]times"), ("D", "common[*]a[*]i[*]d[*]t[*]m[*]s"), ("S", "times[*]common")]
    table = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(templates)], "position long, event_id string, template string")
    want = values(df.select("line_no", F.explode(p.all_matches(F.col("line"), templates)).alias("event_id")))
    for copied in (0, 3, 30, 1000):
        found = ti.indexed_matches(df, table, "line_no", copied=copied)
        assert values(found.select("line_no", "event_id")) == want
    index, counts = ti._ranked_index(df, table, "line", 3)
    known = df.select("line_no", F.col("line").alias("_line"))
    front, rest = ti._met(known, index, counts, "w", ["line_no"], 3)
    assert front.select("position").distinct().count() == 3
    # Of the terms of a line no frequent one without a template goes to the rest of the index.
    assert "BroadcastHashJoin" in rest._jdf.queryExecution().executedPlan().toString() and "LeftAnti" in rest._jdf.queryExecution().executedPlan().toString()


def test_counts_of_a_table_match_the_lines_once(spark, values):
    df = spark.createDataFrame([(1, "blk_1 a x "), (2, "blk_1 a y "), (3, "blk_2 none"), (4, "a x ")], "line_no long, line string")
    table = spark.createDataFrame([(1, "X", " a x[*]"), (2, "A", " a [*]")], "position long, event_id string, template string")
    out = ti.event_counts(df, table, "line_no")
    assert values(out, "block_id", "event_id", "cnt") == [("blk_1", "A", 2), ("blk_1", "X", 1), ("blk_2", None, 0)]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
