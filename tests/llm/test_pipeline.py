from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from llm.conftest import words
from llm.test_quality import brute
from llm.test_secrets import base_spans
from logloom.llm.secrets import RULES
from logloom.session import written_once


def test_stages_against_brute_force(spark, docs, rows, group):
    columns = pipeline.COLUMNS
    steps = {}
    table = docs
    for name, stage in pipeline.STAGES:
        table = written_once(stage(spark, table, ""), "test")
        steps[name] = table
        if name != "packing":
            assert table.columns == columns
    # None stands for the only row without an id that has words.
    texts = {i: t for i, t in rows if i is not None or t}

    kept = {r["doc_id"] for r in steps["quality rules"].collect()}
    assert kept <= {i for i, t in texts.items() if not brute(t)[-1]}
    assert len(kept) > 40 and None in kept

    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i in kept:
        w = words(texts[i].translate(small))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    far = 10**9
    sets = {far if i is None else i: s for i, s in sets.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    heads = {None if i == far else i for i, c in group(sets, links).items() if i == c}
    near = {r["doc_id"]: r["text"] for r in steps["MinHash near-dedup"].collect()}
    assert set(near) == heads and all(near[i] == texts[i] for i in near)

    seen, want = set(), {}
    for i in sorted(near, key=lambda i: far if i is None else i):
        b = near[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(b[k : k + 50] for k in range(len(b) - 49))
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left.strip(" "):
            want[i] = left
    got = {r["doc_id"]: r for r in steps["suffix-array dedup"].collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    masked = {r["doc_id"]: r["text"] for r in steps["secret scans"].collect()}
    assert set(masked) == set(want)
    for i, text in masked.items():
        assert not base_spans(text) and (text == want[i] or "[secret]" in text)
    assert len(RULES) > 3

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    tokens = {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    length = {}
    for r in steps["packing"].collect():
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == tokens[r["doc_id"]]
    assert length == tokens


def test_no_documents(spark, nothing):
    table = nothing
    for _, stage in pipeline.STAGES:
        table = written_once(stage(spark, table, ""), "test")
        assert table.count() == 0


def test_rows_that_share_an_id_stay_documents_of_their_own(spark):
    text = lambda n: " ".join(f"{n}w{i}" for i in range(80))
    rows = [(1, text("a")), (1, text("b") + " password=abcdef1"), (2, text("a")), (None, text("c")), (None, text("c")), (3, text("b") + " token: zzzzzz9"), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    table = written_once(pipeline.quality(spark, docs, ""), "test")
    assert table.count() == 7
    table = written_once(pipeline.near_dedup(spark, table, ""), "test")
    got = sorted((r["doc_id"] or 0, r["text"][:2]) for r in table.collect())
    assert got == [(0, "cw"), (1, "aw"), (1, "bw")]
    masked = pipeline.secret_masking(spark, written_once(pipeline.suffix_dedup(spark, table, ""), "test"), "")
    texts = {r["text"][:2]: r["text"] for r in masked.collect()}
    assert "[secret]" in texts["bw"] and "[secret]" not in texts["aw"] and masked.count() == 3
