import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from logloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_against_the_library(spark, docs, rows, nothing):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    odd = [(5001, "<|endoftext|> it's   \n\n x"), (5002, "\x00\x01￿ 日本語 ½"), (5003, " " * 5000 + "b" * 5000)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = []
    for i, text in rows + odd:
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.encode_decode(table, PATH, public_tokenizers.PATTERN, digests=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plain = {(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(table, PATH, public_tokenizers.PATTERN).collect()}
    assert plain == {(i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows + odd}
    assert bpe.encode_decode(nothing, PATH, public_tokenizers.PATTERN).count() == 0
