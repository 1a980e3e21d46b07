import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from logloom.llm import packing


def test_pieces_and_sequences(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    whole = [(i, model.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    want = [
        (i, at, len(ids[at : at + 1024]), zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes()), len(ids))
        for i, ids in whole for at in range(0, len(ids), 1024)
    ]
    got = packing.pack(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * sum(len(ids) for _, ids in whole) / 1024 + 1
    assert packing.pack(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_plan_uses_every_piece_once_and_wastes_little():
    random = np.random.default_rng(0)
    for count in (1, 7, 400, 30_000):
        drawn = np.clip(random.lognormal(5.3, 1, count).astype(int), 1, 1024)
        lengths, demand = np.unique(-(-drawn // packing.GRAIN), return_counts=True)
        patterns = packing.plan(lengths, demand, 1024 // packing.GRAIN)
        used = defaultdict(int)
        for pattern, times in patterns:
            assert sum(n * k for n, k in pattern.items()) * packing.GRAIN <= 1024
            for n, k in pattern.items():
                used[n] += k * times
        assert used == dict(zip(lengths.tolist(), demand.tolist()))
        total = sum(times for _, times in patterns)
        assert total <= 1.02 * drawn.sum() / 1024 + 1


def test_columns_reach_the_bound_of_a_known_program():
    # Three thirds, or one half and one half: 40 pieces of 341 and 20 of 512 need 13.33 and 10 sequences.
    found, _ = packing.column_generation(np.array([341, 512]), np.array([40.0, 20.0]), 1024)
    assert abs(sum(x for _, x in found) - (40 / 3 + 10)) < 1e-6
    best, take = packing.knapsack(np.array([0.4, 0.5]), np.array([341, 512]), 1024)
    assert best[1024] == 0.4 * 3 and packing.filling(take, {341, 512}, 1024) == {341: 3}


def test_generated_columns_beat_the_start_and_make_the_plan():
    random = np.random.default_rng(7)
    for count in (300, 20_000):
        drawn = -(-np.clip(random.lognormal(5.3, 1, count).astype(int), 1, 1024) // 8)
        lengths, demand = np.unique(drawn, return_counts=True)
        found, program = packing.column_generation(lengths, demand.astype(float), 128)
        value, start = sum(x for _, x in found), (demand / (128 // lengths)).sum()
        assert program.generated > 20 and value < 0.95 * start
        # The duals prove the optimum: no pattern is worth more than 1, and they reach the value.
        assert program.duals.min() > -1e-8 and packing.knapsack(np.maximum(program.duals, 0), lengths, 128)[0][128] <= 1 + 1e-8
        assert abs(program.duals @ demand - value) < 1e-3 * value
        mixed = [p for p, times in packing.plan(lengths, demand, 128) if len(p) > 1]
        assert len(mixed) > 10


def test_other_capacities(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for capacity in (50, 256):
        got = packing.pack(docs, path, public_tokenizers.PATTERN, capacity).collect()
        room = defaultdict(int)
        for r in got:
            room[r["sequence_id"]] += r["length"]
        assert max(room.values()) <= capacity and sum(room.values()) == sum({(r["doc_id"], r["start"], r["ids_crc32"], i): r["length"] for i, r in enumerate(got)}.values())
