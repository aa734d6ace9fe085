import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paddock.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " a", "a ", "a\n b", "a \nb", "it's 'll we 've", "x y z", "a\x1c b", "<|endoftext|> a", "a <|endoftext|>", "é 漢字 🙂 ok", "12 345,6 7-8", "\0 a\0b", "a\t\t b c", "\n", " ", "", "a b  c d"]


def test_ids_are_those_of_the_tokenizer(sentence):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n'abé1,.") for _ in range(60)) for _ in range(300)] + [sentence(rng, 200)]
    whole = Tokenizer.from_file(PATH)
    tokens = packing.Tokens(PATH)
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in tokens.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, got, capacity=1024):
    whole = Tokenizer.from_file(PATH)
    left = sorted(([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows), key=len)
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    total = {}
    for r in rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        mine = [p for p in pieces[(r[0], len(ids))]]
        copies = len(mine) // -(-len(ids) // capacity)
        spans = sorted((p.start, p.length) for p in mine)
        assert sum(n for _, n in spans) == copies * len(ids)
        for p in mine:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
    for r in got:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in total.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in got) == sum(map(len, left))
    return len(total), sum(map(len, left))


def test_pieces_hold_every_id_once(spark, documents, sentence, edges):
    rng = random.Random(2)
    rows = [(i, sentence(rng, int(rng.expovariate(1 / 900)) + 1), "en", "s", 0) for i in range(150)] + edges
    got = packing.pack(spark, documents(rows), PATH).collect()
    sequences, tokens = check(rows, got)
    assert sequences * 1024 < 1.03 * tokens


def test_one_length_for_many(spark, documents):
    rows = [(i, "same words again", "en", "s", 0) for i in range(500)]
    sequences, tokens = check(rows, packing.pack(spark, documents(rows), PATH).collect())
    assert sequences <= -(-tokens // 1024) + 1 + tokens // 200


def test_short_texts_leave_no_padding(spark, documents, sentence):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "same", "same words again"]), "en", "s", 0) for i in range(3000)]
    rows += [(3000 + i, sentence(rng, rng.randint(100, 400)), "en", "s", 0) for i in range(60)]
    sequences, tokens = check(rows, packing.pack(spark, documents(rows), PATH).collect())
    assert sequences <= -(-tokens // 1024) + 1


@pytest.mark.parametrize("kind", ["short", "mixed", "long", "one"])
def test_plan_wastes_little(kind):
    rng = np.random.default_rng(4)
    lengths = {"short": rng.integers(1, 10, 50000), "one": np.full(50000, 4), "long": rng.lognormal(5.7, 0.6, 50000).astype(int) % 1023 + 1}
    lengths["mixed"] = np.append(lengths["long"], lengths["short"][:25000])
    demand = {int(s): int(n) for s, n in zip(*np.unique(lengths[kind], return_counts=True))}
    plan, used = packing.plan(demand, 1024), {}
    for times, taken in plan:
        assert times > 0 and sum(s * n for s, n in taken.items()) <= 1024
        for s, n in taken.items():
            used[s] = used.get(s, 0) + times * n
    assert used == demand
    assert sum(times for times, _ in plan) <= 1.005 * lengths[kind].sum() / 1024 + 1


def test_empty_table(spark, documents):
    assert packing.pack(spark, documents([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(1, 129), 60, replace=False)
    demand = {int(s): int(rng.integers(1, 3000)) for s in sizes}
    plan, used = packing.plan(demand, 128), {}
    for times, taken in plan:
        assert sum(s * n for s, n in taken.items()) <= 128
        for s, n in taken.items():
            used[s] = used.get(s, 0) + times * n
    assert used == demand
    # the relaxed optimum is no larger than any packing; rounding costs about one sequence for each size
    bound = sum(x for _, x in packing.solve(np.array(sorted(demand)), np.array([demand[s] for s in sorted(demand)]), 128))
    assert bound - 1e-6 <= sum(t for t, _ in plan) <= bound + len(demand)
    assert bound >= sum(s * n for s, n in demand.items()) / 128 - 1e-6


def test_places_follow_the_plan():
    table = packing.places([(2, {5: 3, 1: 1}), (1, {5: 2})])
    assert table.to_dict("list") == {"size": [5, 1, 5], "first_rank": [0, 0, 6], "end_rank": [6, 2, 8], "count": [3, 1, 2], "first_sequence": [0, 0, 2]}


def test_a_task_holds_little_at_a_time(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400_000)]
    texts = [" ".join(words[a : a + 2000]) for a in range(0, len(words), 2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    built = []

    class Watched(packing.Tokens):
        def __init__(self, path):
            super().__init__(path)
            built.append(self)
            tracemalloc.start()

    monkeypatch.setattr(packing, "Tokens", Watched)
    try:
        got = sum(b.num_rows for b in packing._cut(PATH, 1024)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got > len(texts)
    assert "tokenizer" not in vars(built[0])  # no text needed the whole tokenizer
    assert peak < 40 << 20


def test_places_come_without_python_workers(spark, documents, monkeypatch):
    made = []
    create = type(spark).createDataFrame

    def watched(self, data, *args, **options):
        made.append(type(data))
        return create(self, data, *args, **options)

    rows = documents([(1, "a b c", "en", "s", 0), (2, None, "en", "s", 0)])
    monkeypatch.setattr(type(spark), "createDataFrame", watched)
    assert packing.pack(spark, rows, PATH).count() == 2
    assert made == [pa.Table]
