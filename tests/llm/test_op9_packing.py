import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pipewright.llm import packing, token_file
from pipewright.llm.common import lean

from .helpers import WORDS, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in bins if c >= n), default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[bins.index(fit)] = fit - n
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100, 4096])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.3 else rng.randrange(1, max(2, capacity // 8)) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for length, _, count, first, each, offset in packing.best_fit_decreasing(histogram, capacity):
        for k in range(count):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == brute(lengths, capacity)
    ranks = {}
    for length, first, count, *_ in packing.best_fit_decreasing(histogram, capacity):
        ranks.setdefault(length, []).append((first, count))
    assert all(sum(c for _, c in v) == histogram[k] and [f for f, _ in v] == [sum(c for _, c in v[:i]) for i in range(len(v))] for k, v in ranks.items())


def test_capacity_tree():
    rng = random.Random(1)
    tree, have = packing.CapacityTree(100), set()
    for _ in range(2000):
        c = rng.randrange(101)
        on = rng.random() < 0.5
        tree.set(c, on)
        (have.add if on else have.discard)(c)
        least = rng.randrange(101)
        assert tree.tightest(least) == min((x for x in have if x >= least), default=None)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 20)  # so that a length is ranked in several groups
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 40, 70, 400]))), "x") for k in range(300)] + [(900, None, "x"), (901, "", "x"), (None, "no id", "x"), (5, "twice", "x"), (5, "twice", "x")]
    got = packing.pack_documents(table(spark, rows, "doc_id long, text string, sequence_id string"), PATH, 1, 64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 64)):
            piece = ids[start : start + 64]
            want.append((doc_id, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) == len(brute([w[3] for w in want], 64))
    assert packing.pack_documents(table(spark, [], "doc_id long, text string"), PATH).collect() == []


def test_packing_deals_its_groups_without_python_workers(spark):
    plan = packing.pack_documents(table(spark, [(1, "some words"), (2, "more")], "doc_id long, text string").coalesce(1), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_tasks_of_other_kinds_find_no_tokenizer_in_their_worker(spark):
    docs = table(spark, [(k, "some words") for k in range(40)], "doc_id long, text string").repartition(8)
    kept = "kept int"

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_file.word_encoder.cache_info().currsize] * batch.num_rows, pa.int32())], names=["kept"])

    def packed():
        packing.pieces(docs, PATH, 1, 64).collect()

    packed()
    assert 1 in {r.kept for r in docs.mapInArrow(count, kept).collect()}  # workers live on
    assert {r.kept for r in docs.mapInArrow(lean(count), kept).collect()} == {0}
    packed()
    assert 1 in {r.kept for r in docs.mapInArrow(lean(count, token_file.word_encoder), kept).collect()}
