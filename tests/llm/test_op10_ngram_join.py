import random

import numpy as np
import pyarrow as pa
import pytest

from pipewright.llm import ngram_join as nj

from .helpers import LOWER, WORD, WORDS, table, union_find


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    find, union = union_find(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                union(i, j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else low[find(i)]) for i, r in enumerate(rows)), key=str)


def family(rng, n, size, edits):
    base = [rng.choice(WORDS) for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            i = rng.randrange(len(words))
            words[i : i + rng.randrange(2)] = [f"{rng.choice(WORDS)}{rng.randrange(30)}"]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "one", "One", "two words", "a b c d", "a b c d e", "A B C D E", "a b c d e f", "a b c d e f g", "x a b c d e f g"]
    for size in (6, 8, 9, 11, 13, 14, 17, 20, 28, 45, 90, 200, 330, 700):
        texts += family(rng, 9, size, max(1, size // 18)) + family(rng, 2, size, 0)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [f"{passage} {t}" for t in family(rng, 3, 30, 4) + family(rng, 3, 22, 4) + family(rng, 3, 120, 3)]
    rng.shuffle(texts)
    rows = [(rng.randrange(10**6) * 1000 + k, t, "x") for k, t in enumerate(texts)]
    rows += [(None, "no id here at all folks", "x"), (None, texts[0], "x"), rows[5], rows[5]]
    got = nj.similar_documents(table(spark, rows, "doc_id long, text string, component_id string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert nj.similar_documents(table(spark, [], "doc_id long, text string")).collect() == []


def _asked(x, y):
    """Whether two sets meet in a key for which one of them asks."""
    kx, ky = (dict.fromkeys(nj.keys_of(np.sort(s), 0, common)[0].tolist()) for s, common in ((x, None), (y, None)))
    by_name = {}
    for k in kx:
        by_name.setdefault(k >> 3, []).append((k & 7, 0))
    for k in ky:
        by_name.setdefault(k >> 3, []).append((k & 7, 1))
    return any({o for _, o in g} == {0, 1} and any(not b & nj.PASSIVE for b, _ in g) and any(not b & nj.DELETED for b, _ in g) for g in by_name.values())


def test_pigeonhole():
    """Every similar pair meets, at the very edge of similarity as well."""
    rng = np.random.default_rng(6)
    for _ in range(1500):
        size = int(rng.choice([4, 5, 6, 8, 9, 10, 12, 15, 19, 24, 33, 40, 41, 55, 90, 200, 256, 257, 400]))
        x = rng.integers(1, 2**63, size, dtype=np.uint64)
        other = size
        gone = int(rng.integers(0, nj.differences(size, other) + 1))
        more = int(rng.integers(0, gone + 1))
        y = np.concatenate([x[: size - gone], rng.integers(1, 2**63, more, dtype=np.uint64)])
        common = size - gone
        if len(y) and 100 * common >= 80 * (size + len(y) - common) and set(x.tolist()) != set(y.tolist()):
            assert _asked(x, y), (size, len(y), common)


def test_budget_covers_differences():
    """No set of any size is left without a budget, whatever shingles are thought common."""
    rng = np.random.default_rng(9)
    for size in [*range(4, 60), 100, 149, 187, 233, 256, 292, 300, 365, 500, 1200, 5000]:
        for _ in range(5):
            tokens = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
            assert not nj.keys_of(tokens, 0)[1]
            assert not nj.keys_of(tokens, 0, tokens[: size // 2])[1]


def test_allocation_prefers_rare_segments():
    take = nj._allocate(np.array([2, 2, 1, 0, 2]), np.array([0, 4, 1, 0, 3]), 4)
    assert take.tolist() == [0, 2, 0, 0, 2]
    assert nj._allocate(np.array([1, 1]), np.array([0, 0]), 5).tolist() == [1, 1]


def test_crowds_are_linked_before_the_shuffle():
    keys = np.array([8, 8, 10, 16, 16, 17, 24], np.uint64)
    docs = np.array([5, 3, 9, 1, 2, 4, 7])
    doc, center, shared, left, left_docs = nj._stars(keys, docs, 3)
    assert sorted(zip(doc.tolist(), center.tolist(), shared.tolist(), strict=True)) == [(2, 1, 1), (4, 1, 1), (5, 3, 1), (9, 3, 1)]
    assert sorted(zip(left.tolist(), left_docs.tolist(), strict=True)) == [(8, 3), (10, 9), (16, 1), (17, 4), (24, 7)]


def test_components_of_a_long_chain(spark):
    from pipewright.llm.components import components

    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1000), (2000, 1999), (1999, 2001)]
    got = {r.node: r.component for r in components(table(spark, edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 401)} | {2000: 1999, 2001: 1999}


def test_sets_are_whole_texts():
    text = " ".join(f"w{i}" for i in range(30_000))
    (row, tokens), (_, short) = nj.shingle_sets(pa.array([text, "a B"]))
    assert row == 0 and len(tokens) == 29_996 and len(short) == 1


def test_crowds_of_several_lots_meet(spark, monkeypatch):
    """Similar documents that share only a key which is a crowd's in each of their lots are linked, though the crowds' centers aren't."""
    monkeypatch.setattr(nj, "CROWD", 2)
    monkeypatch.setattr(nj, "keys_of", lambda tokens, seed, common=None: (np.array([8], np.uint64), False))
    rng = random.Random(5)
    near = family(rng, 4, 60, 1)
    rows = list(enumerate(t for n in range(4) for t in (*(family(rng, 1, 60, 0)[0] for _ in range(3)), near[n])))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    got = nj.similar_documents(docs).collect()
    assert len({r.component_id for r in got}) == 13
    assert sorted(map(tuple, got), key=str) == brute(rows)


def relatives(rng, n, size, edits, copies):
    """Texts that share a base, each with edits of its own, so that they aren't similar; of some there are near copies."""
    base = [rng.choice(WORDS) for _ in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for i in rng.sample(range(size), edits):
            words[i] = f"{k}x{i}"
        out.append(" ".join(words))
        if rng.random() < copies:
            words[rng.randrange(size)] = f"{k}y"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("edits", "copies", "left"), [(4, 0.2, 0), (3, 0.9, 0), (2, 0.3, 9), (1, 0.3, 0)])
def test_large_groups_meet_in_blocks(spark, monkeypatch, edits, copies, left):
    """Groups far larger than a block: those that may be similar are checked, whatever block they are dealt to."""
    monkeypatch.setattr(nj, "MEET", 8)
    met = []
    blocks = nj._blocks
    monkeypatch.setattr(nj, "_blocks", lambda rows: met.append(rows.count()) or blocks(rows))
    rng = random.Random(edits)
    texts = [t for size in (100, 60) for t in relatives(rng, 60, size, edits, copies)]
    rng.shuffle(texts)
    rows = [(k * 7, t) for k, t in enumerate(texts)]
    got = nj.similar_documents(table(spark, rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert edits == 1 or met and met[0] >= left


def test_screening_loses_no_link(spark):
    """Of documents of two components that are similar, both stay and one at least is light."""
    rng = np.random.default_rng(4)
    base, sets, pairs = rng.integers(1, 2**40, 60), [], []
    for k in range(40):
        own = np.unique(np.concatenate([base[rng.random(60) > 0.08], rng.integers(2**41, 2**42, rng.choice([0, 2, 6, 16]))]))
        sets.append(own)
    rows = [(k, k if k % 3 else k - k % 2) for k in range(40)]
    for (a, ca), (b, cb) in ((x, y) for x in rows for y in rows if x < y):
        common = len(np.intersect1d(sets[a], sets[b]))
        if ca != cb and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            pairs.append((a, b))
    group = table(spark, [(0, d, c) for d, c in rows], "of long, doc long, c long")
    light = {r.doc: r.light for r in nj._screened(group, table(spark, [(k, s.tolist()) for k, s in enumerate(sets)], "doc_id long, tokens array<long>")).collect()}
    assert pairs and all(a in light and b in light and (light[a] or light[b]) for a, b in pairs)
