import math

import numpy as np
import pyarrow as pa
import pytest

from pipewright.llm import pq_dedup

from .helpers import table, union_find

SCHEMA = "vec_id long, embedding array<float>, kept string"


def brute(rows, least=0.95):
    ok = [i for i, (vid, v, _) in enumerate(rows) if vid is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    find, union = union_find(len(rows))
    links = [0] * len(rows)
    for k, i in enumerate(ok):
        for j in ok[:k]:
            a, b = (np.array(rows[x][1], np.float32).astype(np.float64) for x in (i, j))
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                union(i, j)
    low = {}
    for i, (vid, _, _) in enumerate(rows):
        if vid is not None:
            low[find(i)] = min(low.get(find(i), vid), vid)
    return sorted(((vid, links[i], vid if vid is None else low[find(i)], vid is None or vid == low[find(i)]) for i, (vid, _, _) in enumerate(rows)), key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in (1, 1, 1, 2, 3, 40, 1, 5):
        center = rng.normal(size=16)
        for _ in range(size * 3):
            rows.append((1000 - n, (center + rng.normal(size=16) * rng.choice([0, 0.02, 0.08])).tolist(), "x"))
            n += 1
    rows += [(2000, None, "x"), (2001, [], "x"), (2002, [0.0] * 16, "x"), (2003, [None] + [1.0] * 15, None), (2004, [float("nan")] * 16, "x"), (2005, [float("inf")] + [1.0] * 15, "x"), (2006, [1.0, 2.0], "x"), (2007, [2.0, 4.0], "x"), (2008, [-0.0, 1.0], "x"), (2009, [0.0, 1.0], "x"), (None, [1.0] * 16, "x")]
    got = sorted((tuple(r) for r in pq_dedup.similar_vectors(table(spark, rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert pq_dedup.similar_vectors(table(spark, [], SCHEMA)).collect() == []


def test_bound_holds():
    """A code's distance less its miss never exceeds the true distance."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = pq_dedup.Quantiser(x, 12)
    near = q.cell(x)
    codes, missed = q.code(x, near)
    assert len(set(near.tolist())) > 4
    for which in set(near.tolist()):
        members = np.flatnonzero(near == which)
        d = np.sqrt(np.maximum(q.distances(x[:50], which, codes[members]), 0))
        true = np.linalg.norm(x[:50, None] - x[members], axis=2)
        assert (d - missed[members] <= true + 1e-6).all()


def test_walls():
    """Of two vectors within r, one is near the other's cell: all of them within the reach that loses nothing."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = pq_dedup.Quantiser(x, 20)
    near = q.cell(x)
    rows, lists = q.probes(x, near, 0.5 * math.sqrt(0.5))
    probed = {(r, c) for r, c in zip(rows, lists, strict=True)} | {(i, c) for i, c in enumerate(near)}
    assert (np.diff(rows) >= 0).all() and len(probed) == len(rows) + len(x)
    close = np.argwhere(np.linalg.norm(x[:, None] - x, axis=2) <= 0.5)
    assert all((i, near[j]) in probed or (j, near[i]) in probed for i, j in close)
    # The lists are those that the walls of all cells give.
    away = sum(q._walls(x[:, h], own, c)[:, cells] ** 2 for h, c, own, cells in zip(q.halves, q.coarse, (near // len(q.coarse[1]), near % len(q.coarse[1])), np.divmod(np.arange(len(q.coarse[0]) * len(q.coarse[1])), len(q.coarse[1])), strict=True))
    assert probed == {(r, c) for r, c in np.argwhere(away <= (0.5 * math.sqrt(0.5)) ** 2)}


def test_repeated_ids(spark):
    """An id has the links and the component of all its vectors, null ones and ones of other lengths among them."""
    v, w, u = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0], [1.0, 2.0]
    rows = [(5, None), (5, v), (6, v), (6, v), (7, w), (7, u), (8, [2.0, 4.0]), (9, [0.0, 1.0, 0.0, 0.05]), (5, u), (10, None), (10, [float("nan")] * 4), (11, [0.5, 0.5, 0.5, 0.5]), (11, [0.5, 0.5, 0.5, -0.5])]
    got = sorted(tuple(r) for r in pq_dedup.similar_vectors(table(spark, rows, "vec_id long, embedding array<float>")).collect())
    # 5 and 6 share v, 5, 7 and 8 share u; 7 and 9 are near with w.
    want = {5: (2, 5, True), 6: (1, 5, False), 7: (2, 5, False), 8: (2, 5, False), 9: (1, 7, False), 10: (0, 10, True), 11: (0, 11, True)}
    assert got == sorted((i, *want[i]) for i, _ in rows)


def planted(rng, n, width, rank):
    """Unit vectors of a rank, a fifth of them partners with cosines from 0.95 to 1."""
    base = rng.normal(size=(n, rank)) @ (np.eye(width) if rank == width else rng.normal(size=(rank, width)))
    base /= np.linalg.norm(base, axis=1)[:, None]
    m = n // 5
    other = base[rng.integers(0, n, m)] if rank < width else rng.normal(size=(m, width))
    other -= (other * base[:m]).sum(1)[:, None] * base[:m]
    other /= np.maximum(np.linalg.norm(other, axis=1), 1e-9)[:, None]
    c = rng.uniform(0.9501, 1, m)[:, None]
    base[n - m :] = c * base[:m] + np.sqrt(1 - c**2) * other
    return base.astype(np.float32)


@pytest.mark.parametrize(("n", "width", "rank"), [(50_000, 64, 64), (10_000, 64, 8), (4_000, 4, 4)])
def test_recall(spark, n, width, rank):
    """Links of the ids divisible by 50 against all rows by brute force."""
    x = planted(np.random.default_rng(width + rank), n, width, rank)
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(range(n)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {r.vec_id: r.n_links for r in pq_dedup.similar_vectors(frame).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    ask = np.arange(0, n, 50)
    want = (y[ask] @ y.T >= 0.95).sum(1) - 1
    assert len(got) == n and want.sum() > 100
    assert all(got[i] <= w for i, w in zip(ask.tolist(), want, strict=True))  # exact: none below the limit
    recall = sum(got[i] for i in ask.tolist()) / want.sum()
    print(f"recall of {want.sum()} links, {n} vectors of rank {rank}: {recall:.4f}")
    assert recall >= 0.99


def test_lists_of_many_blocks(spark, monkeypatch):
    """Vectors of few directions: lists far longer than a block, members and probes in several."""
    monkeypatch.setattr(pq_dedup, "BLOCK", 20)
    monkeypatch.setattr(pq_dedup, "LOT", 100)
    monkeypatch.setattr(pq_dedup, "LIST", 150)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(size=(60, 8)) * s for c, s in zip(centers, (0.01, 0.05, 0.1, 0.2, 0.3, 0.4), strict=True)])
    rows = [(1000 - k, v.tolist(), "x") for k, v in enumerate(x)]
    got = sorted((tuple(r) for r in pq_dedup.similar_vectors(table(spark, rows, SCHEMA), reach=math.sqrt(0.5)).collect()), key=str)
    assert got == brute(rows) and max(r[1] for r in got) > 50
