"""Near-duplicate vectors by product quantisation (operator 1).

Vectors are dealt to inverted lists: each half of a vector has coarse centroids of its own, and a list
is a pair of these, so that few centroids make many lists. What is left of a vector is coded by the
nearest codeword in each of some subspaces, and the length of what the code misses is kept. A vector is
a member of one list and probes each other whose cell it comes near enough to: the distances of two
vectors within r of each other to the walls between their cells add up to r at most, so over both halves
one of them is within r / sqrt(2), and in high dimensions, where the difference seldom points at a wall,
much less will do (``SURE``).

First a probe goes out as bytes, one for each dimension, with the length of what rounding misses. In its
lists the squared distance to every code is the sum of one table entry for each subspace. That distance
less both misses is a lower bound, so no vector within reach is lost. Only what passes in some list goes
there whole, and what passes again gets the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, mix, settle
from .components import _forest, components

SIMILARITY = 0.95
SURE = 1.6  # half as many standard deviations of a difference's part along a wall's normal are probed
SAMPLE, MOST_COARSE = 65_536, 4096  # vectors that the quantisers are fitted on; coarse centroids of a half
LIST = 64  # vectors of a list, about
CODEWORDS, SUBSPACE = 256, 8
BLOCK = 2048  # members, and probes, that meet in one call
LOT = 20_000  # rows of small lists that one call takes


# ------------------------------------------------------------------ quantisers
def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(half - x[i : i + 4096] @ centroids.T, axis=1)
    return out


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of rows in random order; an empty one stays where it was."""
    centroids = x[:k].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        width = sample.shape[1]
        self.halves = np.array_split(np.arange(width), min(2, width))
        k = max(1, min(MOST_COARSE, math.ceil(lists ** (1 / len(self.halves))), len(sample)))
        self.coarse = [_k_means(np.ascontiguousarray(sample[:, h]), k) for h in self.halves]
        rest = sample - self.center(self.cell(sample))
        self.parts = np.array_split(np.arange(width), math.ceil(width / SUBSPACE))
        self.words = [_k_means(np.ascontiguousarray(rest[:, p]), min(CODEWORDS, len(rest))) for p in self.parts]

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        out = np.zeros(len(x), np.int64)
        for h, c in zip(self.halves, self.coarse, strict=True):
            out = out * len(c) + _nearest(x[:, h], c)
        return out

    def center(self, cells: np.ndarray) -> np.ndarray:
        """The centroid of each list."""
        out, rest = np.empty((len(cells), sum(map(len, self.halves)))), cells
        for h, c in zip(self.halves[::-1], self.coarse[::-1], strict=True):
            out[:, h], rest = c[rest % len(c)], rest // len(c)
        return out

    def code(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors in their lists, and how far each code misses its vector."""
        rest = x - self.center(cells)
        codes = np.stack([_nearest(rest[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        missed = sum(((rest[:, p] - w[codes[:, m]]) ** 2).sum(1) for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)))
        return codes, np.sqrt(missed)

    def _walls(self, x: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How far each vector is from the wall between its cell and each other cell of one half."""
        norm = (c**2).sum(1)
        between = np.sqrt(np.maximum(norm[:, None] + norm - 2 * c @ c.T, 0))[own]
        far = norm - 2 * x @ c.T
        away = far - np.take_along_axis(far, own[:, None], 1)
        return np.where(between > 0, np.maximum(away, 0) / np.where(between > 0, 2 * between, 1), 0)

    def probes(self, x: np.ndarray, cells: np.ndarray, wall: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the other lists whose cells lie within ``wall`` of a row, row by row."""
        row, place, away, rest, turn = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x)), cells, 1
        for h, c in zip(self.halves[::-1], self.coarse[::-1], strict=True):
            own, rest = rest % len(c), rest // len(c)
            near = self._walls(x[:, h], own, c) ** 2
            r, k = np.nonzero(near <= wall**2)
            # Each (row, cells so far) with each cell of this half that is near the row.
            first, n = np.searchsorted(r, np.arange(len(x) + 1)), np.bincount(r, minlength=len(x))
            times = n[row]
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[row], times)
            row, place, away = (np.repeat(v, times) for v in (row, place, away))
            away, place = away + near[row, k[at]], place + turn * k[at]
            keep = away <= wall**2
            row, place, away, turn = row[keep], place[keep], away[keep], turn * len(c)
        keep = place != cells[row]
        return row[keep], place[keep]

    def reach(self, sample: np.ndarray) -> float:
        """The share of r within which walls are probed, by the sample's effective dimensions."""
        spread = np.linalg.eigvalsh(np.cov(sample.T)) if len(sample) > 1 and sample.shape[1] > 1 else np.ones(1)
        return min(math.sqrt(0.5), SURE * math.sqrt((spread**2).sum()) / max(spread.sum(), 1e-12))

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of a list, by table look-up."""
        rest = queries - self.center(np.array([which]))
        out = np.zeros((len(queries), len(codes)))
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            q = rest[:, p]
            table = (q**2).sum(1)[:, None] + (w**2).sum(1) - 2 * q @ w.T
            out += table[:, codes[:, m]]
        return out


# ------------------------------------------------------------------ tasks
def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable): flat doubles of a column of float lists; a vector counts if it is not null, empty, zero or without a finite number throughout."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) > 0
    norm = np.bincount(row, np.where(np.isfinite(flat), flat, 0) ** 2, minlength=len(size))
    return flat, offsets, ~bad & (norm > 0) & np.isfinite(norm)


def _hashes(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each vector: equal vectors have equal ones, whatever the sign of their zeros."""
    bits = (flat + 0.0).view(np.uint64)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    sums = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        h = np.zeros(len(offsets) - 1, np.uint64)
        np.add.at(h, row, mix(bits ^ mix(place.astype(np.uint64) * salt + salt)))
        sums.append(h.view(np.int64))
    return sums


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, size, h1, h2) of vectors that count."""
    for batch in batches:
        flat, offsets, ok = _rows(batch.column(1))
        columns = [batch.column(0), pa.array(np.diff(offsets)), *map(pa.array, _hashes(flat, offsets))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in columns], names=["vec_id", "size", "h1", "h2"])


def _whole(size: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, h1, h2, vec) of the vectors of one size that count, as bytes of 32-bit floats."""
        for batch in batches:
            flat, offsets, ok = _rows(batch.column(1))
            rows = np.flatnonzero(ok & (np.diff(offsets) == size))
            vec = [flat[offsets[r] : offsets[r] + size].astype(np.float32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(h[rows]) for h in _hashes(flat, offsets)), pa.array(vec, pa.binary())], names=["vec_id", "h1", "h2", "vec"])

    return whole


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)


_INDEXED = "vec_id long, weight long, vec binary, list long, probes array<long>, code binary, missed double, bytes binary, scale double, rounded double"


def _index(quantiser, wall: float):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            unit = _floats(batch.column(2))
            unit /= np.sqrt((unit**2).sum(1))[:, None]
            own = q.cell(unit)
            codes, missed = q.code(unit, own)
            row, lists = q.probes(unit, own, wall)
            scale = np.abs(unit).max(1) / 127
            rounded = np.rint(unit / scale[:, None])
            off = np.sqrt(((unit - rounded * scale[:, None]) ** 2).sum(1))
            ends = pa.array(np.searchsorted(row, np.arange(len(unit) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(own), pa.ListArray.from_arrays(ends, pa.array(lists)), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(missed), pa.array([b.tobytes() for b in rounded.astype(np.int8)], pa.binary()), pa.array(scale), pa.array(off),
                ],
                names=[c.split()[0] for c in _INDEXED.split(", ")],
            )

    return index


MEMBER, PROBE, OWN = 0, 1, 2  # a list's vector; one that probes it; a list's vector that asks as well


def _by_list(table: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table]]:
    """(list, members, those that ask) of the lists of one call: where a list is a single block its members ask too."""
    lists, role = table.column("list").to_numpy(), table.column("role").to_numpy()
    order = np.lexsort((role, lists))
    lists, role, table = lists[order], role[order], table.take(pa.array(order))
    for part in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(lists)) + 1):
        n = int((role[part] == MEMBER).sum())
        if len(part) and n:
            yield int(lists[part[0]]), table.slice(part[0], n), table.slice(part[0] + n, len(part) - n)


def _codes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _screen(quantiser, reach: float):
    def screen(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """(list, vec_id) of the probes that some member's code lets pass."""
        q, lists, ids = quantiser.value, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, members, probes in _by_list(table):
            if not probes.num_rows:
                continue
            x = np.frombuffer(b"".join(probes.column("bytes").to_pylist()), np.int8).reshape(probes.num_rows, -1) * probes.column("scale").to_numpy()[:, None]
            far = reach + members.column("missed").to_numpy() + probes.column("rounded").to_numpy()[:, None] + 1e-9
            passes = (q.distances(x, name, _codes(members)) <= far**2).any(1)
            ids.append(probes.column("vec_id").to_numpy()[passes])
            lists.append(np.full(len(ids[-1]), name))
        return pa.table({"list": pa.array(np.concatenate(lists)), "vec_id": pa.array(np.concatenate(ids))})

    return screen


COUNT, EDGE = 0, 1


def _meet(quantiser, similarity: float, reach: float):
    def links(name: int, members: pa.Table, ask: pa.Table, q: Quantiser) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, y = _floats(ask.column("vec")), _floats(members.column("vec"))
        nx, ny = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
        far = (reach + members.column("missed").to_numpy() + 1e-9) ** 2
        i, j = np.nonzero(q.distances(x / nx[:, None], name, _codes(members)) <= far)
        a, b = ask.column("vec_id").to_numpy(), members.column("vec_id").to_numpy()
        # A pair is counted once: of one list by its smaller vector, else here if it isn't met in the other list as well.
        home = ask.column("home").to_numpy()
        met, ends = members.column("probes").combine_chunks(), np.cumsum(members.column("probes").combine_chunks().value_lengths().to_numpy())
        which = np.repeat(np.arange(len(b)), np.diff(ends, prepend=0))
        asked, names = np.unique(home, return_inverse=True)
        place = np.minimum(np.searchsorted(asked, met.flatten().to_numpy()), len(asked) - 1)
        twice = np.unique((which * len(asked) + place)[asked[place] == met.flatten().to_numpy()])
        once = (home[i] != name) & ~np.isin(j * len(asked) + names[i], twice)
        i, j = i[once | (a[i] < b[j])], j[once | (a[i] < b[j])]
        cosine = np.concatenate([np.zeros(0), *((x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) / (nx[i[k : k + 65536]] * ny[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
        i, j = i[cosine >= similarity], j[cosine >= similarity]
        if len(i):
            wa, wb = ask.column("weight").to_numpy(), members.column("weight").to_numpy()
            na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            np.add.at(na, i, wb[j])
            np.add.at(nb, j, wa[i])
            yield COUNT, a[na > 0], na[na > 0]
            yield COUNT, b[nb > 0], nb[nb > 0]
            yield EDGE, *_forest(a[i], b[j])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        q, out = quantiser.value, [np.zeros((0, 3), np.int64)]
        for name, members, others in _by_list(table):
            own = [members] if (key[1].as_py(), key[2].as_py()) == (-1, -1) else []
            for ask in [*own, *([others] if others.num_rows else [])]:
                out += [np.stack([np.full(len(l), kind), l, r], axis=1) for kind, l, r in links(name, members, ask, q)]
        rows = np.concatenate(out)
        return pa.table({"kind": pa.array(rows[:, 0], pa.int32()), "a": pa.array(rows[:, 1]), "b": pa.array(rows[:, 2])})

    return meet


def _grid(members: DataFrame, probes: DataFrame, own: bool) -> DataFrame:
    """Members and probes of each list dealt to blocks that meet: (meet, mb, pb) names a call.

    Lists of a single block share calls; there members ask too, if ``own``; in larger lists they are then
    dealt among the probes as well.
    """
    one = F.count(F.lit(1))
    sizes = members.groupBy("list").agg(one.alias("m")).join(probes.groupBy("list").agg(one.alias("p")), "list", "left" if own else "inner").fillna(0, ["p"])
    sizes = sizes.where("m > 1 OR p > 0")
    single = (F.col("m") <= BLOCK) & (F.col("p") <= BLOCK)
    lots = sizes.select(F.ceil((F.coalesce(F.sum(F.when(single, F.col("m") + F.col("p"))), F.lit(0)) + 1) / LOT)).first()[0]
    asks = F.col("p") + (F.col("m") if own else F.lit(0))
    sizes = sizes.select("list", F.when(single, F.pmod(F.xxhash64("list"), F.lit(lots)) - (1 << 40)).otherwise(F.col("list")).alias("meet"), F.when(~single, F.ceil(F.col("m") / BLOCK)).cast("int").alias("ms"), F.when(~single, F.ceil(asks / BLOCK)).cast("int").alias("ps"))
    every = lambda n: F.explode(F.when(F.col(n).isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col(n) - 1)))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")
    block = lambda n: F.coalesce(spread % F.col(n), F.lit(-1))
    asking = probes.withColumn("role", F.lit(PROBE))
    dealt = members.withColumn("role", F.lit(MEMBER)).join(sizes, "list").withColumns({"mb": block("ms")}).withColumn("pb", every("ps"))
    asked = asking.join(sizes, "list").withColumns({"pb": block("ps")}).withColumn("mb", every("ms"))
    out = dealt.unionByName(asked, allowMissingColumns=True)
    if own:
        more = members.withColumn("role", F.lit(OWN)).join(sizes.where("ms IS NOT NULL"), "list").withColumns({"pb": block("ps")}).withColumn("mb", every("ms"))
        out = out.unionByName(more, allowMissingColumns=True)
    return out.drop("ms", "ps")


# ------------------------------------------------------------------ the operator
def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Two vectors link if their cosine, in double precision, is at least ``similarity``. Null, empty and zero
    vectors, those with null or non-finite numbers and those without an id link with nothing. Vectors link
    only with those of their own length; each length has an index of its own. Equal vectors are one class,
    compared once and counted by its size. An id that stands in several rows gets one result per row: the
    most links and the smallest component of its vectors, which may be unlike and of unlike lengths. An
    empty table gives no rows; columns of the input but the two named are not read.

    The quantisers are fitted on at most 65,536 classes, those of the smallest hashes; every class is then
    indexed. Lists hold about 64 vectors, up to 4096 * 4096 lists. A list is met in blocks of about 2,048
    members and 2,048 probes, whatever its size, and a block returns sums and a spanning forest, never its
    pairs. ``reach`` is the share of the radius within which walls are probed; sqrt(0.5) loses nothing, and
    by default it follows from the vectors' effective dimensions.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vec"))
    one = F.count(F.lit(1))
    names = settle(rows.where("vec_id IS NOT NULL").mapInArrow(lean(_names), "vec_id long, size long, h1 long, h2 long").groupBy("vec_id", "size", "h1", "h2").agg(one.alias("times")), "vectors", few=True)
    classes = settle(names.groupBy("size", "h1", "h2").agg(F.min("vec_id").alias("vec_id"), one.alias("weight"), F.min_by("times", "vec_id").alias("times")), "classes", few=True)
    # A node of the link graph is a class; its number is its vector's smallest id, made unique where an id has several vectors.
    several = not names.groupBy("vec_id").agg(one.alias("n")).where("n > 1").isEmpty()
    classes = classes.withColumn("node", F.xxhash64("size", "h1", "h2") if several else F.col("vec_id"))
    wall = math.sqrt(2 - 2 * similarity)
    met, used = None, []
    for size, n, repeated in sorted(tuple(r) for r in classes.groupBy("size").agg(one.alias("n"), F.max("times").alias("times")).collect()):
        own = classes.where(F.col("size") == size).select("vec_id", "h1", "h2", "weight", "node")
        whole = rows.where("vec_id IS NOT NULL").mapInArrow(lean(_whole(size)), "vec_id long, h1 long, h2 long, vec binary").join(own, ["vec_id", "h1", "h2"])
        whole = whole.dropDuplicates(["vec_id", "h1", "h2"]) if repeated > 1 else whole
        sample = _floats(whole.orderBy("h1", "h2").limit(SAMPLE).select("vec").toArrow().column("vec"))
        sample /= np.sqrt((sample**2).sum(1))[:, None]
        fitted = Quantiser(sample, math.ceil(n / LIST))
        near = reach if reach is not None else fitted.reach(sample)
        quantiser = spark.sparkContext.broadcast(fitted)
        index = settle(whole.select(F.col("node").alias("vec_id"), "weight", "vec").mapInArrow(lean(_index(quantiser, near * wall)), _INDEXED), "index")
        members = index.select("list", "vec_id", "code", "missed")
        probes = index.select(F.explode("probes").alias("list"), "vec_id", "bytes", "scale", "rounded")
        passed = settle(_grid(members, probes, False).groupBy("meet", "mb", "pb").applyInArrow(_screen(quantiser, wall), "list long, vec_id long").distinct(), "passed", few=True)
        members = index.select("list", "vec_id", "code", "missed", "weight", "vec", "probes", F.col("list").alias("home"))
        probes = passed.join(index.select("vec_id", "weight", "vec", F.col("list").alias("home")), "vec_id")
        found = settle(_grid(members, probes, True).groupBy("meet", "mb", "pb").applyInArrow(_meet(quantiser, similarity, wall), "kind int, a long, b long"), "met", few=True)
        met, used = found if met is None else met.union(found), [*used, index, passed]
    if met is None:
        met = spark.createDataFrame([], "kind int, a long, b long")
    links = met.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    known = components(met.where(F.col("kind") == EDGE).select("a", "b"))
    of = classes.join(links, "node", "left").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A vector's id may stand for several classes; where one does, they are of one component by its id.
    least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of = of.join(least, "component").select("size", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = settle(names.join(of, ["size", "h1", "h2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked", few=True)
    for table in used:
        forget(table)
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
