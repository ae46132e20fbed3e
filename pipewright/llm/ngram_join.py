"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole (operator 10).

Shingles are hashed into the segments of a size band. Two sets of sizes l >= s with Jaccard similarity
t or more differ in at most H = (1 - t) / (1 + t) * (l + s) shingles. If a set spends a budget of more
than H on its segments, 1 where only an equal segment counts and 2 where one differing shingle is
allowed, then any similar set matches it in some segment that got its share. So each document emits

* in its own band a key for each segment that isn't empty, and in bands of small sets also one for each
  segment less one shingle (the one-deletion neighbourhood); with these it can be found,
* and asks for partners with just those keys, there and in the band below, that the cheapest budget of
  H + 1 takes. A segment's cost falls with the rare shingles in it; which are common is estimated from a
  bounded sample of documents. So segments that hold nothing but a passage many documents quote are left
  out where the budget allows. The estimate decides on cost only: any budget of H + 1 finds every link.

A document whose segments can't raise the budget ("deficient") is covered by further drawings of the
partition in tiny bands, and elsewhere, where the chance is below 1e-11 a document, makes the whole join
draw anew.

Documents that share a key for which at least one asks are candidates. Within a key each is linked to
the key's first document, its center; a document is first checked against the center it shares most keys
with. The components that this gives gather the documents of their centers' keys, and those of them that
are not connected yet are checked against their group, by products of incidence matrices. In a large group
a shingle that only one component holds can't be common to documents of two; what of such shingles two
documents have together must fit into H, and only documents of which that can be true meet, in blocks. A crowd, many documents of one task's lot that share a key, is tied to a center of its own
there, and only that goes on with the key; so where all lots' rows of the key meet, the crowd's center is
named with the key's, and the crowd's documents join the group of the key's center too. That is enough
for components: a pair that is never compared is already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, lower_ascii, mix, partitions, settle, slices, texts, word_hashes, words
from .components import _forest, components

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5  # words of a shingle; similarity 4/5
DELETIONS_UP_TO = 256  # bands of sets up to this size have one-deletion neighbourhoods
DRAWS_UP_TO, DRAWS = 40, 4  # bands of sets up to this size are partitioned so many times
KEYS_AT_ONCE = 300_000
MEET = 250  # documents of a block, about
SMALL = 200_000  # rows of a table that is broadcast
CROWD = 64  # documents of one key in one task that are linked before the shuffle
KEYS_PER_TASK = 3_000_000

_G = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ------------------------------------------------------------------ sets
def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words has its whole sequence as one."""
    data, offsets = texts(column)
    for i, j in slices(offsets, 1 << 20):
        own, at = lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(own, at)
        h = word_hashes(own, starts, ends)
        n = max(0, len(h) - width + 1)
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = (s ^ h[k : k + n]) * _G[k % 5]
            s ^= s >> np.uint64(31)
        s = mix(s)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield i + k, np.unique(s[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        whole = (whole ^ x) * _G[1]
                        whole ^= whole >> np.uint64(29)
                    yield i + k, mix(np.array([whole]))
            else:
                yield i + k, np.zeros(0, np.uint64)


# ------------------------------------------------------------------ bands and budgets
def _bands(most: int = 1 << 40) -> list[int]:
    tops = [4]
    while tops[-1] < most:
        tops.append(-(-tops[-1] * DENOMINATOR // NUMERATOR))
    return tops


TOPS = _bands()


def band(size: int) -> int:
    return int(np.searchsorted(TOPS, size))


def differences(l: int, s: int) -> int:
    """The most shingles in which similar sets of these sizes differ."""
    return (DENOMINATOR - NUMERATOR) * (l + s) // (DENOMINATOR + NUMERATOR)


def segments(g: int) -> int:
    """Segments of band g: more than any budget needs, so that empty ones can be left out."""
    budget = differences(TOPS[g] * DENOMINATOR // NUMERATOR, TOPS[g]) + 1
    if budget <= 2:
        return 1
    if TOPS[g] <= DRAWS_UP_TO:
        return budget
    return math.ceil(0.75 * budget if TOPS[g] <= DELETIONS_UP_TO else 1.2 * budget)


#: Lowest bits of a key: one shingle is left out; it is only to be found by; its set belongs to the band above.
DELETED, PASSIVE, ABOVE, BITS = 1, 2, 4, np.uint64(3)


def _allocate(share: np.ndarray, rare: np.ndarray, budget: int) -> np.ndarray:
    """How much of the budget each segment gets: 1 costs as its rare shingles, 2 as one shingle fewer."""
    units = np.concatenate([np.flatnonzero(share > 0), np.flatnonzero(share > 1)])
    second = np.arange(len(units)) >= int((share > 0).sum())
    worth = 2 * rare[units] + 1 - 3 * second
    return np.bincount(units[np.argsort(-worth, kind="stable")[:budget]], minlength=len(share))


def keys_of(tokens: np.ndarray, seed: int, common: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Keys of one set, with their bits, and whether it is deficient."""
    out, deficient, size = [], False, len(tokens)
    if size < NUMERATOR:
        return np.zeros(0, np.uint64), False  # only equal sets are similar
    own, is_rare = band(size), np.ones(size, bool)
    if common is not None and len(common):
        is_rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    for g in (own, own - 1):
        top = TOPS[g] if g >= 0 else 0
        most = min(size, top)
        least = max(-(-size * NUMERATOR // DENOMINATOR), (TOPS[g - 1] if g else 0) + 1)
        if g < 0 or least > most:
            continue
        budget, m, near = differences(size, most) + 1, segments(g), top <= DELETIONS_UP_TO
        short = True
        for draw in range(DRAWS if top <= DRAWS_UP_TO and m > 1 else 1):
            salt = mix(np.array([(seed * 64 + draw) * 4096 + g + 1], np.uint64))[0]
            mixed = mix(tokens ^ salt)
            place = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(place, minlength=m)
            content = np.zeros(m, np.uint64)
            np.add.at(content, place, mixed)
            share = np.minimum(count, 2 if near else 1)
            short &= bool(share.sum() < budget)
            take = _allocate(share, np.bincount(place[is_rare], minlength=m), budget)
            label = mix(np.arange(m, dtype=np.uint64) * _G[0] + salt)
            above = np.uint64(ABOVE if g < own else 0)
            used = np.flatnonzero(take if g < own else count)
            out.append((mix(content[used] ^ label[used]) << BITS) | np.where(take[used] > 0, above, np.uint64(PASSIVE)))
            if near:
                drop = (take[place] == 2) if g < own else (count[place] > 1)
                keys = mix((content[place[drop]] - mixed[drop]) ^ label[place[drop]]) << BITS
                out.append(keys | np.where(take[place[drop]] == 2, above, np.uint64(PASSIVE)) | np.uint64(DELETED))
        deficient |= short
    return np.concatenate(out), deficient


# ------------------------------------------------------------------ candidates
def _stars(keys: np.ndarray, docs: np.ndarray, crowd: int):
    """Groups of equal keys, but for the bits, as stars about their smallest document, whatever its bits:
    then the groups of one segment, whole and less one shingle, mostly have the same center.

    Returns (document, center, keys they share) of the groups of at least ``crowd`` rows, and the rows
    that must go on to meet other tasks' rows: of a crowd the first with each bits, else all.
    Without a crowd only groups count in which one asks and one lacks no shingle.
    """
    order = np.lexsort((docs, keys >> BITS))
    keys, docs = keys[order], docs[order]
    name, bits = keys >> BITS, (keys & np.uint64(7)).astype(np.int64)
    new = np.empty(len(name), bool)
    new[:1], new[1:] = True, name[1:] != name[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(name)))
    center = np.repeat(docs[first], size)
    if crowd:
        counts = size >= crowd
    else:
        counts = np.logical_or.reduceat((bits & PASSIVE) == 0, first) & np.logical_or.reduceat((bits & DELETED) == 0, first)
    counts = np.repeat(counts, size)
    onward = ~counts
    if crowd:
        onward[np.unique(keys, return_index=True)[1]] = True
    star = counts & (docs != center)
    pair, shared = np.unique(np.stack([docs[star], center[star]]), axis=1, return_counts=True) if star.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    return pair[0], pair[1], shared, keys[onward], docs[onward]


def _crowds(keys: np.ndarray, crowd: int) -> np.ndarray:
    """The keys, without their bits, that are a crowd's."""
    name, size = np.unique(keys >> BITS, return_counts=True)
    return name[size >= crowd]


def _ties(keys: np.ndarray, docs: np.ndarray, names: np.ndarray, lot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(center of a lot's crowd, center of the key) where they differ, of the keys ``names`` by their crowds' centers ``lot``."""
    mine = np.isin(keys >> BITS, names)
    keys, docs = keys[mine], docs[mine]
    order = np.lexsort((docs, keys >> BITS))
    keys, docs = keys[order], docs[order]
    bits = (keys & np.uint64(7)).astype(np.int64)
    name, first = np.unique(keys >> BITS, return_index=True)
    counts = np.logical_or.reduceat((bits & PASSIVE) == 0, first) & np.logical_or.reduceat((bits & DELETED) == 0, first)
    at = np.searchsorted(name, names)
    tie = counts[at] & (docs[first][at] != lot)
    pair = np.unique(np.stack([lot[tie], docs[first][at][tie]]), axis=1) if tie.any() else np.zeros((2, 0), np.int64)
    return pair[0], pair[1]


SAMPLE, COMMON = 5000, 0.002  # documents that tell common shingles, and the share of them that holds such a one


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        sets = [t for _, t in shingle_sets(batch.column(1))]
        token, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


def _common(rows: DataFrame, documents: int) -> np.ndarray:
    """Shingles that many documents hold, sorted, from about 5,000 documents: at most their number of shingles over 10."""
    every = max(1, documents // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    least = max(10, int(COMMON * documents / every))
    counts = sample.mapInArrow(lean(_shingle_counts), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(counts.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _payload(*columns) -> bytes:
    return np.stack([np.asarray(c).view(np.int64) if np.asarray(c).dtype == np.uint64 else np.asarray(c, np.int64) for c in columns], axis=1).tobytes()


KEYS, PAIRS, STATS, DEFICIENT, CROWDED, CENTERS, TIES = 0, 1, 2, 3, 4, 5, 6
_COLUMNS = {KEYS: 2, PAIRS: 3, STATS: 4, DEFICIENT: 1, CROWDED: 3, CENTERS: 2}


def _emit(seed: int, tasks: int, common):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_docs, held, stats, deficient, turn = [], [], 0, [], [], 0
        seen: set[tuple[int, int, int]] = set()

        def deal(kind: int, names: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
            task = ((mix(names) >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            cut = np.searchsorted(task[order], np.arange(tasks + 1))
            columns = [c[order] for c in columns]
            return [(t, kind, _payload(*(c[a:b] for c in columns))) for t, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]

        def flush() -> pa.RecordBatch:
            nonlocal held_keys, held_docs, held, stats, deficient, turn
            rows = []
            if held_keys:
                # A key that many documents of this task share goes on once; the others are linked to its first here.
                whole = np.concatenate(held_keys)
                *pairs, keys, docs = _stars(whole, np.concatenate(held_docs), CROWD)
                if len(pairs[0]):
                    rows.append((turn % tasks, CROWDED, _payload(*pairs)))
                rows += deal(KEYS, keys >> BITS, keys, docs)
                crowds = _crowds(whole, CROWD)
                if len(crowds):
                    sent = np.isin(keys >> BITS, crowds)
                    order = np.lexsort((docs[sent], keys[sent] >> BITS))
                    names, first = np.unique((keys[sent] >> BITS)[order], return_index=True)
                    rows += deal(CENTERS, names, names, docs[sent][order][first])
            if stats:
                rows.append((turn % tasks, STATS, _payload(*(np.array(c) for c in zip(*stats, strict=True)))))
            if deficient:
                rows.append((turn % tasks, DEFICIENT, _payload(np.array(deficient))))
            held_keys, held_docs, held, stats, deficient, turn = [], [], 0, [], [], turn + 1
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["task", "kind", "payload"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in shingle_sets(batch.column(1)):
                doc = ids[row]
                mixed = mix(tokens)
                stats.append((doc, len(tokens), int(mixed.sum().view(np.int64)), int(mix(mixed ^ _G[2]).sum().view(np.int64))))
                if stats[-1][1:] in seen:
                    continue  # an equal set has sent these keys; their class links the two
                seen.add(stats[-1][1:])
                keys, short = keys_of(tokens, seed, common.value)
                if short:
                    deficient.append(doc)
                if len(keys):
                    held_keys.append(keys)
                    held_docs.append(np.full(len(keys), doc, np.int64))
                    held += len(keys)
                    if held >= KEYS_AT_ONCE:
                        yield flush()
        if stats:
            yield flush()

    return emit


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's keys become pairs with each key's first document, and its crowds' centers are tied to that; all else passes through."""
    keys, docs, names, lots = [], [], [], []

    def rows(kind: int, columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        filled = [pa.array(np.asarray(c, np.int64)) for c in columns] + [pa.array(np.zeros(n, np.int64))] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *filled], names=["kind", "w", "x", "y", "z"])

    for batch in batches:
        for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            table = np.frombuffer(payload.as_buffer(), np.int64).reshape(-1, _COLUMNS[kind])
            if kind == KEYS:
                keys.append(table[:, 0].view(np.uint64).copy())
                docs.append(table[:, 1].copy())
            elif kind == CENTERS:
                names.append(table[:, 0].view(np.uint64).copy())
                lots.append(table[:, 1].copy())
            else:
                yield rows(kind, list(table.T))
    if keys:
        keys, docs = [np.concatenate(keys)], [np.concatenate(docs)]
        if names:
            ties = _ties(keys[0], docs[0], np.concatenate(names), np.concatenate(lots))
            if len(ties[0]):
                yield rows(TIES, list(ties))
        doc, center, shared, _, _ = _stars(keys.pop(), docs.pop(), 0)
        for i in range(0, len(doc), 500_000):
            yield rows(PAIRS, [c[i : i + 500_000] for c in (doc, center, shared)])


# ------------------------------------------------------------------ the exact check
FILTER_BITS = 1 << 24


def _sets(wanted):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()]))
            ids, found = batch.column(0), []
            for row, tokens in shingle_sets(batch.column(1)):
                found.append(tokens.view(np.int64))
                if len(found) == 256 or row == batch.num_rows - 1:
                    flat = pa.array(np.concatenate(found))
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids.slice(row + 1 - len(found), len(found)), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "tokens"])
                    found = []

    return sets


def _sets_of(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, tokens) of some documents.

    A bitmap of 2 MB, whatever the number of names, holds back most other documents where they are read,
    so that texts need no shuffle; the sets are then joined with the names exactly.
    """
    spark = names.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    marks = names.select(place.alias("h")).groupBy(F.expr("h div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, h % 64)")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool))
    found = rows.select("doc_id", "text", place.alias("h")).mapInArrow(lean(_sets(wanted)), "doc_id long, tokens array<long>")
    return settle(found.join(names, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of documents whose whole sets are similar."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    # Many documents meet one center: the center's set is attached last, and AQE splits a center with many partners.
    both = pairs.join(left, "a").join(right, "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return settle(both.where(common * DENOMINATOR >= (total - common) * NUMERATOR).select("a", "b"), "links", few=True)


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links (a, b) between the documents of each group that ask and those that are heard, as a forest."""
    group, asks, heard = (table.column(k).to_numpy(zero_copy_only=False) for k in ("of", "asks", "heard"))
    doc, component = table.column("doc").to_numpy(), table.column("c").to_numpy()
    column = table.column("tokens").combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    order, out = np.argsort(group, kind="stable"), [(np.zeros(0, np.int64),) * 2]
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        a, b = rows[asks[rows]], rows[heard[rows]]
        if not len(a) or not len(b):
            continue
        size = (ends[rows + 1] - ends[rows]).astype(np.int64)
        token, which = np.unique(np.concatenate([flat[ends[r] : ends[r + 1]] for r in rows]), return_inverse=True)
        often = np.bincount(which) > 1
        name = np.cumsum(often) - 1
        at, keep = np.repeat(np.arange(len(rows)), size), often[which]
        at, which = at[keep], name[which[keep]]
        sorted_ = np.argsort(which, kind="stable")
        at, which = at[sorted_], which[sorted_]
        common = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, int(often.sum()), 4096):
            i, j = np.searchsorted(which, [k, k + 4096])
            x = np.zeros((len(rows), 4096), np.float32)
            x[at[i:j], which[i:j] - k] = 1
            common += x[asks[rows]] @ x[heard[rows]].T
        common = common.astype(np.int64)
        total = size[asks[rows]][:, None] + size[heard[rows]] - common
        link = (common * DENOMINATOR >= total * NUMERATOR) & (component[a][:, None] != component[b])
        i, j = np.nonzero(link)
        if len(i):
            out.append(_forest(doc[a[i]], doc[b[j]]))
    return pa.table({"a": pa.array(np.concatenate([o[0] for o in out])), "b": pa.array(np.concatenate([o[1] for o in out]))})


def _component(nodes: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """Add the component of a column's documents; one that ``known`` has not is its own."""
    return nodes.join(known.withColumnsRenamed({"node": column, "component": name}), column, "left").withColumn(name, F.coalesce(name, column))


def _near(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the groups of ``sizes``, which goes to all tasks if it is small, so that a large group isn't sent to one."""
    own = sizes.select("of")
    return rows.join(F.broadcast(own) if own.count() <= SMALL else own, "of")


def _screened(group: DataFrame, sets: DataFrame) -> DataFrame:
    """(of, doc, c, light) of the documents of large groups that may have a partner there.

    Two documents of different components differ in all shingles that only one component of the group holds.
    With u such shingles of s, weight = 9 u - s (for 4/5): similar documents' weights add up to 0 at most.
    So one with a weight above 0 (not light) meets light ones alone, and one whose weight exceeds what
    the lightest takes off meets nothing.
    """
    whole = sets.select(F.col("doc_id").alias("doc"), "tokens")
    tokens = group.select("of", "doc", "c").join(whole, "doc").select("of", "doc", "c", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("of", "token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("of", "token")
    common = tokens.join(shared, ["of", "token"], "left_semi").groupBy("of", "doc").agg(F.count(F.lit(1)).alias("common"))
    size = group.select("of", "doc", "c").join(whole.select("doc", F.size("tokens").alias("size")), "doc").join(common, ["of", "doc"], "left")
    weight = (DENOMINATOR + NUMERATOR) * (F.col("size") - F.coalesce("common", F.lit(0))) - (DENOMINATOR - NUMERATOR) * F.col("size")
    size = settle(size.select("of", "doc", "c", weight.alias("weight")), "weights", few=True)
    least = size.groupBy("of").agg(F.min("weight").alias("least"))
    return size.join(least, "of").where("weight + least <= 0").select("of", "doc", "c", (F.col("weight") <= 0).alias("light"))


def _blocks(rows: DataFrame) -> DataFrame:
    """The blocks in which documents of large groups meet: light ones that ask with all, others that ask with light ones."""
    asks = F.col("c") != F.col("of")
    sizes = rows.groupBy("of").agg(*(F.ceil(F.count(F.when(c, 1)) / MEET).cast("int").alias(k) for k, c in (("la", asks & F.col("light")), ("ha", asks & ~F.col("light")), ("lh", F.col("light")), ("all", F.lit(True)))))
    dealt = rows.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, "of").withColumn("spread", F.pmod(F.xxhash64("doc"), F.lit(1 << 30)).cast("int"))

    def part(which: Column, asking: bool, mine: str, others: str, first: int) -> DataFrame:
        # One side's blocks are numbered by i, the other's by j; a row goes to all blocks of the other side. Negative i: the second grid.
        own, every = F.col("spread") % F.col(mine), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        some = dealt.where(which & (F.col(others) > 0)).withColumns({"asks": F.lit(asking), "heard": F.lit(not asking), "own": own}).withColumn("other", every)
        i, j = ("own", "other") if asking else ("other", "own")
        turned = F.col(i) if not first else -1 - F.col(i)
        return some.select(F.col("of").alias("meet"), turned.alias("i"), F.col(j).alias("j"), "of", "doc", "c", "asks", "heard")

    parts = [part(asks & F.col("light"), True, "la", "all", 0), part(F.lit(True), False, "all", "la", 0), part(asks & ~F.col("light"), True, "ha", "lh", 1), part(F.col("light"), False, "lh", "ha", 1)]
    return reduce(DataFrame.unionByName, parts)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Words are runs of anything but ASCII white space, A-Z lower-cased; sets hold distinct five-word
    shingles, or the whole sequence of a shorter text. Links need 5 * common >= 4 * union. Null and empty
    texts have no shingles and stand alone. Repeated rows get equal results. A null id is returned with
    its count and a null component, linked with nothing. An empty table gives no rows; columns of the input
    but the two named are not read; texts of any length are read whole. Equal sets form
    classes first, and only their smallest document is compared further.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    volume, documents = named.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    tasks = max(partitions(spark), math.ceil((volume or 0) / 12 / KEYS_PER_TASK))
    common = spark.sparkContext.broadcast(_common(named, documents))
    for seed in range(8):
        sent = named.mapInArrow(lean(_emit(seed, tasks, common)), "task int, kind int, payload binary")
        found = settle(sent.repartitionById(tasks, F.col("task")).mapInArrow(lean(_gather), "kind int, w long, x long, y long, z long"), "candidates")
        if found.where(F.col("kind") == DEFICIENT).isEmpty():
            break
    else:
        raise RuntimeError("eight drawings of the partition left some set without a budget")
    stats = found.where(F.col("kind") == STATS).select(F.col("w").alias("doc_id"), F.col("x").alias("n_shingles"), F.col("y").alias("h1"), F.col("z").alias("h2"))
    classes = stats.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first"))
    member = settle(stats.distinct().join(classes, ["n_shingles", "h1", "h2"]).where("first <> doc_id").select(F.col("doc_id").alias("node"), F.col("first").alias("component")), "classes", few=True)
    star = found.where(F.col("kind").isin(PAIRS, CROWDED)).select(F.col("w").alias("doc"), F.col("x").alias("center"), F.col("y").alias("shared"))
    # A crowd's documents meet those of the key's other lots about the key's center.
    ties = found.where(F.col("kind") == TIES).select(F.col("w").alias("lot"), F.col("x").alias("center")).distinct()
    crowd = found.where(F.col("kind") == CROWDED).select(F.col("w").alias("doc"), F.col("x").alias("lot")).distinct()
    star = star.union(crowd.join(ties, "lot").where("doc <> center").select("doc", "center", F.lit(0).cast("long").alias("shared")))
    star = star.groupBy("doc", "center").agg(F.sum("shared").alias("shared"))
    star = _component(_component(star, member, "doc", "a"), member, "center", "b").where("a <> b")
    star = settle(star.groupBy("a", "b").agg(F.max("shared").alias("shared")), "stars", few=True)
    sets = _sets_of(star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct(), named)
    best = star.groupBy("a").agg(F.max(F.struct("shared", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    links = _similar_pairs(best, sets)
    known = components(links)

    # What meets in the keys of a component's centers, as far as it isn't connected yet.
    checked = star.join(best.withColumn("checked", F.lit(True)), ["a", "b"], "left").select("a", "b", F.col("checked").isNull().alias("open"))
    reached = settle(_component(_component(checked, known, "b", "of"), known, "a", "ca"), "reached", few=True)
    group = reached.select("of", F.col("a").alias("doc"), F.col("ca").alias("c"), "open").union(reached.select("of", F.col("b").alias("doc"), F.col("of").alias("c"), "open"))
    group = settle(group.groupBy("of", "doc", "c").agg(F.max("open").alias("open")), "groups", few=True)
    sizes = group.groupBy("of").agg(F.count(F.when(F.col("c") != F.col("of"), 1)).alias("outside"), F.count(F.lit(1)).alias("all"), F.max("open").alias("open"))
    sizes = settle(sizes.where("outside > 0 AND (open OR all > 2)").withColumn("few", F.col("all") <= MEET).drop("open"), "sizes", few=True)
    small, large = (_near(group, sizes.where(c)) for c in ("few", "NOT few"))
    lots = 16 * partitions(spark)
    grid = small.select(F.pmod(F.xxhash64("of"), F.lit(lots)).alias("meet"), F.lit(0).alias("i"), F.lit(0).alias("j"), "of", "doc", "c", (F.col("c") != F.col("of")).alias("asks"), F.lit(True).alias("heard"))
    if not sizes.where("NOT few").isEmpty():
        grid = grid.unionByName(_blocks(_screened(large, sets)))
    grid = grid.join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    more = settle(grid.groupBy("meet", "i", "j").applyInArrow(_meet, "a long, b long"), "more", few=True)
    if not more.isEmpty():
        known = components(links.union(more))

    own = _component(_component(stats, member, "doc_id", "first"), known, "first", "component_id").select("doc_id", "n_shingles", "component_id")
    nameless = rows.where("doc_id IS NULL").mapInArrow(lean(_count), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return own.union(nameless)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(t) for _, t in shingle_sets(batch.column(1))], pa.int64())], names=["n_shingles"])
