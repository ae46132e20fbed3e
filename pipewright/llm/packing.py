"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens (operator 9).

Pieces of the same length are interchangeable, so best-fit decreasing needs only how many there are of
each length: at most ``capacity`` numbers, whatever the corpus holds. The driver packs that histogram
with a segment tree over remaining capacities, taking in one step all pieces of a length that go into
all bins of the tightest fitting capacity. The outcome is that of best-fit decreasing over every single
piece of the whole corpus. Executors then look up each piece's bin by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, settle
from .token_file import word_encoder

RANK_GROUP = 1_000  # pieces of one length that a task ranks together


# ------------------------------------------------------------------ the plan
class CapacityTree:
    """Segment tree over remaining capacities 0 .. capacity: which capacities have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)

    def set(self, c: int, on: bool) -> None:
        c += self.size
        self.tree[c] = on
        while c > 1:
            c //= 2
            self.tree[c] = self.tree[2 * c] or self.tree[2 * c + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        c = least + self.size
        if self.tree[c]:
            return least
        while c > 1:
            if c % 2 == 0 and self.tree[c + 1]:
                c += 1
                while c < self.size:
                    c = 2 * c if self.tree[2 * c] else 2 * c + 1
                return c - self.size
            c //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, pieces per bin, offset): the count pieces of that length from
    that rank go, so many to a bin, into bins numbered on from the first, from that offset on."""
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def add(c: int, first: int, count: int) -> None:
        if count and c:
            open_bins.setdefault(c, []).append((first, count))
            tree.set(c, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and length:
            c = tree.tightest(length)
            if c is None:
                break
            first, count = open_bins[c].pop()
            k = min(left, count)
            if k < count:
                open_bins[c].append((first + k, count - k))
            elif not open_bins[c]:
                tree.set(c, False)
            runs.append((length, rank, k, first, 1, capacity - c))
            add(c - length, first, k)
            left, rank = left - k, rank + k
        if left and length:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                runs.append((length, rank, full * each, bins, each, 0))
                add(capacity - each * length, bins, full)
                bins, rank = bins + full, rank + full * each
            if rest:
                runs.append((length, rank, rest, bins, rest, 0))
                add(capacity - rest * length, bins, 1)
                bins += 1
    return runs


# ------------------------------------------------------------------ pieces
def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only documents of over ``capacity`` tokens are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            out = [[], [], [], [], []]
            names = batch.column(0).to_pylist()
            for row, ids in encoder.column(batch.column(1), end):
                doc_id, raw = names[row], ids.tobytes()
                for k, start in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - start)
                    for column, x in zip(out, (doc_id, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(cut, word_encoder), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, **columns) -> DataFrame:
    """Pack all documents; adds sequence_id and offset to ``pieces``.

    Null and empty texts are one piece, the end id. Repeated documents are packed as often as they stand
    there. A null id is kept as null. An empty table gives no rows. Columns beside id and text are not
    read. No length class is ranked in one task: classes are dealt into groups of about 1,000 by a hash
    and the groups' first ranks come from their sizes.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer, end, capacity, **columns), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = best_fit_decreasing(histogram, capacity)
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    # A list of rows would go through Python workers, and a daemon for them, that stay beside those of the next tasks.
    groups = spark.createDataFrame(pa.table({"length": pa.array(list(histogram), pa.int64()), "groups": pa.array([max(1, -(-n // RANK_GROUP)) for n in histogram.values()], pa.int64())}))
    dealt = cut.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), "groups").cast("long"))
    sizes = dealt.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "group", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = within.join(before, ["length", "group"]).withColumn("rank", F.col("at") + F.col("before"))
    plan = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                table = plan.value[int(length[group[0]])]
                row = table[np.searchsorted(table[:, 0], rank[group], "right") - 1]
                nth = rank[group] - row[:, 0]
                sequence[group] = row[:, 2] + nth // row[:, 3]
                offset[group] = row[:, 4] + (nth % row[:, 3]) * length[group]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
