"""Quality rules on repetition inside a text, from suffix arrays (operator 2).

The suffixes of the word sequences of many texts are sorted together by prefix doubling. A round sorts
the suffixes by twice as many words as before; one that no other suffix of its text ties with has its
final place and leaves the rounds. The longest common prefix of neighbours in the array comes from the
rounds' ranks: two places have equal ranks after the round of h words just if those h words are equal.
The larger of a place's two common prefixes is the longest repeat that starts there; the intervals of
the array in which it can't be extended are the maximal repeated substrings. The union of their spans
is what a text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, texts, word_hashes, words

CHUNK = 1 << 20  # bytes of text that are sorted together; a longer text is sorted alone
BASE_RUN = 8  # words of a window of the base rule

#: Fixed values of the method's verdict.
MIN_REPEAT = 16  # words of a maximal repeat that counts
MAX_COVERED = 20  # per cent of a text's words that such repeats may cover
MAX_LONGEST = 100  # words that the longest repeat may have

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(word: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each place the most words from there on that its text has elsewhere too; 0 if fewer than ``least``.

    word: a 64-bit hash for each word of all texts, doc: the ascending number of its text, least: a power
    of two. Repeats may overlap themselves.
    """
    n = len(word)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    end = np.searchsorted(doc, doc, "right")  # the place after each place's text
    rank = np.empty(n, np.int64)
    places, h = np.arange(n), 0
    key = word ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    levels: list[tuple[int, np.ndarray]] = []
    candidates = np.zeros(0, np.int64)
    base = np.zeros(n, np.int64)  # where in the array the group starts that is being refined
    while len(places):
        order = np.argsort(key)
        ordered, at = key[order], places[order]
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        # A group's rank is the number of suffixes before it: those before its parent, and its elder parts.
        if h == 0:
            rank[at] = np.repeat(first, size)
        else:
            parent = base[at]
            begins = np.empty(len(at), bool)
            begins[0], begins[1:] = True, parent[1:] != parent[:-1]
            origin = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            rank[at] = parent + np.repeat(first, size) - origin
        h = 2 * h or 1
        tied = np.repeat(size > 1, size)
        places = at[tied]
        if h <= least:
            levels = [(1, levels[0][1] if levels else rank.copy()), *levels[1:]]
            if h > 1:
                levels.append((h, rank.copy()))
        else:
            levels.append((h, rank.copy()))
        if h == least:
            candidates = places
        base = rank.copy()
        follow = places + h
        inside = follow < end[places]
        key = rank[places] * np.int64(n + 2) + np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
    if not len(candidates):
        return longest
    order = candidates[np.argsort(rank[candidates])]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for h, ranks in reversed(levels):
        i, j = a + common, b + common
        open_ = np.flatnonzero((i < end[a]) & (j < end[b]) & (doc[a] == doc[b]))
        equal = open_[ranks[i[open_]] == ranks[j[open_]]]
        common[equal] += h
    best = np.zeros(len(order), np.int64)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    longest[order] = best
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which places lie in the span of a repeat of ``least`` words or more, or of its first ``most`` words."""
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (longest[starts] if most is None else most), -1)
    return np.cumsum(change[:-1]) > 0


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a column."""
    data, offsets = texts(column)
    parts = []
    for i, j in slices(offsets, CHUNK):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(own, at)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        longest = longest_repeats(word_hashes(own, starts, ends), doc, BASE_RUN)
        best = np.zeros(j - i, np.int64)
        np.maximum.at(best, doc, longest)
        points = np.zeros(len(own) + 1, np.int64)
        np.cumsum((own & 0xC0) != 0x80, out=points[1:])
        raw = own.tobytes()
        parts.append({
            "n_words": np.diff(first),
            "word_chars": _sums(points[ends] - points[starts], first),
            "n_symbols": _sums(_SYMBOL[own], at),
            "n_dup_lines": np.array([_duplicate_lines(raw[at[k] : at[k + 1]]) for k in range(j - i)], np.int64),
            "n_repeat_words": _sums(covered(longest, BASE_RUN, BASE_RUN), first),
            "repeat_covered": _sums(covered(longest, MIN_REPEAT), first),
            "longest_repeat": best,
        })
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_covered long, longest_repeat long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, text_col: str = "text", max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to each document; one pass, no shuffle.

    repeat_covered counts the words in maximal repeats of 16 words or more, longest_repeat has the words
    of the longest repeat of 8 or more (else 0). A text that passes the base rules is kept unless such
    repeats cover more than ``max_covered`` per cent of it or the longest has over ``max_longest`` words.
    Null and empty texts have no words and fail the base rules; texts of any length are measured whole, in
    n log n steps. Repeated rows get equal results; an empty table gives no rows. All
    columns of the input stay; one whose name a measure has is replaced. Words are told apart by 64-bit
    hashes, lines and repeats by theirs.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]
    kept_columns = [c for c in docs.columns if c.lower() not in names]
    place = kept_columns.index(text_col)

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(place))
            n = m["n_words"]
            failed = (n < 20) | (100 * m["n_repeat_words"] > 30 * n)
            kept = ~failed & (100 * m["repeat_covered"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
            columns = [*batch.columns, *(pa.array(m[k]) for k in names[:-2]), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_columns, *names])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept_columns))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), MEASURES])
    return rows.mapInArrow(lean(rules), schema)
