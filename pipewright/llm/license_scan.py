"""License scan by ordered signature rules, in DataFrame functions alone (operator 4).

A text is brought to its words, each between two spaces of its own, so that a run of words is a plain
pattern and spaces count words. Every rule has a keyword; its regular expression runs only over texts
that hold it. Of detections that lie inside another, the one of lower priority goes (of equal priority
the shorter, of equal length the later rule). One sweep over the detections in order of their starts finds
these: what reaches farthest among the detections so far of a priority or more holds the next one, or none
does. The scan is one projection: no shuffle, no Python, and time in proportion to a text and its detections.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import ROOTS, RULES

#: Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaced(text: Column) -> Column:
    """The words of a text, each between two spaces of its own."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words = F.trim(F.regexp_replace(plain, F.lit(SEPARATORS), F.lit("  ")))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(spaced: Column) -> Column:
    """How many words a piece of such a text has: whole words only, so half its spaces."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _let(value: Column, body) -> Column:
    """body(value), with the value found once: in a lambda, what isn't its variable is found anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 64  # numbers that are summed at once


def _running(numbers: Column) -> Column:
    """For each number the sum of those before it, by sums of blocks."""
    def part(of: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(of, first, n), F.lit(0), lambda a, x: a + x)

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / BLOCK).cast("int")), lambda b: part(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def each(xs: Column, upto: Column) -> Column:
        turn = lambda k: F.floor(k / BLOCK).cast("int")
        return F.transform(xs, lambda _, k: F.get(upto, turn(k)) + part(xs, turn(k) * BLOCK + 1, k % BLOCK))

    return _let(numbers, lambda xs: _let(blocks(xs), lambda sums: _let(F.transform(sums, lambda _, b: part(sums, F.lit(1), b)), lambda upto: each(xs, upto))))


def _places(text: Column, rule: Column) -> Column:
    """Detections of one rule, as (from, -to, -priority, rank, label) with words counted from 0: their order is that of the sweep."""
    def place(gaps: Column, hits: Column) -> Column:
        starts = F.zip_with(_running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: g + h)), F.slice(gaps, 1, F.size(hits)), lambda a, g: a + g)
        return F.zip_with(starts, hits, lambda a, n: F.struct(a.alias("from"), (-(a + n)).alias("until"), (-rule["priority"]).alias("weight"), rule["rank"].alias("rank"), rule["label"].alias("label")))

    gaps = F.transform(F.split(text, rule["regex"], -1), _words)
    hits = F.transform(F.regexp_extract_all(text, rule["regex"], F.lit(0)), _words)
    return _let(gaps, lambda g: _let(hits, lambda h: place(g, h)))


LEVELS = sorted({priority for _, priority, _, _ in RULES})


def _sweep(found: Column) -> Column:
    """(reach, labels, top) of the detections that no stronger one holds: their labels and highest priority."""
    levels = F.array(*map(F.lit, LEVELS))
    zero = F.struct(F.array_repeat(F.lit(-1), len(LEVELS)).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"))

    def step(acc: Column, d: Column) -> Column:
        # reach: by level the farthest end so far of a detection of that priority or more.
        level, end = F.array_position(levels, -d["weight"]).cast("int"), -d["until"]
        held = F.element_at(acc["reach"], level) >= end
        reach = F.transform(acc["reach"], lambda x, i: F.when((i < level) & (x < end), end).otherwise(x))
        labels = F.when(held | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(d["label"])))
        return F.struct(reach.alias("reach"), labels.alias("labels"), F.when(held, acc["top"]).otherwise(F.greatest(acc["top"], -d["weight"])).alias("top"))

    return F.aggregate(F.array_sort(found), zero, step)


def _rule_table() -> Column:
    """The rules by keyword, as one constant."""
    ranked = sorted(((k, label, p, r, n) for n, (label, p, k, r) in enumerate(RULES)), key=lambda x: (x[0], x[4]))
    rows = []
    for keyword, group in groupby(ranked, key=lambda x: x[0]):
        members = [F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(r).alias("regex"), F.lit(n).alias("rank")) for _, label, p, r, n in group]
        rows.append(F.struct(F.lit(keyword).alias("keyword"), F.array(*members).alias("rules")))
    return F.array(*rows)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to each document.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. n_base counts the places of
    the base phrases, first_word and last_word are their first and last starts (null without any); their
    labels always stay. labels adds those of the rules' detections that are not suppressed. score is the
    priority of the strongest detection left, over 100, at least 0.5 with a base phrase, else 0. Null and
    empty texts have no words and empty labels; texts of any length are scanned whole; repeated rows get equal
    results; an empty table gives no rows. Columns of the input stay, but for those of these names.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names)).withColumn("__t", _spaced(F.col(f"`{text_col}`")))
    t = F.col("__t")
    empty = F.array().cast("array<string>")
    for i, (phrase, _) in enumerate(BASE):
        words = phrase.split()
        pattern = "".join(f" {w} " for w in words)
        rows = rows.withColumn(f"__b{i}", F.when(F.contains(t, F.lit(pattern)), F.split(t, pattern, -1)))
    n_words = _words(t)
    parts = [(F.col(f"__b{i}"), len(p.split()), label) for i, (p, label) in enumerate(BASE)]
    counts = [F.when(b.isNotNull(), F.size(b) - 1).otherwise(0) for b, _, _ in parts]
    firsts = [F.when(b.isNotNull(), _words(F.element_at(b, 1))) for b, _, _ in parts]
    lasts = [F.when(b.isNotNull(), n_words - _words(F.element_at(b, -1)) - n) for b, n, _ in parts]
    base = F.array_sort(F.array_compact(F.array(*(F.when(b.isNotNull(), F.lit(label)) for b, _, label in parts))))

    gated = reduce(lambda a, b: a | b, (F.contains(t, F.lit(r)) for r in ROOTS))
    groups = F.filter(_rule_table(), lambda g: F.contains(t, g["keyword"]))
    found = F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: _places(t, r)))
    rows = rows.withColumn("__found", F.when(gated, found))
    rows = rows.withColumn("__left", F.when(F.size("__found") > 0, _sweep(F.col("__found")))).withColumn("__base", base)
    score = F.greatest(F.coalesce(F.col("__left.top"), F.lit(0)) / 100.0, F.when(F.size("__base") > 0, 0.5).otherwise(0.0))
    labels = F.array_distinct(F.concat(F.col("__base"), F.coalesce(F.col("__left.labels"), empty)))
    return rows.withColumns({
        "n_words": n_words.cast("long"), "n_base": reduce(lambda a, b: a + b, counts).cast("long"),
        "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_join("__base", ","), "labels": F.array_join(F.array_sort(labels), ","), "score": score.cast("double"),
    }).drop("__t", "__found", "__left", "__base", *(f"__b{i}" for i in range(len(BASE))))
