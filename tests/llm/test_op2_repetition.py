import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pipewright.llm import repetition

from .helpers import WORD, WORDS, table


def brute(text):
    text = text or ""
    w = WORD.findall(text)

    def cover(n):
        count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return len({j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})

    longest = max((n for n in range(8, len(w)) if cover(n)), default=0)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, cover(8), cover(16), longest]


def texts():
    rng = random.Random(5)
    out = ["", None, " \n\t ", "a", "x " * 300, "one two\none two\n\n\none two ", "é\x0bü\x0c#<>ß ñ", "w\x00\x1cv \xa0 z", "ab " * 7 + "cd"]
    for _ in range(40):
        words = [rng.choice(WORDS[: rng.choice([2, 20, 100])]) for _ in range(rng.randrange(1, 200))]
        if rng.random() < 0.7:
            i = rng.randrange(len(words))
            words += words[i : i + rng.randrange(5, 60)] * rng.randrange(1, 3)
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return out


def test_measures():
    m = repetition.measure(pa.array(texts(), pa.string()))
    assert [[int(m[k][i]) for k in m] for i in range(len(texts()))] == [brute(t) for t in texts()]


def test_long_text_beside_short_ones():
    long = " ".join(f"w{i % 70_000}" for i in range(140_000))
    m = repetition.measure(pa.array(["a b", long, "c"]))
    assert m["n_words"].tolist() == [2, 140_000, 1] and m["longest_repeat"].tolist() == [0, 70_000, 0] and m["n_repeat_words"][1] == 140_000


def test_rules(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    quoted = " ".join([clean, "x", " ".join(f"w{i}" for i in range(30)), *(f"v{i}" for i in range(40))])  # 60 of 191 words repeat
    passage = " ".join(f"p{i}" for i in range(110))
    copied = passage + " " + " ".join(f"u{i}" for i in range(900)) + " " + passage
    little = " ".join(f"p{i}" for i in range(20)) + " " + " ".join(f"u{i}" for i in range(300)) + " " + " ".join(f"p{i}" for i in range(20))
    rows = [(1, clean, "c"), (2, "few words", None), (3, quoted, "c"), (4, copied, "c"), (5, little, "c"), (None, None, "c"), (1, clean, "c")]
    out = repetition.quality_rules(table(spark, rows, "doc_id long, text string, n_words string"))
    assert out.columns[:2] == ["doc_id", "text"] and "n_words" in out.columns
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, 120, False, True), (1, 120, False, True), (2, 2, True, False), (3, 191, True, False), (4, 1120, False, False), (5, 340, False, True), (None, 0, True, False)], key=str)
    assert repetition.quality_rules(table(spark, [], "doc_id long, text string")).count() == 0


def test_repeats_do_not_cross_texts():
    a = " ".join(f"w{i}" for i in range(50))
    assert repetition.measure(pa.array([a, a, a]))["n_repeat_words"].tolist() == [0, 0, 0]
    assert np.array_equal(repetition.longest_repeats(np.zeros(0, np.uint64), np.zeros(0, np.int64), 8), np.zeros(0))
