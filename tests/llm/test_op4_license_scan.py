import random
import re
import time

from pyspark.sql import functions as F

from pipewright.llm import license_scan
from pipewright.llm.license_rules import NOTICES, ROOTS, RULES

from .helpers import LOWER, table

TEXTS = [
    None, "", "  ", "No notice here at all.", "Licensed under CC BY-NC 4.0.", "cc by cc by, CC-BY", "Released under the MIT License.\nAll rights reserved.",
    "GNU General Public License, version 3 or later; GNU General Public License version 2", "SPDX-License-Identifier: Apache-2.0 and Apache License, Version 2.0",
    "general public license general public license all rights reserved all rights reserved", "É licence MIT — the MIT licence; TOUS DROITS RÉSERVÉS tous droits réservés",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "(c) Copyright 2021 Acme. All Rights Reserved.", "x " * 3000 + "mozilla public license 2.0", "accby ccby all rights  reserved.", "may not be copied without the written permission of us; public domain",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    spaced = "".join(f" {w} " for w in words)
    starts, base = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    found = []
    for rank, (label, priority, keyword, rx) in enumerate(RULES):
        if keyword in spaced:
            found += [(m.start() and spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, priority, -rank, label) for m in re.finditer(rx, spaced)]
    left = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2], e[1] - e[0], e[3]) > (d[2], d[1] - d[0], d[3]) for e in found)]
    score = max([d[2] / 100 for d in left] + [0.5 if base else 0.0])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in left})), score)


def test_against_python(spark):
    rows = [(k, t, "old") for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], "old"), (4, TEXTS[4], "old")]
    out = license_scan.scan_licenses(table(spark, rows, "doc_id long, text string, labels string"))
    assert out.columns.count("labels") == 1
    got = [(r.doc_id, r.text, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in out.collect()]
    for _, text, result in got:
        assert result == brute(text), text
    assert len(got) == len(rows)
    assert license_scan.scan_licenses(table(spark, [], "doc_id long, text string")).count() == 0


def test_plan_is_one_projection(spark):
    plan = license_scan.scan_licenses(table(spark, [(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def test_rules_are_sound():
    assert len(RULES) >= 200
    for line in NOTICES.strip().splitlines():
        assert re.fullmatch(r"\S+ \d+ \S+: \S.*", line), line
        head, _, pattern = line.partition(": ")
        fixed = [w for w in pattern.split() if w[-1] != "?" and w[0] != "@"]
        # Each match holds the rule's keyword and one of the roots.
        for needed in ([head.split()[2]], ROOTS):
            assert any(all(n in f" {s} " for s in w.strip("()").split("|")) for n in needed for w in fixed), line
    for _, priority, _, rx in RULES:
        re.compile(rx)
        assert 0 < priority <= 100


def test_long_notices_have_their_labels(spark):
    gnu = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    notices = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
        "bsd-4-clause": "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        "bsd-3-clause": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "gpl-2.0-or-later": "under the terms of the GNU General Public License " + gnu.format("2"),
        "lgpl-2.1-or-later": "under the terms of the GNU Lesser General Public License " + gnu.format("2.1"),
        "agpl-3.0-or-later": "under the terms of the GNU Affero General Public License " + gnu.format("3"),
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "zlib": "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "json": "The Software shall be used for Good, not Evil.",
    }
    rows = list(notices.items()) + [("bsd-3-clause", "Neither the names of Acme nor the names of its contributors may be used to endorse or promote products")]
    got = license_scan.scan_licenses(table(spark, rows, "label string, text string")).collect()
    assert [r.label for r in got if r.label not in r.labels.split(",")] == []


def test_many_detections_in_a_text(spark):
    """Thousands of notices in a text take time in proportion, and rules inside others go as they do one by one."""
    rng = random.Random(2)
    notices = ["mit license", "licensed under the apache license version 2 0", "gnu general public license version 2 or later", "all rights reserved", "cc by sa 4 0", "spdx license identifier gpl 3 0 only", "mozilla public license 2 0"]
    texts = [" and ".join(rng.choice(notices) + rng.choice(["", " x", ", "]) for _ in range(n)) for n in (1, 2, 3, 63, 64, 65, 130, 700)]
    rows = list(enumerate(texts))
    for r in license_scan.scan_licenses(table(spark, rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(texts[r.doc_id])
    long = [(0, " and ".join(f"{rng.choice(notices)} {k}" for k in range(8000)))]
    began = time.perf_counter()
    [r] = license_scan.scan_licenses(table(spark, long, "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 20 and r.n_base > 1000 and "mit" in r.labels.split(",")


def test_starts_of_many_places(spark):
    numbers = [[], [3], list(range(64)), list(range(65)), [5] * 500]
    got = table(spark, [(x,) for x in numbers], "x array<int>").select("x", license_scan._running(F.col("x")).alias("sums")).collect()
    assert all(r.sums == [sum(r.x[:k]) for k in range(len(r.x))] for r in got)
