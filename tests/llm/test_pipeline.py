"""The pipeline against the same stages in plain Python."""

import random

import public_tokenizers

import corpus_pipeline
from pipewright.llm import pii
from pipewright.llm.queries import PII_KEY

from .helpers import WORDS, table
from .test_op2_repetition import brute as measures
from .test_op10_ngram_join import brute as groups
from .test_op10_ngram_join import family


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "pii_surrogates", "best_fit_packing"]


def test_against_python(spark, tmp_path):
    rng = random.Random(11)
    texts = [t for size in (24, 60, 150) for t in family(rng, 6, size, 2)] + [" ".join(f"{rng.choice(WORDS)}{k}" for k in range(n)) for n in (5, 19, 20, 30, 300)]
    texts += [None, "", "spam words " * 40, texts[-1] + " mail a.12@mail3.example.com or 1.2.3.4", "x " * 10]
    rows = [(k * 3, t, "en", "src", len(t or "")) for k, t in enumerate(texts)] + [(None, texts[20], "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table(spark, rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def passes(text):
        n, *_, repeat, covered, longest = measures(text)
        return n >= 20 and 100 * repeat <= 30 * n and 100 * covered <= 20 * n and longest <= 100

    kept = [r for r in rows if passes(r[1])]
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str)
    copies = {d for d, _, c in groups([r[:2] for r in kept]) if d is not None and d != c}
    kept = [r for r in kept if r[0] not in copies]
    out = corpus_pipeline.near_duplicates(spark, out, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str)
    out = corpus_pipeline.personal_data(spark, out, str(tmp_path))
    want = [(d, pii.replace(t, PII_KEY)[0], a, b, len(pii.replace(t, PII_KEY)[0])) for d, t, a, b, _ in kept]
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert not any("mail3.example" in r[1] for r in want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in want} and public_tokenizers
    assert sum(r.length for r in packed) == sum(r.length for r in corpus_pipeline.pack(spark, out, str(tmp_path)).collect())


def test_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (1, long), (1, long + " and a quite different text " + " ".join(f"v{k}" for k in range(90))), (None, long), (None, long)]
    out = corpus_pipeline.near_duplicates(spark, table(spark, rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_empty(spark, tmp_path):
    table(spark, [], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
