import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pipewright.llm import token_file

from .helpers import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_file.WordEncoder(PATH, most=50)


class Buffer:
    def __init__(self, raw):
        self.raw, self.reads = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.reads += n
        return self.raw[at : at + n]


@pytest.mark.parametrize("top", [1, 200, 60_000, 2**32 - 1])
def test_any_token(top):
    rng = random.Random(top)
    docs = [[rng.randrange(top) for _ in range(rng.choice([0, 1, 7, 600, 3000]))] for _ in range(30)]
    ids, out = np.array([x for d in docs for x in d], "<u4"), io.BytesIO()
    token_file.write_shard(out, list(range(30)), [len(d) for d in docs], ids)
    shard = token_file.Shard(Buffer(out.getvalue()))
    assert [shard.document(k).tolist() for k in range(30)] == docs
    shard.file.reads = 0
    for _ in range(200):
        i = rng.randrange(len(ids))
        assert shard.range(i, i + 1).tolist() == [ids[i]]
    assert shard.file.reads < 200 * 4 * 70  # a token costs less than a block of bits on each level
    with pytest.raises(ValueError):
        token_file.Shard(Buffer(b"x" * 8 + out.getvalue()[8:]))


def test_encoder_is_the_tokenizer(encoder):
    rng = random.Random(2)
    chars = "aAbZ'sStTrReEvVlLdD  \t\n0129²½¼ªºµßÀÖ×÷øɏĲŉǰÿŸ!?%_-.,;:<>|“ΣσςİıДж中文́­  \x85\x1c\x00\U0001f642"
    texts = ["", None, "<|endoftext|> x", "don't I'll X'S", "x" * 5000, "é" * 300] + ["".join(rng.choice(chars) for _ in range(rng.randrange(50))) for _ in range(2000)]
    for k, ids in encoder.column(pa.array(texts, pa.string()), 2):
        assert ids.tolist() == [*encoder.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]


def test_files(spark, encoder):
    rows = [(k * 7 % 50 - 5, f"Text number {k}. " * k, "x") for k in range(50)] + [(100, None, "x"), (101, "", "x"), (None, "lost id", "x"), (7, "again", "x")]
    got = token_file.token_files(table(spark, rows, "doc_id long, text string, start string"), PATH, 2).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text, _ in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids) and ordered[0].doc_id is None
    assert token_file.token_files(table(spark, [], "doc_id long, text string"), PATH, 2).collect() == []
