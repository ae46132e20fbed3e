import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pipewright.llm import byte_bpe

from .helpers import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    own = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    chars = "aAbZ'sStTrReEvVlLdD  \t\n\n0129²½ªµßÀ×øɏĲŉÿ!?%_-.,;:<>|“ΣςİДж中文́  　\x85\x1c\x0b\r\U0001f642"
    out = [None, "", " ", "\n" * 500, " " * 700 + "x", "a" * 3000, "don't we'LL", "é" * 999, "<|endoftext|>"]
    out += ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(3000)]
    out += ["".join(rng.choice("abcdeinthrou") for _ in range(rng.randrange(20, 2000))) for _ in range(60)]
    return out


def test_ids_are_the_librarys(pair):
    own, library = pair
    for t in texts():
        raw = own.text(t)
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(t or "")
        assert own.decode(np.frombuffer(raw, "<u4").tolist()) == (t or "").encode()


def test_join_is_the_encoding(pair):
    """Wherever a row is cut, joining the halves' encodings gives the whole's."""
    own, _ = pair
    rng = random.Random(8)
    for _ in range(400):
        row = "".join(rng.choice(["the", "in", "ation", "a", "e", "éé", "zz", " "]) for _ in range(rng.randrange(1, 12))).encode()
        cut = rng.randrange(len(row) + 1)
        assert own.join(own.merge(row[:cut]), own.merge(row[cut:])) == own.merge(row)


def test_query(spark, pair):
    _, library = pair
    rows = [(k, t, "x") for k, t in enumerate(texts()[:200])] + [(None, "a b", "x"), (3, "dup", "x")]
    got = byte_bpe.bpe_round_trip(table(spark, rows, "doc_id long, text string, n_tokens string"), PATH, public_tokenizers.PATTERN).collect()

    def want(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((want(d, t) for d, t, _ in rows), key=str)
    assert byte_bpe.bpe_round_trip(table(spark, [], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0
