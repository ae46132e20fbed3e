"""Byte-level BPE encoding and decoding by tree reduction (operator 5).

The ids of a row of bytes form a monoid under ``join``. A row is encoded in halves; two neighbours are
joined by encoding anew a window of tokens about their boundary. A row of tokens is the encoding of its
bytes just if each pair of neighbours is the encoding of its own bytes. So when the window's first token
goes with the token before it, and its last with the one after it, all tokens outside the window stand,
and the join is done; until then the window grows on the side that doesn't fit. Decoding concatenates.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, texts

LEAF = 16  # bytes that are merged pair by pair
REMEMBERED = 200_000  # pieces

#: White space as the pattern's \s means it.
_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = "A-Za-z\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_NUMBERS = "0-9\\u00b2\\u00b3\\u00b9\\u00bc-\\u00be"


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: The pattern with its classes spelt out, and the same for texts of Latin letters, which a simpler engine splits.
        self.general = regex.compile(self._spelt(pattern, r"\p{L}", r"\p{N}"))
        self.latin = re.compile(self._spelt(pattern, _LATIN, _NUMBERS))
        self.other = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0\\u0250-\\U0010ffff]")

    @staticmethod
    def _spelt(pattern: str, letters: str, numbers: str) -> str:
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{letters}{numbers}]")
        return inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]").replace(r"?\p{L}", f"?[{letters}]").replace(r"?\p{N}", f"?[{numbers}]")

    # -------------------------------------------------------------- the monoid
    def merge(self, row: bytes) -> list[int]:
        """Encode a short row: merge the neighbours of lowest rank, leftmost first, as long as any merge."""
        ranks = self.ranks
        whole = ranks.get(row)
        if whole is not None:
            return [whole]
        parts = [row[i : i + 1] for i in range(len(row))]
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, 0
            for i, r in enumerate(found):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def goes_with(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from their own encodings."""
        if not left or not right:
            return left + right
        if self.goes_with(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[len(left) - i :]) + self.decode(right[:j]))
            fits_left = i == len(left) or self.goes_with(left[-i - 1], window[0])
            fits_right = j == len(right) or self.goes_with(window[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if fits_left else min(len(left), 2 * i)
            j = j if fits_right else min(len(right), 2 * j)

    def encode(self, row: bytes) -> list[int]:
        if len(row) <= LEAF:
            return self.merge(row)
        level = [self.merge(row[i : i + LEAF]) for i in range(0, len(row), LEAF)]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    # -------------------------------------------------------------- texts
    def text(self, text: str | None) -> bytes:
        """Ids of a text (None: empty) as little-endian unsigned 32-bit integers; each match of the pattern by itself."""
        if not text:
            return b""
        pieces = (self.general if self.other.search(text) else self.latin).findall(text)
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for piece in set(pieces):
            if piece not in known:
                known[piece] = older.get(piece) or array("I", self.encode(piece.encode())).tobytes()
        return b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file: base64 of a token's bytes and its rank, a line each."""
    with open(path, "rb") as file:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again.

    Null and empty texts have no tokens. Repeated rows and null ids are kept as they are; an empty table
    gives no rows; columns of the input but the two named are not read, whatever their names. One pass, no
    shuffle; what a task remembers is bounded, and a long run of letters or spaces takes time in
    proportion to its length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            _, offsets = texts(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                for text in batch.column(1).slice(i, j - i).to_pylist():
                    raw = bpe.text(text)
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(encode), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
