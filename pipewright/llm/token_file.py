"""Token ids and a binary file format with random access to every token (operator 3).

Format (directly addressable codes). An id is cut into bytes, lowest first. Level 0 holds the first
byte of every id in order; level k + 1 holds the next byte of just those ids that have one. Beside
each level but the last stands a bitmap of the ids that continue, and a rank directory: the number of
set bits before every 512th bit. The place of token i on the next level is rank(i), so any token is
read with one look-up per level and no block is decoded. Layout of a shard, little-endian:

    magic 8 bytes | for each level: bytes, bitmap, directory (uint64) | doc ids (int64) |
    token offsets (int64, one more than documents) | sections (int64 pairs: place, length) |
    footer: place of sections, levels, documents, tokens (4 x int64)
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, lean, lower_ascii, new_folder, open_fs, partitions, slices, texts, word_hashes, words

MAGIC = b"PWDAC\x00\x00\x01"
BLOCK = 512
SHARD_TOKENS = 16 << 20  # tokens after which a task begins a new shard
NO_ID = -(1 << 63)  # stands for a null id


# ------------------------------------------------------------------ encoding
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


class WordEncoder:
    """Encodes whole texts with a tokenizer file that composes and lower-cases characters, drops white
    space and splits what is left into endings after an apostrophe, letters, single numbers and the rest.

    Nothing is joined across those pieces, so a text's ids are those of its pieces in order. In texts of
    Latin letters the pieces are found here. The white-space-free chunks of some megabytes of text are
    told apart by 64-bit hashes of their bytes; each new one is cut into pieces, and new pieces are encoded
    once, many in one call, parted again by the word end that each has. Other texts go to the tokenizer
    whole. About ``most`` chunks are remembered: when half as many are new, those not used since go.
    """

    #: Texts that are encoded whole: odd white space, special tokens, characters that fold in other ways.
    WHOLE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u0130\u0149\u01f0\u0250-\U0010ffff]|<\\|")
    PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, names: list[int], chunks: list[str]) -> None:
        split = [[c] if c.isalpha() else self.PIECE.findall(c) for c in chunks]
        pieces = list({p for ps in split for p in ps})
        lines = [" ".join(pieces[i : i + 1000]) for i in range(0, len(pieces), 1000)]
        ids = np.array([x for e in self.pieces.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(pieces):
            raise ValueError("this tokenizer file doesn't end its pieces with word ends")
        of = {p: raw[i:j] for p, i, j in zip(pieces, [0, *ends], ends, strict=False)}
        self.known.update({n: of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for n, ps in zip(names, split, strict=True)})

    def _ids_of(self, hashes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        names = hashes.tolist()
        values = list(map(self.known.get, names))
        gone = [k for k, v in enumerate(values) if v is None]
        if not gone:
            return values
        older = list(map(self.older.get, [names[k] for k in gone]))
        self.known.update({names[k]: v for k, v in zip(gone, older, strict=True) if v is not None})
        new = [k for k, v in zip(gone, older, strict=True) if v is None]
        if new:
            self._learn([names[k] for k in new], [data[i:j].decode().lower() for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        for k, v in zip(gone, map(self.known.get, [names[k] for k in gone]), strict=True):
            values[k] = v
        return values

    def column(self, column: pa.Array, end: int | None = None, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text of a column (null: empty), with the end id after them if given."""
        data, offsets = texts(column)
        tail = np.array([] if end is None else [end], "<u4")
        for i, j in slices(offsets, most):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = own.tobytes()
            doubt = np.unique(np.searchsorted(at, np.flatnonzero(_DOUBT[own]), "right") - 1).tolist()
            whole = {k: text for k in doubt if self.WHOLE.search(text := raw[at[k] : at[k + 1]].decode())}
            starts, ends, first = words(own, at)
            if whole:
                use = np.ones(len(starts), bool)
                for k in whole:
                    use[first[k] : first[k + 1]] = False
                first = np.concatenate([[0], np.cumsum(use)])[first]
                starts, ends = starts[use], ends[use]
            hashes, one, which = np.unique(word_hashes(lower_ascii(own), starts, ends), return_index=True, return_inverse=True)
            values = self._ids_of(hashes, raw, starts[one], ends[one])
            flat = np.frombuffer(b"".join(values), "<u4")
            length = np.fromiter(map(len, values), np.int64, len(values)) // 4
            count, place = length[which], (np.cumsum(length) - length)[which]
            after = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.repeat(place - after[:-1], count) + np.arange(after[-1])]
            cuts = after[first].tolist()
            for k in range(j - i):
                got = ids[cuts[k] : cuts[k + 1]] if k not in whole else np.array(self.tokenizer.encode(whole[k], add_special_tokens=False).ids, "<u4")
                yield i + k, np.concatenate([got, tail])


#: Bytes of characters that may make a text one that is encoded whole.
_DOUBT = np.zeros(256, bool)
_DOUBT[[*range(9), *range(14, 32), 0x3C, 0x7F, 0xC2, 0xC4, 0xC5, 0xC7, *range(0xC9, 256)]] = True


@large
@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ------------------------------------------------------------------ the codes
def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(bytes, bitmap, directory) of each level; the last level has no bitmap."""
    levels, rest = [], ids.astype("<u4")
    while True:
        low, high = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(8)
        goes_on = high > 0
        if not goes_on.any():
            levels.append((low.tobytes(), b"", b""))
            return levels
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.int64)
        levels.append((low.tobytes(), bits.tobytes(), np.concatenate([[0], np.cumsum(per_block)]).astype("<u8").tobytes()))
        rest = high[goes_on]


def write_shard(out, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> None:
    """Write one shard to a binary stream."""
    place, sections = 0, []

    def put(raw: bytes) -> None:
        nonlocal place
        sections.append((place, len(raw)))
        out.write(raw)
        place += len(raw)

    levels = pack(ids)
    put(MAGIC)
    for level in levels:
        for raw in level:
            put(raw)
    put(np.array(doc_ids, "<i8").tobytes())
    put(np.concatenate([[0], np.cumsum(np.array(counts, "<i8"))]).astype("<i8").tobytes())
    at = place
    out.write(np.array(sections, "<i8").tobytes())
    out.write(struct.pack("<4q", at, len(levels), len(doc_ids), len(ids)))


class Shard:
    """Random access to the tokens of a shard; reads only footer, directories and the ranges asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, levels, self.documents, self.tokens = struct.unpack("<4q", self._read(size - 32, 32))
        sections = np.frombuffer(self._read(at, size - 32 - at), "<i8").reshape(-1, 2)
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        self.levels = sections[1 : 1 + 3 * levels].reshape(levels, 3, 2)
        self.doc_ids = np.frombuffer(self._read(*sections[-2]), "<i8")
        self.offsets = np.frombuffer(self._read(*sections[-1]), "<i8")
        self.reached: dict[int, tuple[int, int]] = {}  # of each level the bit behind the last range, and its rank
        self.directories = [np.frombuffer(self._read(*x[2]), "<u8") for x in self.levels]

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(int(n), int(at)) if n else b""

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap: a directory entry and less than a block of bits."""
        if self.reached.get(level, (-1, 0))[0] == i:
            return self.reached[level][1]
        block = i // BLOCK
        first, place = block * BLOCK, self.levels[level][1][0]
        bits = np.unpackbits(np.frombuffer(self._read(place + first // 8, (i - first + 7) // 8), np.uint8), count=i - first, bitorder="little")
        return int(self.directories[level][block]) + int(bits.sum())

    def range(self, first: int, after: int, level: int = 0) -> np.ndarray:
        """Ids of tokens first .. after - 1, wherever they lie."""
        n, (place, _), (bitmap, length) = after - first, self.levels[level][0], self.levels[level][1]
        ids = np.frombuffer(self._read(place + first, n), np.uint8).astype("<u4")
        if n and length:
            skip = first % 8
            bits = np.unpackbits(np.frombuffer(self._read(bitmap + first // 8, (skip + n + 7) // 8), np.uint8), bitorder="little")[skip : skip + n].view(bool)
            at, many = self._rank(level, first), int(np.count_nonzero(bits))
            self.reached[level] = (after, at + many)
            if many:
                ids[bits] |= self.range(at, at + many, level + 1) << np.uint32(8)
        return ids

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.offsets[k]), int(self.offsets[k + 1]))


# ------------------------------------------------------------------ distributed write and read
def write_token_files(docs: DataFrame, tokenizer: str, end: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode all documents and write shards in ascending id order; one row per shard (shard, path, documents, tokens).

    Rows are dealt by range of id and sorted inside each task, so a hot source plays no part. Each
    attempt of a task writes files of its own, and only those of the attempt that succeeds are listed. Null text is
    empty; rows with a repeated id stay, in unspecified order among themselves; null ids come first.
    An empty table gives no shards. Other columns are not read.
    """
    encode_path, uri = tokenizer, folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, ids, doc_ids, counts, n = word_encoder(encode_path), [], [], [], 0
        part, step, filesystem, root = TaskContext.get().partitionId(), 0, *open_fs(uri)

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, counts, n, step
            path = f"{root}/part-{part:06d}-{step:04d}-{uuid.uuid4().hex}.dac"
            with filesystem.open_output_stream(path) as out:
                write_shard(out, doc_ids, counts, np.concatenate(ids))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([part * 10_000 + step], pa.int64()), "path": [path], "documents": pa.array([len(doc_ids)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64())})
            ids, doc_ids, counts, n, step = [], [], [], 0, step + 1
            return row

        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_pylist()
            for row, got in encoder.column(batch.column(1), end):
                ids.append(got)
                doc_ids.append(names[row])
                counts.append(len(got))
                n += len(got)
                if n >= SHARD_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    filesystem, root = open_fs(folder)
    filesystem.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(lean(write, word_encoder), "shard long, path string, documents long, tokens long")


def read_token_files(spark, manifest: list, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards.

    ``manifest`` has a row per shard, in memory on the driver: some bytes for each task or 16 million
    tokens. The shards' first token numbers follow from it.
    """
    rows, start = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        rows.append((r["path"], start))
        start += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_fs(folder)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with filesystem.open_input_file(path) as file:
                    shard = Shard(file)
                    crc = [zlib.crc32(shard.document(k).tobytes()) for k in range(shard.documents)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(shard.offsets[:-1] + base), pa.array(np.diff(shard.offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int, **columns) -> DataFrame:
    """Write the token files of all documents, then read every document back from them.

    (doc_id, start, n_tokens, ids_crc32) in ascending doc_id order, null ids first; repeated documents stand
    as often as they do in the table. Null and empty texts have the end id alone; an empty table gives no
    rows; columns beside id and text are not read. A chunk of text whose tokens a task remembers is known
    by a 64-bit hash.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, tokenizer, end, folder, **columns).collect()
    return read_token_files(docs.sparkSession, manifest, folder)
