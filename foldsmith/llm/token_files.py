"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldsmith.llm.common import map_batches, slices, write_table
from foldsmith.storage import scratch_path

# lengths of the four values that a control byte describes, two bits each, least significant first
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
# byte-level vocabularies write a byte as a printable character: itself, or the next one free from 256 on
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = "".join(chr(b) if b in PRINTABLE else chr(256 + b - sum(p < b for p in PRINTABLE)) for b in range(256))
LETTERS = re.compile("[A-Za-z\u00c0-\u024f]+")
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PROBE = "The probe: été Übung, naïve isn't 3,5 x... (WORD)*** a%-b end;"


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values: 1 to 4 bytes each, a control byte for every four."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back; lengths come from one table lookup of all control bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for i in range(1, 4):
        longer = np.flatnonzero(size > i)
        out[longer] |= raw[start[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class WordIds(dict):
    """Ids of words as bytes, learnt when a word is first asked for and kept in two generations of at most ``limit`` words.

    A full generation becomes the older one and a new one begins, so memory is bounded and frequent words stay.
    """

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype, limit: int) -> None:
        super().__init__()
        self.tokenizer, self.dtype, self.limit, self.old = tokenizer, dtype, limit, {}
        # each look at ``tokenizer.model`` and at ``dtype.char`` makes an object anew
        self.merge, self.code = tokenizer.model.tokenize, dtype.char
        self.by_letter = True
        self.by_letter = all(self.learn(w.encode()) == self.library(w) for w in PROBE.split())
        self.clear()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def merged(self, stem: bytes) -> bytes:
        text = stem.decode() if stem.isascii() else charmap_decode(stem, "strict", BYTE_CHARS)[0]  # ASCII letters are written as they are
        return array(self.code, [t.id for t in self.merge(text)]).tobytes()

    def learn(self, word: bytes) -> bytes:
        """A word of Latin letters goes to the library's merge model in lower case, and the marks that follow it are a
        word of their own; anything else is encoded by the library as it is."""
        stem, small = word.rstrip(MARKS), None
        if stem.isalpha():
            small = stem.lower()
        elif stem and not stem.isascii():
            text = stem.decode("utf-8", "replace")
            if LETTERS.fullmatch(text) and text.isalpha() and text.lower().isalpha():
                small = text.lower().encode()
        if small is None or not self.by_letter:
            return self.library(word.decode("utf-8", "replace"))
        if len(stem) < len(word):
            return self[small] + self[word[len(stem):]]
        return self.merged(small) if small == word else self[small]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, one distinct word at a time.

    Where a vocabulary's splitting pattern never joins characters across white space, a text's ids are its words' ids in
    order. That is probed on the vocabulary at hand; one that doesn't work that way gets whole texts.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = WordIds(self.tokenizer, self.dtype, limit)
        self.by_word = self.known.library(PROBE) == b"".join(map(self.known.library, PROBE.split()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of every text as bytes; null and blank texts have none."""
        if not self.by_word:
            return [self.known.library(t or "") for t in texts]
        ids = self.known.__getitem__
        return [b"".join(map(ids, t.encode("utf-8", "surrogatepass").split())) if t else b"" for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, so its known words serve later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n, h): the ids of every whole text and the end id, little-endian; h orders texts of equal doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        for part in slices(batches, 128):
            ids = [row + end for row in words.encode(part.column(1).to_pylist())]
            count = [len(row) // words.dtype.itemsize for row in ids]
            hashes = [zlib.crc32(row) for row in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(count, pa.int64()),
                                              pa.array(hashes, pa.int64())], names=["doc_id", "ids", "n", "h"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(map_batches, run, f"doc_id {kind}, ids binary, n long, h long")


def codebook(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, n) of every id that occurs; each task sends one row per id it saw, at most as many as the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in slices(batches, 1024):
            for row in part.column(0):
                seen = np.bincount(np.frombuffer(row.as_buffer(), dtype))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[:len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").transform(map_batches, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, part_tokens: int = 1 << 23,
                      block_tokens: int = 1 << 18) -> None:
    """Write token files of ``documents`` (doc_id, text) below ``folder``, in ascending doc_id order.

    ``folder``/codebook has (id, rank, n): the most frequent id is rank 0 (ties: the smaller id). ``folder``/blocks has rows
    (part, block, first, doc_ids, counts, control, data): runs of whole documents of about ``block_tokens`` ids, ranks in one
    to four bytes with their lengths in separate control bytes; ``first`` is the number of ids before the block in
    its part. Parts ascend with doc_id and within a part blocks do. Rows are range-partitioned by doc_id and a hash of the ids, so
    repeated doc_ids spread too; rows of one doc_id follow each other in that hash's order. A null doc_id comes first; a
    null text is the end id alone. The code table is bounded by the vocabulary, so it is sent to the tasks whole.
    """
    spark = documents.sparkSession
    dtype = np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")
    tokens = write_table(tokenize(documents, tokenizer, end_id), "ids")
    counted = sorted(((-r["n"], r["id"]) for r in codebook(tokens, dtype).collect()))
    ranked = [(i, k, -n) for k, (n, i) in enumerate(counted)]
    spark.createDataFrame(ranked, "id long, rank long, n long").coalesce(1).write.parquet(f"{folder}/codebook")
    rank = np.zeros(max((i for i, _, _ in ranked), default=0) + 1, np.uint32)
    rank[[i for i, _, _ in ranked]] = [k for _, k, _ in ranked]
    parts = max(1, -(-sum(n for _, _, n in ranked) // part_tokens))
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, held, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            control, data = encode_values(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(kind_pa)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "block", "first", "doc_ids", "counts", "control", "data"])

        kind_pa = None
        for piece in slices(batches, 64):
            kind_pa = piece.column(0).type
            for doc, row in zip(piece.column(0).to_pylist(), piece.column(1)):
                values = rank[np.frombuffer(row.as_buffer(), dtype)]
                ids.append(doc)
                counts.append(len(values))
                held.append(values)
                size += len(values)
                if size >= block_tokens:
                    yield packed()
                    block, first = block + 1, first + size
                    ids, counts, held, size = [], [], [], 0
        if ids:
            yield packed()

    (tokens.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
     .transform(map_batches, run, f"part int, block int, first long, doc_ids array<{kind.simpleString()}>, counts array<long>, control binary, data binary")
     .write.parquet(f"{folder}/blocks"))


def read_token_files(spark, folder: str, doc_id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from token files; ids are the token ids as little-endian unsigned 32-bit bytes.

    ``start`` is the number of ids of all documents before it: a table with one row per part shifts the places within
    parts.
    """
    ranks = [r["id"] for r in spark.read.schema("id long, rank long, n long").parquet(f"{folder}/codebook").orderBy("rank").collect()]
    table = np.array(ranks or [0], "<u4")
    schema = (f"part int, block int, first long, doc_ids array<{doc_id_type}>, counts array<long>, control binary, data binary")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            part, _, first, ids, counts, control, data = (c[0].as_py() for c in one.columns)
            values = table[decode_values(control, data, sum(counts))]
            ends = np.cumsum(counts)
            rows = [values[e - n:e].tobytes() for n, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(ids, one.column(3).type.value_type), pa.array(first + ends - counts),
                 pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["part", "doc_id", "at", "n_tokens", "ids"])

    rows = blocks.transform(map_batches, run, f"part int, doc_id {doc_id_type}, at long, n_tokens long, ids binary")
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = write_table(sizes.select("part", F.expr("sum(n) OVER (ORDER BY part) - n").alias("before")), "parts")
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_digests(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``documents``, written as token files and read back from them.

    A null or empty text is the end id alone. Rows without doc_id come first, rows of one id in the order of their ids' hash, repeated
    rows each for themselves. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    folder = scratch_path(spark, "tokens")
    write_token_files(documents, folder, tokenizer, end_id)
    rows = read_token_files(spark, folder, documents.schema["doc_id"].dataType.simpleString())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
