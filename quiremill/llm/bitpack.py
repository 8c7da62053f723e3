"""Token ids in fixed-width bit-packed files.

A shard holds whole documents. All integers are little-endian::

    8 bytes   magic "QMBITS1\\0"
    u32 u32   bits an id, ids a block (a multiple of 8, so that blocks are whole bytes)
    u64 u64   number of documents D, number of ids N
    i64 x D   document ids (the least value stands for a null id)
    u64 x D   where each document ends, in ids
    u64 x B+1 where each block begins, in bytes of the payload, and the payload's length
    payload   ids, lowest bit first, ``bits`` each

``bits`` is the least width that holds the vocabulary. A block unpacks with a few numpy calls, and any
range of ids is found through the block offsets without reading the rest.

At scale documents are dealt by ranges of their id, encoded by the tokenizers library, and written as
shards of about ``ids_per_shard`` ids into the one column of a Parquet table in the shared folder, so
that Spark's commit protocol covers retried and lost tasks. Totals a partition give each its first id.

Words are cut by the vocabulary's own pattern; the library encodes each distinct word once a worker, which remembers
recent ones in tables of bounded size through all its tasks.

Defined results: null and empty texts hold the end id alone; null ids sort first; rows with equal ids
are neighbours in any order; other columns are ignored; an empty table makes no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm import bpe
from quiremill.llm._common import default_vocabulary, sliced
from quiremill.operators.keep import shared_folder

_MAGIC, _HEAD, _NULL = b"QMBITS1\0", struct.Struct("<8sIIQQ"), -(2**63)


def width(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of ``data`` as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = flat
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def shard(doc_ids, documents, bits: int, block: int = 4096) -> bytes:
    """The bytes of a shard; ``documents`` are arrays of ids."""
    if block % 8:
        raise ValueError("a block must hold a multiple of 8 ids")
    ids = np.concatenate([np.empty(0, np.uint32), *documents]).astype(np.uint32)
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64) if len(documents) else np.empty(0, np.uint64)
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    begin = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    names = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(_MAGIC, bits, block, len(names), len(ids)), names.tobytes(), ends.astype("<u8").tobytes(), begin.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to a shard: bytes, or a memory map of a file."""

    def __init__(self, data):
        data = memoryview(data)
        magic, self.bits, self.block, docs, self.size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        blocks = -(-self.size // self.block)
        self._begin = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
        self._payload = data[at + 16 * docs + 8 * (blocks + 1) :]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` - 1; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        part = self._payload[self._begin[first] : self._begin[last + 1]]
        count = min(self.size, (last + 1) * self.block) - first * self.block
        return unpack(part, count, self.bits)[start - first * self.block : stop - first * self.block]

    def span(self, k: int) -> tuple[int, int]:
        return int(self.ends[k - 1]) if k else 0, int(self.ends[k])

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.span(k))


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_encoder(path: str):
    """text -> ids of the tokenizers library as little-endian unsigned 32-bit integers, each distinct word encoded once while remembered."""
    cutter, library = bpe.load(path), _library(path)
    tokenize, letters = library.model.tokenize, cutter.letters
    as_bytes = [struct.pack("<I", i) for i in range(cutter.size)]

    def one(word: str) -> bytes:
        return b"".join([as_bytes[t.id] for t in tokenize(letters(word))])

    words = cutter.memo(one, b"".join, 300_000)
    return lambda text: b"".join(cutter.values(text, words, as_bytes.__getitem__))


@lru_cache(maxsize=2)
def lasting_encoder(path: str):
    """``library_encoder`` with what it remembers, through all tasks of a worker."""
    return library_encoder(path)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, ids_per_shard: int = 1 << 20) -> DataFrame:
    """Write the shards and return the table of them: part, shard, first (its first id within the part), n_ids, data."""
    tokenizer = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, bits = lasting_encoder(tokenizer), width(bpe.load(tokenizer).size)
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0
        names, documents = [], []
        end = struct.pack("<I", end_id)

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([shard(names, documents, bits)], pa.binary())], ["part", "shard", "first", "n_ids", "data"])

        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + end, "<u4")
                if names and size + len(ids) > ids_per_shard:
                    yield full()
                    number, first, size, names, documents = number + 1, first + size, 0, [], []
                names.append(doc_id)
                documents.append(ids)
                size += len(ids)
        if names:
            yield full()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = dealt.mapInArrow(run, "part long, shard long, first long, n_ids long, data binary")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the shards alone."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition written
    at, begins = 0, []
    for r in totals:
        begins.append((r["part"], at))
        at += r["n"]
    begin = shards.sparkSession.createDataFrame(begins, "part long, begin long")
    placed = shards.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("first")).alias("start"), "data")

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, 1):
            s, start = Shard(b.column(1)[0].as_buffer()), b.column(0)[0].as_py()
            ids = s.ids(0, s.size).astype("<u4")
            begins = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(begins.tolist(), s.ends.tolist(), strict=True)]
            names = pa.array(np.ma.masked_array(s.doc_ids, s.doc_ids == _NULL)) if (s.doc_ids == _NULL).any() else pa.array(s.doc_ids)
            yield pa.RecordBatch.from_arrays([names, pa.array(begins + start), pa.array(s.ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Write all documents to shards in the shared folder and describe each from what is read back."""
    path = f"{shared_folder(docs.sparkSession)}/quiremill/token-ids-{uuid.uuid4().hex}"
    return read(write(docs, path, vocabulary, **options))
