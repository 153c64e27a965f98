"""Token ids as wavelet matrices: one compressed succinct file per shard.

Documents are dealt into ranges of doc_id; each task encodes its range and cuts
it into shards of whole documents.  A shard's file holds, per bit of an id from
the highest down, the plane of bits in the order left by a stable partition on
the bits above: its rank directory, with the ones before each block, and the
plane itself in chunks that are compressed one by one.  So access, counting and
occurrence lookup read a few directory entries and open a few chunks (select
searches the directory); only reading all ids opens them all.  The files are the
binary column of a Parquet table in the shared folder, so the writer's commit
protocol covers lost tasks and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"NWM2"
#: Bits of a block, for which the rank directory has the count of ones before it.
BLOCK = 512
#: Bits of a chunk, which is compressed by itself.
CHUNK = 1 << 16
#: Chunks that a reader holds open.
OPEN = 64
#: Distinct cuts that a worker remembers: more than where other stages share the worker's memory.
REMEMBERED = 850_000
#: Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1 << 20


def pack(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids.

    Header, then per level its zeros and where its parts begin, then per level
    the rank directory, the chunks' ends, and the chunks.
    """
    ids = np.asarray(ids, np.uint32)
    width, n = max(1, int(ids.max()).bit_length()) if len(ids) else 1, len(ids)
    v = ids.astype(np.uint16) if width <= 16 else ids
    compress = zstandard.ZstdCompressor(level=1).compress
    table, parts, at = [], [], 16 + 32 * width
    for b in reversed(range(width)):
        bit = (v & v.dtype.type(1 << b)) != 0
        plane = np.packbits(bit, bitorder="little")
        ones = np.bitwise_count(np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)]).view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        chunks = [compress(plane[c : c + CHUNK // 8].tobytes()) for c in range(0, len(plane), CHUNK // 8)]
        ends = np.cumsum([len(c) for c in chunks], dtype=np.uint64)
        own = [ranks.astype("<u4").tobytes(), ends.astype("<u8").tobytes()]
        table.append(struct.pack("<QQQQ", n - int(ranks[-1]), at, at + len(own[0]), at + len(own[0]) + len(own[1])))
        parts += [*own, *chunks]
        at += len(own[0]) + len(own[1]) + (int(ends[-1]) if len(ends) else 0)
        if b:
            v = np.concatenate([np.compress(~bit, v), np.compress(bit, v)])
    return b"".join([MAGIC, struct.pack("<QI", n, width), *table, *parts])


class WaveletMatrix:
    """Access, counting and occurrence lookup in a file of ``pack``: each reads directory entries and opens the chunks it meets."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.data = data
        self.n, self.width = struct.unpack_from("<QI", data, 4)
        rows = [struct.unpack_from("<QQQQ", data, 16 + 32 * i) for i in range(self.width)]
        self.zeros, self.begin = [r[0] for r in rows], [r[3] for r in rows]
        self.ranks = [np.frombuffer(data, "<u4", (r[2] - r[1]) // 4, r[1]) for r in rows]
        self.ends = [np.frombuffer(data, "<u8", (r[3] - r[2]) // 8, r[2]) for r in rows]
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.opened = 0
        self._decompress = zstandard.ZstdDecompressor().decompress

    def _chunk(self, level: int, c: int) -> np.ndarray:
        a, b = int(self.ends[level][c - 1]) if c else 0, int(self.ends[level][c])
        self.opened += 1
        at = self.begin[level]
        return np.frombuffer(self._decompress(self.data[at + a : at + b], max_output_size=CHUNK // 8), np.uint8)

    def _bits(self, level: int, block: int) -> np.ndarray:
        """The bits of a block."""
        key = level, block * BLOCK // CHUNK
        if key not in self.held:
            if len(self.held) >= OPEN:
                self.held.pop(next(iter(self.held)))
            self.held[key] = self._chunk(*key)
        at = block * BLOCK % CHUNK // 8
        return np.unpackbits(self.held[key][at : at + BLOCK // 8], bitorder="little")

    def _rank1(self, level: int, pos: int) -> int:
        """Ones before a position."""
        block, rest = divmod(pos, BLOCK)
        return int(self.ranks[level][block]) + (int(self._bits(level, block)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of a kind."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level]), dtype=np.int64) * BLOCK - self.ranks[level]
        block = int(np.searchsorted(before[:-1], k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(level, block) == bit)[k - int(before[block])])

    def access(self, pos: int) -> int:
        """The id at a position."""
        if not 0 <= pos < self.n:
            raise IndexError(pos)
        value = 0
        for level in range(self.width):
            bit, ones = int(self._bits(level, pos // BLOCK)[pos % BLOCK]), self._rank1(level, pos)
            pos = self.zeros[level] + ones if bit else pos - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        """The rows below the last level of an id's occurrences before a position."""
        lo, hi = 0, upto
        for level in range(self.width):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of an id before a position (everywhere by default)."""
        if value < 0 or value >> self.width:
            return 0
        lo, hi = self._range(value, self.n if upto is None else upto)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        if value < 0 or value >> self.width:
            return -1
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in reversed(range(self.width)):  # back up, level by level
            bit = value >> (self.width - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def to_ids(self) -> np.ndarray:
        """All ids: the partitions undone from the lowest plane up."""
        v = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in reversed(range(self.width)):
            plane = np.concatenate([self._chunk(level, c) for c in range(len(self.ends[level]))]) if self.n else np.zeros(0, np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~bit)] = v[: self.zeros[level]]
            up[np.flatnonzero(bit)] = v[self.zeros[level] :] | v.dtype.type(1 << (self.width - 1 - level))
            v = up
        return v


SHARD = "part int, seq int, first_id long, n_ids long, doc_ids array<long>, lens array<long>, data binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes ``docs`` and writes the shard table to ``path``; returns it.

    Shards in the order of (part, seq) hold documents in ascending doc_id order
    (null first; rows that repeat a doc_id in the order of their texts).  Null
    text counts as empty and has the end id alone.  A document is never split;
    one longer than ``shard_ids`` has a shard of its own size, and a task holds a
    shard and a slice of texts.  Strings of special tokens in a text become those
    tokens, as the library does by default.  Other columns are ignored, whatever
    their names; an empty table gives no shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))

    def run(batches):
        part, seq, doc_ids, lens, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard():
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            columns = [[part], [seq], [doc_ids[0]], [len(ids)], [doc_ids], [lens], [pack(ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "seq", "first_id", "n_ids", "doc_ids", "lens", "data"])

        for batch in batches:
            for piece in common.slices(batch, "t", bpe.TEXTS):
                ids, own = bpe.encoder(vocabulary, None, REMEMBERED, True).encode(piece.column("t"))
                ids, own, names = np.insert(ids, np.cumsum(own), end_id).astype(np.uint32), own + 1, piece.column("doc_id").to_pylist()
                ends, at, used = np.cumsum(own), 0, 0
                while at < len(own):
                    to = min(len(own), int(np.searchsorted(ends, used + shard_ids - size)) + 1)  # the document that fills the shard
                    held.append(ids[used : ends[to - 1]])
                    doc_ids += names[at:to]
                    lens += own[at:to].tolist()
                    size += int(ends[to - 1]) - used
                    at, used = to, int(ends[to - 1])
                    if size >= shard_ids:
                        yield shard()
                        seq, doc_ids, lens, held, size = seq + 1, [], [], [], 0
        if doc_ids:
            yield shard()

    shards = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t").mapInArrow(run, SHARD)
    shards.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(SHARD).parquet(path)


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files alone.

    ``start`` counts the ids of all documents before; a document without words
    has its end id, and rows that repeat a doc_id are rows of their own.  No
    shards give no rows.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, at, out = WaveletMatrix(row["data"]).to_ids().astype("<u4"), 0, []
                for n in row["lens"]:
                    out.append((at, n, zlib.crc32(data[at : at + n].tobytes())))
                    at += n
                k = len(out)
                yield pa.record_batch(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["seq"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3))],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    # Sums of the partitions first (a row each), then of the shards within a partition.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = totals.select("part", (F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")).alias("base"))
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = shards.select("part", "seq", "n_ids").join(parts, "part").select("part", "seq", (F.col("base") + F.sum("n_ids").over(order) - F.col("n_ids")).alias("before"))
    rows = shards.select("part", "seq", "doc_ids", "lens", "data").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
