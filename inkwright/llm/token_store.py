"""Operator 5, token ids in binary segments with Elias-Fano document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import content_hash, materialize, utf8_size
from .ranges import plan_ranges

MAGIC = b"IWTS2\0"
HEADER = struct.Struct("<6sBBQQQ")
#: One position is kept of so many set bits, in 32 bits; select scans no further.
STRIDE = 256
#: Bytes of text in a range, of ids in a segment.
RANGE_BYTES = 256 << 20
SEGMENT_BYTES = 64 << 20
#: Ranges whose ids are summed together, and segments up to which their bases are broadcast.
BLOCK, BROADCAST = 1024, 1 << 20


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        shift = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        if n and at[-1] >= 1 << 32:
            raise ValueError("too many values for one sequence")
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), at[::STRIDE].astype("<u4"))

    def select(self, k: int) -> np.ndarray:
        """Values k to k + STRIDE - 1 (fewer at the end); k is a multiple of STRIDE."""
        first = int(self.samples[k // STRIDE])
        last = int(self.samples[k // STRIDE + 1]) if k // STRIDE + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[first // 8 : (last + 7) // 8], bitorder="little")
        at = np.flatnonzero(bits[first % 8 :])[: min(STRIDE, self.n - k)] + first
        rows = np.arange(k, k + len(at))
        return ((at - rows).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(k, len(at))

    def value(self, i: int) -> int:
        return int(self.select(i - i % STRIDE)[i % STRIDE])

    def _low(self, k: int, n: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(n, np.uint64)
        a, b = k * self.low_bits, (k + n) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return (bits.reshape(n, -1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        return np.concatenate([self.select(k) for k in range(0, self.n, STRIDE)]) if self.n else np.zeros(0, np.uint64)


def write_segment(ids: bytes, ends: list[int], width: int) -> bytes:
    """A segment: header, select samples, high bits, low bits, ids. ends: of the documents, in ids."""
    ef = EliasFano.build(np.array(ends, np.uint64))
    return b"".join([HEADER.pack(MAGIC, width, ef.low_bits, ef.n, len(ids) // width, len(ef.high)), ef.samples.tobytes(), ef.high.tobytes(), ef.low.tobytes(), ids])


def read_segment(blob: bytes) -> tuple[EliasFano, np.ndarray]:
    magic, width, low_bits, n, n_ids, n_high = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEADER.size
    samples = np.frombuffer(blob, "<u4", -(-n // STRIDE), at)
    at += samples.nbytes
    high = np.frombuffer(blob, np.uint8, n_high, at)
    at += n_high
    low = np.frombuffer(blob, np.uint8, -(-n * low_bits // 8), at)
    at += low.nbytes
    return EliasFano(n, low_bits, low, high, samples), np.frombuffer(blob, f"<u{width}", n_ids, at)


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, and write segments in ascending order of the key.

    Returns the written table: range, part (their order is the order of the ids), keys (of the
    documents, in order), n_ids, segment (binary). Ranges are cut by size-weighted samples, so one
    task holds a range of text at most, or one document that is larger. Null text is empty and
    gives the end id alone. Null keys come first; rows of one key are ordered by a hash of the row,
    then by place. An empty table gives no segments. Other columns play no part.
    """
    keyed = df.select(F.col(key).alias("key"), F.col(text).alias("text"), utf8_size(text).alias("size"), content_hash(df).alias("h"), F.monotonically_increasing_id().alias("i"))
    order = ["key", "h", "i"]
    slim = materialize(keyed.select(*order, "size"), "token-keys")
    plan = plan_ranges(slim, order, "size", range_bytes, min_ranges=96)
    kind = dict(keyed.dtypes)["key"]
    rows = keyed.withColumn("range", plan.range_id()).repartition("range").sortWithinPartitions("range", *order).select("range", "key", "text")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import Encoder

        encoder, at, part, size = Encoder(tokenizer, end_id), None, 0, 0
        end = encoder.pack([end_id])
        keys: list = []
        ids: list[bytes] = []
        ends: list[int] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([keys], pa.list_(key_type)), pa.array([size // encoder.width], pa.int64()), pa.array([write_segment(b"".join(ids), ends, encoder.width)], pa.binary())], ["range", "part", "keys", "n_ids", "segment"])
            keys.clear(), ids.clear(), ends.clear()
            return batch

        for batch in batches:
            key_type = batch.column(1).type
            for r, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and (r != at or size >= SEGMENT_BYTES):
                    yield flush()
                    part, size = (part + 1 if r == at else 0), 0
                at = r
                one = encoder.encode(t) + end
                size += len(one)
                keys.append(k)
                ids.append(one)
                ends.append(size // encoder.width)
        if keys:
            yield flush()

    return materialize(rows.mapInArrow(encode, f"range int, part int, keys array<{kind}>, n_ids bigint, segment binary"), "token-segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Read segments back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary, as stored).

    One row for each document that was written, in whatever order the segments come; ties and
    repeated keys keep the order they were written in. No segments: no rows.
    """
    kind = dict(segments.dtypes)["keys"][len("array<") : -1]
    # ids before each segment: sums within blocks of ranges, then over the blocks
    sizes = segments.select("range", "part", "n_ids").withColumn("block", F.floor(F.col("range") / BLOCK))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = sizes.withColumn("inner", before(W.partitionBy("block").orderBy("range", "part"), "n_ids"))
    blocks = sizes.groupBy("block").agg(F.sum("n_ids").alias("n")).withColumn("outer", before(W.partitionBy(F.lit(0)).orderBy("block"), "n")).drop("n")
    bases = inner.join(blocks, "block").select("range", "part", (F.col("inner") + F.col("outer")).alias("base"))
    # a row of 24 bytes for each segment of many megabytes; beyond the bound the join is Spark's to plan
    small = segments.count() <= BROADCAST
    based = segments.join(F.broadcast(bases) if small else bases, ["range", "part"])

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for keys, base, blob in zip(batch.column(0), batch.column(1), batch.column(2)):
                bounds, ids = read_segment(blob.as_py())
                keys, base = keys.values, base.as_py()
                for k in range(0, bounds.n, STRIDE):
                    ends = bounds.select(k).astype(np.int64)
                    starts = np.concatenate([[bounds.value(k - 1) if k else 0], ends[:-1]])
                    yield pa.RecordBatch.from_arrays([keys[k : k + len(ends)], pa.array(starts + base), pa.array(ends - starts), pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return based.select("keys", "base", "segment").mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
