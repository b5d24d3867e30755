"""Operator 7, packing by the sum of squares of open gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

#: Pieces that one task packs at once.
GROUP = 16384
#: Gaps up to this size close a sequence before the last round.
CLOSE = 8
ROUNDS = 3


def pieces(df: DataFrame, tokenizer: str, end_id: int, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and cut what is longer than ``size`` into pieces.

    Returns a written table: doc_id, uid (tells rows apart, also those with the same key), piece,
    start, length, ids_crc32, ids (binary). Null text is empty and gives the end id alone; null and
    repeated keys are documents of their own. Texts are encoded whole, however long. An empty table
    gives no rows; other columns play no part.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import Encoder

        encoder = Encoder(tokenizer, end_id)
        end, wide = encoder.pack([end_id]), size * encoder.width
        for batch in slices(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                whole = encoder.encode(t) + end
                for p, a in enumerate(range(0, len(whole), wide)):
                    one = whole[a : a + wide]
                    at.append(row)
                    piece.append(p)
                    start.append(a // encoder.width)
                    length.append(len(one) // encoder.width)
                    crc.append(zlib.crc32(np.frombuffer(one, f"<u{encoder.width}").astype("<u4").tobytes()))
                    ids.append(one)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "uid", "piece", "start", "length", "ids_crc32", "ids"])

    with small_batches(df.sparkSession):
        return materialize(rows.mapInArrow(encode, f"doc_id {kind}, uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"), "pack-pieces")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the gap each bin is left with.

    Longest first. Each goes where the sum over gaps of the squared count of open bins with that
    gap becomes smallest, a new bin included; among equals into the smallest gap.
    """
    count = np.zeros(size + 1)
    count[0] = -0.5  # a full bin counts as none: see the algebra below
    cost = np.full(size + 1, np.inf)  # 0 where a gap has open bins
    stacks: dict[int, list[int]] = {}
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # half the change of the sum when gap g becomes g - s: count[g - s] - count[g] + 1
        change = count[: size - s] - count[s:size] + cost[s:size] + 1
        g = int(np.argmin(change)) + s if s < size else size
        if s >= size or change[g - s] > count[size - s] + 0.5:
            b, g = len(gaps), size
            gaps.append(size)
        else:
            b = stacks[g].pop()
            count[g] -= 1
            if not stacks[g]:
                cost[g] = np.inf
        bins[i], offsets[i] = b, size - g
        left = gaps[b] = g - s
        if left:
            stacks.setdefault(left, []).append(b)
            count[left] += 1
            cost[left] = 0
    return bins, offsets, np.array(gaps, np.int64)


def _placer(size: int, round_: int, final: bool):
    def place(table):
        import pyarrow as pa

        table = table.sort_by([("uid", "ascending"), ("piece", "ascending")])
        g = table.column("g")[0].as_py()
        bins, offsets, gaps = sum_of_squares(table.column("length").to_numpy(), size)
        more = {"sequence_id": (round_ << 58) + (g << 30) + bins, "offset": offsets, "closed": np.full(len(bins), True) if final else gaps[bins] <= CLOSE}
        table = table.drop_columns(["g"])
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return place


def pack(found: DataFrame, size: int = 4096, group: int = GROUP) -> DataFrame:
    """Place pieces (from pieces()) into as few sequences of ``size`` as it can.

    Adds sequence_id (no two sequences share one) and offset (gapless from 0). Full pieces are
    sequences of their own. The others are dealt by hash into groups, each packed by one task; what
    lies in sequences with a gap is dealt and packed anew in the following rounds, so that only the
    last round leaves gaps worth the name. An empty table gives no rows.
    """
    slim = found.drop("ids")
    full = slim.filter(F.col("length") >= size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, parts = slim.filter(F.col("length") < size), [full]
    schema = found.drop("ids").schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint,closed:boolean"
    names = slim.columns
    for round_ in range(ROUNDS):
        n = rest.count()
        if not n:
            break
        groups = max(4, -(-n // group)) if n > 2000 else 1
        final = round_ == ROUNDS - 1 or groups == 1

        dealt = rest.select(*names, F.pmod(F.xxhash64("uid", "piece", F.lit(round_)), F.lit(groups)).cast("int").alias("g"))
        placed = materialize(dealt.groupBy("g").applyInArrow(_placer(size, round_, final), schema), "pack-round")
        parts.append(placed.filter("closed").drop("closed"))
        rest = placed.filter("not closed").select(*names)
        if final:
            break
    return reduce(DataFrame.unionByName, parts)


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary), pieces (doc_id, piece, offset, length), in order."""
    rows = placed.join(found.select("uid", "piece", "ids"), ["uid", "piece"])
    one = F.struct("offset", "doc_id", "piece", "length", "ids")
    return rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces")
    )
