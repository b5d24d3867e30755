"""Operator 4, removal of repeated 50-byte strings over a distributed, sampled suffix array."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, utf8_size

#: Bytes of text that are handled at once (at least; a longer document stands alone), and behind a
#: bucket of hashes or a range of suffixes, as multiples of the root of all bytes: each pack sends a
#: row to each bucket, so rows grow in proportion to the text, and tasks with its root.
PACK, PACK_ROOT, BUCKET_ROOT = 4 << 20, 4, 50
#: Leading bytes sampled for splitters: in all at least, for each range, and in a pack at most.
SAMPLE, SAMPLE_RANGE, SAMPLE_PACK = 20_000, 8, 64
LAST = np.iinfo(np.int64).max


def _shrink(data: bytes) -> bytes:
    """What is exchanged or written is compressed here: better than a shuffle's own codec does."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _grow(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _packed(size: int):
    """Whole documents gathered to packs: pack (uid of its first document), docs, sizes, data."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        uids, docs, parts, held = [], [], [], 0

        def flush():
            out = [pa.array([uids[0]], pa.int64()), pa.array([list(docs)], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([_shrink(b"".join(parts))], pa.binary())]
            uids.clear(), docs.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(out, ["pack", "docs", "sizes", "data"])

        for b in batches:
            for u, d, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t.encode() if t else b""
                if parts and held + len(t) > size:
                    yield flush()
                    held = 0
                uids.append(u)
                docs.append(d)
                parts.append(t)
                held += len(t)
        if parts:
            yield flush()

    return run


def _rows(batch) -> Iterator[dict]:
    """Rows one by one, so that only one pack is held besides the batch."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


class _Pack:
    """A pack's anchors and the documents they are in, made anew from its bytes in each phase."""

    def __init__(self, docs: list, sizes: list, data: bytes):
        from . import suffixes

        self.docs = np.array([LAST if d is None else d for d in docs], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(_grow(data), np.uint8)
        self.pos, self.first, self.last, self.hash = suffixes.anchors(self.data, self.ends)
        self.doc = self.docs[np.searchsorted(self.ends, self.first, side="right")]
        self.values, self.rank = np.unique(self.hash, return_inverse=True)

    def many(self) -> np.ndarray:
        """Which hashes stand in several documents of the pack."""
        low, high = np.full(len(self.values), LAST), np.full(len(self.values), -LAST)
        np.minimum.at(low, self.rank, self.doc)
        np.maximum.at(high, self.rank, self.doc)
        return low < high

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket of hashes begins among the pack's."""
        return np.searchsorted(self.values, np.array([(b << 44) // buckets for b in range(buckets + 1)], np.uint64))

    def shared(self, masks: list, buckets: int):
        """Different frames of the anchors that another document may share: the anchors, the frame
        of each, the frames in order and the smallest document of each."""
        from . import suffixes

        edges, flag = self.edges(buckets), np.zeros(len(self.values), bool)
        for m in masks:
            a, b = edges[m["bucket"]], edges[m["bucket"] + 1]
            flag[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).astype(bool)
        some = np.flatnonzero(flag[self.rank])
        rows = suffixes.frames(self.data, self.pos[some], self.first[some], self.last[some])
        order, new = suffixes.multikey_sort(rows)
        start = np.flatnonzero(new)
        kind = np.empty(len(some), np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.doc[some][order], start) if len(some) else np.zeros(0, np.int64)
        return some, kind, rows[order[start]], least


def _hashes(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in _rows(b):
                p = _Pack(r["docs"], r["sizes"], r["data"])
                edges, many = p.edges(buckets), p.many()
                blobs = [p.values[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, z in zip(edges, edges[1:])]
                flags = [np.packbits(many[a:z]).tobytes() for a, z in zip(edges, edges[1:])]
                full = [i for i in range(buckets) if blobs[i]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([r["pack"]] * len(full), pa.int64()), pa.array([blobs[i] for i in full], pa.binary()), pa.array([flags[i] for i in full], pa.binary())], ["bucket", "pack", "hashes", "many"])

    return run


def _leads(rate: float):
    """Leading bytes of evenly spaced anchors of some packs, for the splitters."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import suffixes

        for b in batches:
            for r in _rows(b):
                p = _Pack(r["docs"], r["sizes"], r["data"])
                at = p.pos[:: max(1, int(len(p.pos) / (SAMPLE_PACK * min(1.0, rate)) + 1))]
                yield pa.RecordBatch.from_arrays([pa.array([bytes(p.data[a : a + suffixes.GRAM]) for a in at], pa.binary())], ["lead"])

    return run


def _common(key, table):
    """Of each pack, which hashes of the bucket are in another document too."""
    import pyarrow as pa

    blobs = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table.column("hashes").to_pylist()]
    values = []
    for x in blobs:
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, :6] = x
        values.append(wide.view("<u8")[:, 0])
    many = [v[np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool)] for v, x in zip(values, table.column("many").to_pylist())]
    all_ = np.sort(np.concatenate(values))
    twice = np.unique(np.concatenate([all_[1:][all_[1:] == all_[:-1]], *many]))
    masks = []
    for v in values:
        i = np.minimum(np.searchsorted(twice, v), max(0, len(twice) - 1))
        masks.append(np.packbits(twice[i] == v if len(twice) else np.zeros(len(v), bool)).tobytes())
    return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})


def _suffixes(buckets: int, splitters: list[bytes]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in _rows(b):
                _, _, rows, least = _Pack(r["docs"], r["sizes"], r["data"]).shared(r["masks"], buckets)
                edges = _cuts(rows, splitters)
                full = [i for i in range(len(edges) - 1) if edges[i] < edges[i + 1]]
                pick = lambda x: pa.array([_shrink(x[edges[i] : edges[i + 1]].tobytes()) for i in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([r["pack"]] * len(full), pa.int64()), pick(rows), pick(least)], ["range", "pack", "frames", "docs"])

    return run


def _cuts(rows: np.ndarray, splitters: list[bytes]) -> list[int]:
    """Where each range begins among sorted frames."""
    from . import suffixes

    lead = lambda i: rows[i, : suffixes.GRAM].tobytes()
    return [0, *(bisect.bisect_left(range(len(rows)), s, key=lead) for s in splitters), len(rows)]


def _compare(key, table):
    """Sort the suffixes of a range and tell each pack which windows an earlier document has."""
    import pyarrow as pa

    from . import suffixes

    rows = np.frombuffer(b"".join(_grow(x.as_py()) for x in table.column("frames")), np.uint8).reshape(-1, suffixes.FRAME)
    docs = [_grow(x) for x in table.column("docs").to_pylist()]
    sizes = [len(x) // 8 for x in docs]
    docs = np.frombuffer(b"".join(docs), np.int64)
    bits = suffixes.first_documents(rows, docs)
    parts = np.split(bits, np.cumsum(sizes)[:-1])
    return pa.table({"pack": table.column("pack"), "range": table.column("range"), "bits": pa.array([x.tobytes() for x in parts], pa.binary())})


def _remove(buckets: int, splitters: list[bytes]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import suffixes

        for b in batches:
            for r in _rows(b):
                p = _Pack(r["docs"], r["sizes"], r["data"])
                some, kind, rows, least = p.shared(r["masks"] or [], buckets)
                edges, bits = _cuts(rows, splitters), np.zeros(len(rows), np.uint32)
                for x in r["found"] or []:
                    bits[edges[x["range"]] : edges[x["range"] + 1]] = np.frombuffer(x["bits"], np.uint32)
                low, high = p.pos[some] - p.last[some], p.pos[some] - p.first[some]
                # in a later document of the pack every window of the frame repeats the first one's
                mine = np.where(p.doc[some] > least[kind], ((1 << (high + 1)) - (1 << low)), bits[kind].astype(np.int64))
                turn = np.zeros(len(p.data) + 1, np.int32)
                for o in range(suffixes.RUNS):
                    at = p.pos[some][(mine >> o & 1).astype(bool)] - o
                    np.add.at(turn, at, 1)
                    np.add.at(turn, at + suffixes.WINDOW, -1)
                gone = np.cumsum(turn[:-1]) > 0
                starts = p.ends - p.sizes
                out: list[list] = [[], [], [], []]
                for a, z in zip(starts, p.ends):
                    g = gone[a:z]
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                    out[0].append(z - a)
                    out[1].append(int(g.sum()))
                    out[2].append(edge.reshape(-1, 2).tolist())
                    out[3].append(p.data[a:z][~g].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin, end of each maximal removed run), kept (the bytes left).

    A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller
    key (a whole number; a key that can't be cast to one is an error); strings lie within one document
    and are judged on the input. Null text is empty. Documents of under 50 bytes lose nothing. Null keys count as larger than all others; documents with equal
    keys don't repeat each other. An empty table gives no rows; other columns play no part.

    Of all suffixes those at anchors are kept (see suffixes), one in sixteen. A first exchange of
    44-bit hashes, once for each pack of documents, drops anchors whose first 20 bytes are in no
    other document. The rest, each different one once for each pack, are range-partitioned by their
    leading bytes with sampled splitters, sorted range by range by multikey quicksort, and compared
    byte by byte. Splitters fall between different leading bytes, so nothing has to be compared
    across them. The answers go back to the packs as bits. A pack takes the memory of about
    twelve times its bytes; so does a document that is longer than a pack.
    """
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    root = int((rows.agg(F.sum(utf8_size("text"))).first()[0] or 0) ** 0.5)
    packs = materialize(rows.mapInArrow(_packed(max(PACK, PACK_ROOT * root)), "pack long, docs array<long>, sizes array<long>, data binary"), "suffix-packs")
    buckets = max(32, root // BUCKET_ROOT)
    rate = max(SAMPLE, SAMPLE_RANGE * buckets) / (SAMPLE_PACK * max(1, packs.count()))
    drawn = packs.filter(F.lit(rate) * 2**32 > F.pmod(F.xxhash64("pack"), F.lit(2**32))) if rate < 1 else packs
    leads = sorted(r[0] for r in drawn.mapInArrow(_leads(1.0), "lead binary").collect())
    leads = [bytes(x) for x in leads]
    splitters = sorted({leads[len(leads) * i // buckets] for i in range(1, buckets)}) if leads else []
    hashed = packs.mapInArrow(_hashes(buckets), "bucket int, pack long, hashes binary, many binary")
    masks = materialize(hashed.groupBy("bucket").applyInArrow(_common, "pack long, bucket int, mask binary"), "suffix-masks")
    release(spark)
    mine = masks.groupBy("pack").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    framed = packs.join(mine, "pack").mapInArrow(_suffixes(buckets, splitters), "range int, pack long, frames binary, docs binary")
    found = materialize(framed.groupBy("range").applyInArrow(_compare, "pack long, range int, bits binary"), "suffix-bits")
    release(spark)
    told = found.groupBy("pack").agg(F.collect_list(F.struct("range", "bits")).alias("found"))
    return packs.join(mine, "pack", "left").join(told, "pack", "left").select("docs", "sizes", "data", "masks", "found").mapInArrow(_remove(buckets, splitters), "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
