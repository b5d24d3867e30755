"""Operator 13, token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import BYTE_LEVEL, LETTERS, PLAIN, byte_alphabet

#: Entries of a memo's generation, and code points of the longest entry: some 150 MB at most in a worker.
MEMO, LONGEST = 200_000, 64

# A single space between two of these is always the first character of a pretoken, so that a text
# falls apart there; next to any other character a text stays whole and goes to the pre-tokenizer.
_SOLID = f"!-~{LETTERS}"
_CUT = re.compile(f"(?<=[{_SOLID}]) (?=[{_SOLID}])")
_EVEN = re.compile(f"[{_SOLID}]+(?: [{_SOLID}]+)*")


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes of these symbols.

    A heap holds adjacent pairs by rank, then by place; a doubly linked list holds the symbols that
    are left. A popped pair counts only if both symbols still stand as they did when it was pushed.
    Time n log n, memory n, for a run of any length.
    """
    rank_of, pop, push = ranks.get, heapq.heappop, heapq.heappush
    sym: list[str | None] = list(symbols)
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
    heapq.heapify(heap)
    n, done = len(sym), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = pop(heap)
        j = after[i]
        # a rank names one pair, so equal ranks mean that the pair is as it was
        if j >= n or sym[i] is None or rank_of((sym[i], sym[j])) != rank:
            continue
        done += 1
        sym[i] = one = sym[i] + sym[j]
        sym[j] = None
        after[i] = k = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            if (r := rank_of((one, sym[k]))) is not None:
                push(heap, (r, i))
        if h >= 0 and (r := rank_of((sym[h], one))) is not None:
            push(heap, (r, h))
    return done


class _Memo(dict):
    """Counts of short strings, in two generations: a full one is kept for what is asked again, and
    the one before it is dropped."""

    def __init__(self, count):
        super().__init__()
        self.count, self.last = count, {}

    def __missing__(self, piece: str) -> int:
        found = self.last.get(piece)
        if found is None:
            found = self.count(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMO:
                self.last = dict(self)
                self.clear()
            self[piece] = found
        return found


class Counter:
    """Counts the tokens of whole texts under a byte-level BPE vocabulary file.

    The library's pre-tokenizer cuts pieces into pretokens; the merges are made here. Added tokens
    in a text count one each, and cut it, as is the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [t["content"] for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model.get("type") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.pretokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        contents = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.alphabet = byte_alphabet()
        self.of_pretoken = _Memo(self._pretoken)
        self.of_piece = _Memo(self._piece)
        self.of_spaced = _Memo(lambda p: self._piece(f" {p}"))

    def _pretoken(self, pretoken: str) -> int:
        """pretoken: written in the stand-ins of its bytes."""
        return len(pretoken) - merges(list(pretoken), self.ranks)

    def _piece(self, piece: str) -> int:
        if PLAIN.fullmatch(piece):  # then all Unicode versions cut it alike
            found = [p.encode().decode("latin-1").translate(self.alphabet) for p in BYTE_LEVEL.findall(piece)]
        else:
            found = [p for p, _ in self.pretokens(piece)]
        return sum([self.of_pretoken[p] for p in found])

    def _text(self, text: str) -> int:
        first, *rest = text.split(" ") if _EVEN.fullmatch(text) else _CUT.split(text)
        return (self.of_piece[first] if first else 0) + sum(map(self.of_spaced.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(map(self._text, filter(None, parts)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker: reading the file takes longer than a small task."""
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) for every row of df.

    Initial symbols are the bytes of a pretoken; its count is these less the merges made, and no
    ids are made. tokenizer: a byte-level BPE file of the tokenizers library, at the same path on
    every machine. No begin, end or added special tokens, no truncation; texts are read whole,
    however long. Null text counts as empty: 0 bytes, 0 tokens. Each row is counted on its own, so
    null, equal or repeated keys stay rows of their own. An empty table gives no rows. Extra columns
    play no part, whatever their names. No exchange: a hot key or source changes nothing.
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        of = counter(tokenizer).count
        for b in slices(batches):
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array([of(t.as_py()) for t in b.column(1)], pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = dict(slim.dtypes)["key"]
    found = slim.mapInArrow(count, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
