"""Token output and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwright.llm import packing, token_store
from inkwright.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "  two  spaces ", "it's WE'LL 'S don''t", "tab\tnl\n\nx \r\n y", "naïve Ünïcode ½ ²³ 3.14", "漢字 かな", "é combining", "<|endoftext|> <|startoftext|>", "a b", "İstanbul ŉ ſ", "###$$$ %%% !!", "x" * 5000, "ab cd " * 3000, "​ zero", "😀 emoji"]


def library(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_agrees_with_the_library(path):
    e = Encoder(path)
    for text in ODD:
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == library(path, text), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB'sStTrReE dDlL 0½ \n\t.,#é’ÀžĀ–")), max_size=60))
def test_memo_agrees_on_plain_texts(text):
    for path in (BYTES, WORDS):
        e = _encoder(path)
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == _library(path).encode(text, add_special_tokens=False).ids


_made = {}


def _encoder(path):
    return _made.setdefault(path, Encoder(path))


def _library(path):
    if (path, 1) not in _made:
        _made[path, 1] = Tokenizer.from_file(path)
    return _made[path, 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    ends = values.tolist()
    ef, ids = token_store.read_segment(token_store.write_segment(b"", ends, 2))
    assert ef.all().tolist() == ends and not len(ids)
    assert all(ef.value(i) == ends[i] for i in range(0, len(ends), 97))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash"))


def test_segments_read_back(spark):
    r = random.Random(2)
    rows = [(i, ODD[i % len(ODD)]) for i in r.sample(range(1000), 120)]
    got = sorted(token_store.read_tokens(token_store.write_tokens(frame(spark, rows), BYTES, 2)).collect(), key=lambda x: x.doc_id)
    start = 0
    for x, (i, t) in zip(got, sorted(rows), strict=True):
        ids = np.array(library(BYTES, t) + [2], "<u4")
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_segments_of_null_and_repeated_ids_and_of_nothing(spark):
    rows = [(None, "a b"), (3, "same"), (3, "same"), (3, "other")]
    got = sorted(token_store.read_tokens(token_store.write_tokens(frame(spark, rows), BYTES, 2)).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None, 3, 3, 3] and got[0].start == 0
    assert token_store.read_tokens(token_store.write_tokens(frame(spark, []), BYTES, 2)).count() == 0


def test_sum_of_squares_packs_tightly():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 400, 3000)
    bins, offsets, gaps = packing.sum_of_squares(lengths, 1000)
    for b in range(len(gaps)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (np.cumsum(lengths[mine]) - lengths[mine] == offsets[mine]).all()
        assert lengths[mine].sum() == 1000 - gaps[b]
    assert len(gaps) <= -(-lengths.sum() // 1000) + 3


def test_packing_contract(spark):
    rows = [(i, ODD[i % len(ODD)]) for i in range(200)] + [(None, "null id"), (5, "twice"), (5, "twice")]
    found = packing.pieces(frame(spark, rows), WORDS, 1, size=256)
    placed = packing.pack(found, 256)
    got = placed.collect()
    want = []
    for i, t in rows:
        ids = np.array(library(WORDS, t) + [1], "<u4")
        want += [(i is None, i or 0, p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for p, a in enumerate(range(0, len(ids), 256))]
    assert sorted((x.doc_id is None, x.doc_id or 0, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(x.length for x in got) // 256) + 8
    whole = packing.sequences(found, placed).collect()
    assert len(whole) == len(by) and sum(len(x.ids) for x in whole) == 2 * sum(x.length for x in got)


def test_packing_of_nothing(spark):
    assert packing.pack(packing.pieces(frame(spark, []), WORDS, 1)).count() == 0
