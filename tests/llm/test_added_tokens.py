"""Added tokens in texts, against the library's call with its defaults."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkwright.llm import queries
from inkwright.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "plain <| text", "漢 <|endoftext|>", "<|endoftext|>" * 3, "", None]


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_get_their_ids(path):
    e = Encoder(path)
    for text in TEXTS:
        assert np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == library(path, text), repr(text)


def test_queries_and_stage_use_the_default_call(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda path, end: {i: zlib.crc32(np.array([*library(path, t), end], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
    for got, want in ((queries.op5_token_output(spark, str(tmp_path)), crc(BYTES, 2)), (queries.op7_packing(spark, str(tmp_path)), crc(WORDS, 1)), (corpus_pipeline.pack(spark, docs, ""), crc(WORDS, 1))):
        assert {x.doc_id: x.ids_crc32 for x in got.collect()} == want
