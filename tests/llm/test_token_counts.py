"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwright.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "a", " a", "a ", "  two  spaces ", "it's WE'LL 'S don''t", "tab\tnl\n\nx \r\n y", "naïve Ünïcode ½ ²³ 3.14", "漢字 かな", "é combining", "<|endoftext|> <|startoftext|>", "a<|endoftext|><|endoftext|> b", "a\xa0b c d 　 e", "x\x1c \x1d y\x85z", "İstanbul ŉ ſ", "###$$$ %%% !!", "x" * 5000, "ab cd " * 3000, "​ zero", "😀 emoji 😀", "\x00 nul"]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def of():
    return token_counts.Counter(PATH)


def test_odd_texts(of):
    for text in ODD:
        assert of.count(text) == library(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBhet'sStTrReE dDlL 0½ \n\t.,#é’ÀžĀ–\xa0 漢😀\x1c")), max_size=80))
def test_any_text(text):
    assert token_counts.counter(PATH).count(text) == library(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(text):
    assert token_counts.counter(PATH).count(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=14), st.permutations([(a, b) for a in ("a", "b", "c", "ab", "aa", "bc") for b in ("a", "b", "c", "ab")]))
def test_merges_against_plain_search(text, order):
    ranks = {p: r for r, p in enumerate(order[:9])}
    left, made = list(text), 0
    while found := [(ranks[p], i) for i, p in enumerate(zip(left, left[1:])) if p in ranks]:
        _, i = min(found)
        left[i : i + 2] = ["".join(left[i : i + 2])]
        made += 1
    assert token_counts.merges(list(text), ranks) == made


def test_long_run_without_blanks(of):
    r = random.Random(1)
    text = "".join(r.choice("etaoin") for _ in range(120_000))
    assert of.count(text) == library(text)


def test_full_memo(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    one = token_counts.Counter(PATH)
    for text in ["some words here and there", "other words there and here again", *ODD]:
        assert one.count(text) == library(text)
    assert len(one.of_spaced) <= 3 and len(one.of_spaced.last) <= 3


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", None), (3, "again", "x"), (3, "again", "x"), (99, "word " * 600, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.count_tokens(df, PATH).collect()), key=repr)
    size = lambda t: len((t or "").encode())
    assert got == sorted(((i, size(t), library(t), library(t) > 512) for i, t, _ in rows), key=repr)
    assert token_counts.count_tokens(df.limit(0), PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert not token_counts.count_tokens(df.limit(0), PATH).count()


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = library(d.text)
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
