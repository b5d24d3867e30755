"""Spelling variants against plain Python and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from inkwright.llm import queries, variants

DOCS = "doc_id long, text string"


def plain_words(rows, min_length=7, min_count=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(words, ratio=10):
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if v != w and near(v, w))
        form = others[0] if others and -others[0][0] >= ratio * n else (None, None)
        forms[w] = form[1]
        out.append((w, n, form[1], len(others), None if form[0] is None else -form[0]))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return sorted(((w, n, f, root(w), k, m) for w, n, f, k, m in out), key=repr)


def rows_of(df):
    return sorted(((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()), key=repr)


def corpus(seed=2):
    r = random.Random(seed)
    base = ["receive", "Weather", "straßenbahn", "déjàvoulu", "Éléphants", "banana×÷x", "abcdefg", "gfedcba"]
    def typo(w):
        k, c = r.randrange(len(w)), r.choice("aeizé")
        return r.choice([w, w, w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
    rows = [(i, " ".join(typo(r.choice(base[: 1 + i % 8])) + r.choice(["", ",", "'s", "9x"]) for _ in range(60))) for i in range(60)]
    return rows + [(None, "receive receive weather"), (3, None), (4, ""), (5, "漢字 12 ab"), (6, "receive " * 900), (6, "receive " * 900), (8, "x" * 40_000 + " " + "x" * 40_000), (9, "x" * 39_999 + "y " + "x" * 40_000)]


@pytest.mark.parametrize("bucket", [variants.BUCKET, 2])
def test_against_plain(spark, bucket):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", word string, `a.b` int").repartition(3)
    words = plain_words(rows)
    got = variants.vocabulary(df)
    assert {r.word: r.n for r in got.collect()} == words
    short = {w: n for w, n in words.items() if len(w) < 100} if bucket == 2 else words
    table = spark.createDataFrame(list(short.items()), "word string, n long")
    want = plain_forms(short)
    assert rows_of(variants.word_forms(table, bucket=bucket)) == want and any(f[2] for f in want)


@pytest.mark.parametrize("bucket", [32, 1])
def test_random_words(spark, bucket):
    r = random.Random(7)
    words = {"".join(r.choice("abÿ") for _ in range(r.randint(7, 8))): r.choice([2, 3, 20, 30, 300, 4000]) for _ in range(700)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.word_forms(table, bucket=bucket)) == plain_forms(words)


def test_long_chains_and_ties(spark):
    words = {"aaaaaaa" + "b" * i: 10**i for i in range(12)} | {"zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "yyyyyyy": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(variants.word_forms(table))
    assert got == plain_forms(words)
    assert [r[3] for r in got if r[0] == "aaaaaaa"] == ["aaaaaaa" + "b" * 11] and [r[2] for r in got if r[0] == "zzzzzzz"] == ["zzzzzzx"]


def test_powers_have_distinct_differences():
    powers = [i**5 for i in range(91)]
    sums = Counter(a + b for i, a in enumerate(powers) for b in powers[: i + 1])
    assert max(sums.values()) == 1


def test_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert variants.vocabulary(df).collect() == [] and variants.word_forms(variants.vocabulary(df)).collect() == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(variants.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = queries.op11_spelling_variants(spark, sf)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
