"""The pipeline's stages on the smallest tables, each on what the one before it wrote."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secret_scan", "mix", "pack"]
    assert all(s.columns == COLUMNS for s in steps[:-1]) and corpus_pipeline.ORACLE_SQL is None


JUNK, MARKS = re.compile(r"!! |### |\$\$\$ |%%% | \| "), re.compile(r"!!|###|\$\$\$|%%%|\||(\b\S+\b) \1 \1")


def test_quality_keeps_clean_documents_even_with_few_labels(steps):
    """Ten bad labels only: here about half of the junk stays, but clean documents do too."""
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) < set(before) and len(set(after)) == len(after)
    clean = {r for r in before if not MARKS.search(r[1])}
    assert len(clean - set(after)) <= 0.05 * len(clean)


def test_quality_rejects_junk_with_more_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = rows(docs), set(rows(corpus_pipeline.quality_filter(spark, docs, sf)))
    junk = {r for r in before if len(JUNK.findall(r[1])) > 20}
    clean = {r for r in before if not MARKS.search(r[1])}
    assert len(junk & after) <= 0.1 * len(junk) and len(clean - after) <= 0.05 * len(clean)


def test_one_of_each_near_duplicate_group_stays(steps):
    before, after = sorted(rows(steps[1])), rows(steps[2])
    sets = []
    for r in before:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), r[1]).split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(after) == [before[i] for i in range(len(before)) if find(i) == i]


def test_secrets_are_masked_and_nothing_else_changes(steps):
    planted = re.compile(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{18}|AKIA[0-9A-Z]{16}')
    want = [(i, new, la, so, len(new) if new != t else n) for i, t, la, so, n in rows(steps[2]) for new in [planted.sub("[SECRET]", t)]]
    assert sorted(rows(steps[3])) == sorted(want)


def test_mix_holds_whole_documents_near_their_targets(steps):
    before, after = Counter(rows(steps[3])), Counter(rows(steps[4]))
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    words = lambda r: len(r[1].encode().split())
    total, taken = sum(map(words, before.elements())), sum(map(words, after.elements()))
    assert abs(taken - 1.5 * total) <= max(map(words, before))


def test_packed_pieces_are_the_mix(steps):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows(steps[4]):
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[r[0], p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = steps[5].collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    sums = Counter()
    for x in got:
        sums[x.sequence_id] += x.length
    assert max(sums.values()) <= 4096 and len(sums) <= -(-sum(sums.values()) // 4096) + 2


def test_run_gives_the_same_documents(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[5].columns
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, steps[5].select(key).collect()))


AWKWARD = ["size", "keep", "scores", "secrets", "redacted", "copies", "taken", "target", "finish_time", "__uid", "__r", "row"]


def test_stages_take_nulls_repeats_and_any_column_names(spark, tmp_path):
    good = "The river runs under the old stone bridge and the hills are green in spring again. "
    rows = [(None, good * 3, "en", None, 3), (1, None, "en", "a", None), (2, "", None, "a", 0), (2, "", None, "a", 0), (3, good * 4000, "en", "b", 9), (4, good.replace("river", "brook") * 2 + 'token = "0123456789abcdef0123456789abcdef01234567"', "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in AWKWARD})
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pack":
            assert docs.columns == [*COLUMNS, *AWKWARD] and docs.count() > 0
            assert all(x[c] == f"own {c}" for x in docs.collect() for c in AWKWARD)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, empty, SF).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
