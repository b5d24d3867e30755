"""Near-duplicates by shingles against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from inkwright.llm import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def firsts(rows):
    """The smallest ids of the groups that links of five-word Jaccard 0.8 or more connect."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g, key=lambda d: (d is None, d)) for g in groups.values())


def made(seed):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    common = [word() for _ in range(40)]
    base = [[word() for _ in range(r.randrange(3, 200))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(160):
        w = list(base[0] if i < 60 else r.choice(base))
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = word()
        rows.append((100 + i, " ".join([*w, *common] if i % 3 == 0 else w).upper()))
    rows += [(900, None), (901, " \n"), (902, ""), (None, rows[0][1]), (903, "one"), (904, "One"), (905, "é one two")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [256, 3])
def test_groups_are_those_of_all_pairs(spark, tmp_path, bucket):
    rows = made(bucket)
    got = shingles.drop_near_duplicates(table(spark, tmp_path, rows), bucket=bucket).collect()
    assert sorted(x.doc_id for x in got) == firsts(rows)


def test_stage_drops_texts_that_differ_in_a_few_words(spark, tmp_path):
    """Two changed words in 200: similarity above 0.8, fingerprints more than two bits apart."""
    r = random.Random(1)
    rows = []
    for i in range(20):
        w = ["w%d" % r.randrange(3000) for _ in range(200)]
        rows.append((i, " ".join(w)))
        w[50], w[120] = "new", "newer"
        rows.append((100 + i, " ".join(w)))
    got = corpus_pipeline.near_dedup(spark, table(spark, tmp_path, rows), "").collect()
    assert sorted(x.doc_id for x in got) == list(range(20))


def test_parities_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (0, 1, 40, 900):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 9 :], r.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
        assert np.bitwise_count(shingles.parity(x) ^ shingles.parity(y)).sum() <= len(np.setxor1d(x, y))


def test_nothing(spark, tmp_path):
    assert shingles.drop_near_duplicates(table(spark, tmp_path, [])).count() == 0


def test_sketches_never_exclude_a_link():
    r = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 700, 5000):
        for share in (0.02, 0.1, 0.11, 0.3, 1):
            x = r.integers(0, 1 << 63, n).astype(np.uint64)
            y = np.unique(np.r_[x[: n - int(n * share)], r.integers(0, 1 << 63, int(n * share * r.random())).astype(np.uint64)])
            x = np.unique(x)
            apart = len(np.setxor1d(x, y))
            assert shingles.apart(shingles.sketch(x), shingles.sketch(y)) <= apart
    x, y = (r.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in "12")
    assert 9 * shingles.apart(shingles.sketch(x), shingles.sketch(y)) > 6000
