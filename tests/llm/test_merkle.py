"""Merkle manifests against a plain tree."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(*shown)


def plain_tree(leaves, arity):
    """The root and each leaf's siblings, level by level."""
    level, groups, proofs = list(leaves), [[i] for i in range(len(leaves))], ["" for _ in leaves]
    while len(level) > 1:
        up, held = [], []
        for k in range(0, len(level), arity):
            run = range(k, min(k + arity, len(level)))
            for j in run:
                for i in groups[j]:
                    proofs[i] += "".join(level[x] for x in run if x != j)
            up.append(h(*[level[x] for x in run]))
            held.append([i for j in run for i in groups[j]])
        level, groups = up, held
    return level[0], proofs


def plain(rows, arity=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    subs, inner = [], []
    for lang in langs:
        members = sorted((r for r in rows if r[2] == lang), key=order)
        sub, proofs = plain_tree([leaf(*r) for r in members], arity)
        subs.append(sub)
        inner.append((members, proofs))
    root, outer = plain_tree(subs, arity)
    out = []
    for k, (members, proofs) in enumerate(inner):
        for i, (r, p) in enumerate(zip(members, proofs)):
            claim = leaf(*r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                claim = leaf(r[0], r[1], r[2], r[3], r[4] + 1)
            folded = root if claim == leaf(*r) else "other"
            out.append((r[0], leaf(*r), subs[k], root, h(p + outer[k]), folded))
    return out


def corpus(n, seed=5, langs=("en", "en", "en", "de", None, "ÿ", "z", "")):
    r = random.Random(seed)
    rows = [(i, r.choice(["a text", "", None, "long " * 2000, "é漢"]), r.choice(langs), r.choice(["web", None]), r.choice([None, i])) for i in range(n)]
    return rows + [(None, "x", "en", "s", 1), (None, None, None, None, None), (3, "again", "en", "s", 2), rows[5], rows[5], (-4, "below", "only", "s", 9)]


@pytest.mark.parametrize("arity,chunk,fan,n", [(2, 4, 2, 90), (2, 2048, 64, 200), (3, 5, 3, 121), (2, 1, 2, 9)])
def test_against_plain_tree(spark, arity, chunk, fan, n):
    rows = corpus(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    cols = [F.col(c) for c in merkle.FIELDS]
    claim = F.when(hit, merkle.leaf_hash(*[c + 1 if n == "n_chars" else c for n, c in zip(merkle.FIELDS, cols)]))
    claim = F.when(F.col("n_chars").isNotNull(), claim)
    found = merkle.prove(df, merkle.leaf_hash(*cols), claim, arity=arity, chunk=chunk, fan=fan).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, h(r.proof), r.folded_root if r.folded_root == r.root else "other") for r in found]
    assert sorted(got, key=repr) == sorted(plain(rows, arity), key=repr)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], SCHEMA)
    r = merkle.digest(one).collect()[0]
    assert r.leaf == r.subroot == r.root == leaf(1, "t", "en", "s", 1) and r.proof_sha256 == h("") and r.verified == (r.folded_root == r.root)
    assert merkle.digest(one.limit(0)).collect() == []
    clash = one.selectExpr("*", "1 as leaf", "2 as root", "3 as `tree`", "4 as `a.b`", "5 as __before")
    assert merkle.digest(clash).collect() == [r]


def test_one_changed_byte_changes_the_root(spark):
    rows = corpus(60)
    a = merkle.digest(spark.createDataFrame(rows, SCHEMA)).first().root
    rows[17] = (*rows[17][:1], "another text", *rows[17][2:])
    assert merkle.digest(spark.createDataFrame(rows, SCHEMA)).first().root != a


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=5), st.integers(2, 4), st.randoms(use_true_random=False))
def test_merging_in_any_grouping_and_order(sizes, arity, r):
    parts = []
    for tree, n in enumerate(sizes):
        for i in range(n):
            f = merkle.Forest(arity, sizes={merkle.TOP: len(sizes), tree: n})
            f.add(merkle.Node(tree, 0, i), h(f"{tree}.{i}"))
            parts.append(f)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    want = plain_tree([plain_tree([h(f"{t}.{i}") for i in range(n)], arity)[0] for t, n in enumerate(sizes)], arity)[0]
    assert list(whole.nodes.values()) == [want]
    r.shuffle(parts)
    while len(parts) > 1:
        k = r.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k].merge(parts[k + 1])]
    assert parts[0].nodes == whole.nodes


def test_unresolved_nodes_stay_few():
    f = merkle.Forest(sizes={merkle.TOP: 1, 0: 100_000})
    for i in range(12_345, 23_456):
        f.add(merkle.Node(0, 0, i), h(str(i)))
    assert len(f.nodes) < 2 * 17


def test_every_row_folds_its_own_proof():
    leaves = [h(str(i)) for i in range(5)]
    root, proofs = plain_tree(leaves, 2)
    places = [merkle.Node(0, 0, i) for i in range(5)]
    assert merkle.fold_all(leaves, places, [5] * 5, 1, proofs) == [root] * 5
    proofs[3] = h("forged") + proofs[3][64:]
    assert [r == root for r in merkle.fold_all(leaves, places, [5] * 5, 1, proofs)] == [True, True, True, False, True]
    assert merkle.fold_all([h("claimed"), *leaves[1:]], places, [5] * 5, 1, proofs)[0] != root


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(merkle.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = merkle.digest(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
