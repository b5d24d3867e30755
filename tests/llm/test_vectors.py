"""Top-k search, graphs, embedding dedup and components against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwright.llm import embed_dedup, topk
from inkwright.llm.components import connected_components
from inkwright.llm.hnsw import Hnsw, within

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=400, dim=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(20, dim))
    v = base[r.integers(0, 20, n)] + r.normal(size=(n, dim)) * 0.15
    rows = [(i, v[i].astype("f4").tolist(), int(r.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(150)]  # many copies
    rows += [(1000, None, 1), (1001, [1.0, None] + [0.0] * 6, 1), (1002, [math.nan] * dim, 1), (1003, [math.inf] + [0.0] * 7, 1), (1004, [0.0] * dim, 1), (1005, rows[3][1], None), (1006, [1.0, 2.0], 1), (1007, [], 1), (1100, rows[5][1], 2)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(spark):
    rows = vectors()
    got = topk.search(spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit(0)), F.col("vec_id") % 100 == 0).collect()
    q = {i: [math.floor(1024 * x) for x in np.array(v, "f4").astype(float)] for i, v, _ in rows if usable(v)}
    want = set()
    for i in q:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:10]
            want |= {(i, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_top_k_of_few_and_of_none(spark):
    got = topk.search(spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (None, [9.0], 1)], SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 1024 * 2048)]
    for empty in ([], [(0, None, 1)]):
        assert topk.search(spark.createDataFrame(empty, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_of_large_components_are_exact(spark):
    rows = [(i, [x, 1.0], 1) for i, x in enumerate((300000.0, 400000.0, 500000.0, 270000.0))]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    want = [(0, k + 1, j, sum(a * b for a, b in zip(whole[0], whole[j]))) for k, j in enumerate((2, 1, 3))]
    assert sorted(tuple(x) for x in got) == want
    # products that only cancel out to a long, and one that does not
    rows = [(0, [2.0**22, 2.0**22], 1), (1, [2.0**22, -(2.0**22)], 1), (2, [2.0**22, 1 - 2.0**22], 1)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert sorted(tuple(x) for x in got) == [(0, 1, 2, 1 << 42), (0, 2, 1, 0)]
    rows = [(0, [2.0**22], 1), (1, [2.0**22], 1)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()


def test_triangle_bounds_exclude_most_pairs_of_clustered_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(200, 16)) * 4
    v = base[r.integers(0, 200, 20000)] + r.normal(size=(20000, 16)) * 0.1
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    v = np.floor(v.astype("f4").astype(float) * 1024)
    got = {}
    for x in topk.search(df, F.col("vec_id") % 1000 == 0).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    for i in range(0, 20000, 1000):
        s = v @ v[i]
        s[i] = -np.inf
        order = np.lexsort((np.arange(20000), -s))[:10]
        assert [got[i][k + 1] for k in range(10)] == [(j, int(s[j])) for j in order]
    assert topk.share_scanned(df, F.col("vec_id") % 1000 == 0) < 0.5


def test_graph_finds_what_is_near():
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 32))
    x = base[r.integers(0, 60, 1500)] + r.normal(size=(1500, 32)) * 0.25
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Hnsw.load(x.astype("f4"), Hnsw.build(x.astype("f4")).dump())
    got = within(graph, x.astype("f4"), 0.9, lambda i, j: np.einsum("kd,kd->k", x[i], x[j]), own=True)
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    assert not (got.linked & ~want).any() and (got.linked & want).sum() >= 0.99 * want.sum()
    assert got.true >= 256 and got.found >= 0.99 * got.true and got.scanned <= x.shape[0] ** 2 // 4 + 2 * x.shape[0]


def test_a_broken_walk_does_not_pass_the_audit(monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(800, 32))
    x[400:500] = x[:100] + r.normal(size=(100, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = lambda i, j: np.einsum("kd,kd->k", x[i], x[j])
    graph = Hnsw.build(x.astype("f4"))
    fine = within(graph, x.astype("f4"), 0.93, exact, own=True)
    assert fine.beam == 64 and fine.true >= 80 and fine.linked.sum() == 200
    # a walk that finds each vector itself and nothing else
    alone = lambda self, q, beam: (np.c_[(q @ self.x.T).argmax(1), np.full((len(q), 1), -1)], np.c_[np.ones(len(q)), np.full((len(q), 1), -2.0)])
    monkeypatch.setattr(Hnsw, "search", alone)
    broken = within(graph, x.astype("f4"), 0.93, exact, own=True)
    assert broken.found < 0.5 * broken.true and broken.beam >= 800 and broken.linked.sum() == 200


def test_links_within_and_between_shards_come_from_the_walk(spark):
    r = np.random.default_rng(12)
    v = r.normal(size=(3000, 24))
    v[1500:1800] = v[:300] + r.normal(size=(300, 24)) * 0.03
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = int((u @ u.T >= 0.93).sum()) - 3000
    df = spark.createDataFrame(rows, SCHEMA)
    assert want >= 500 and sum(x.n_links for x in embed_dedup.link(df, shard=1000).collect()) >= 0.99 * want
    found, true, share = embed_dedup.audited(df, shard=1000)
    assert true >= 200 and found >= 0.99 * true and share <= 0.3


def test_sql_on_the_given_vectors_with_moved_copies(spark):
    import duckdb

    given = duckdb.sql("SELECT vec_id, embedding, label FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    r = np.random.default_rng(2)
    moved = [(10_000 + i, (np.array(v) + r.normal(size=len(v)) * 0.02 * np.linalg.norm(v) / len(v) ** 0.5 * (i % 25)).tolist(), c) for i, v, c in given]
    rows = given + moved + [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, given[0][1], None), (20_003, given[0][1], given[0][2])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = con.execute(embed_dedup.ORACLE_SQL).fetchall()
    got = embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=40)
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(x[1] for x in want) > 800


def test_audit_widens_a_beam_that_finds_too_little():
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:300] + r.normal(size=(300, 48)) * 0.02
    q /= np.linalg.norm(q, axis=1)[:, None]
    graph = Hnsw.build(x.astype("f4"))
    graph.layers[0][:] = -1  # a ground layer without links: the walk stays where it enters
    got = within(graph, q.astype("f4"), 0.9, lambda i, j: np.einsum("kd,kd->k", q[i], x[j]))
    assert got.beam >= 900 and (got.linked == (q @ x.T >= 0.9)).all()


def test_small_and_sparse_shards_walk_the_graph_and_are_audited(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(300, 16))
    v[150:160] = v[:10] + r.normal(size=(10, 16)) * 0.02  # ten links in all
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    found, true, share = embed_dedup.audited(df, shard=100)
    assert found >= 0.9 * true and share < 0.3
    assert sum(x.n_links for x in embed_dedup.link(df, shard=100).collect()) == 20


def test_embedding_links(spark):
    rows = vectors(7)
    for shard in (8192, 60):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embed_dedup.link(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)), shard=shard).collect()}
        good = [(i, np.pad(np.array(v, float), (0, 8 - len(v))), c) for i, v, c in rows if usable(v) and c is not None and any(v)]
        near = {i: [j for j, w, d in good if d == c and j != i and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, c in good}
        for i, _, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                for j in near.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            assert got[i] == (len(near.get(i, ())), min(seen), i == min(seen)), i
        assert len(got) == len(rows)


def test_embedding_links_of_nothing(spark):
    assert embed_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embed_dedup.link(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1), (4, [1.0], 1)], SCHEMA)).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in got) == [(0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 7), (None, 3), (260, 5), (5, 260)]
    edges += [(r.randint(300, 360), r.randint(300, 360)) for _ in range(50)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
