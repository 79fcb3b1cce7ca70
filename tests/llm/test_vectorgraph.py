import math

import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import vectorgraph as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, near=V.NEAR):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    links = {k: {j for j in good if j != k and k in good and float(good[k] @ good[j]) >= near} for k in range(len(rows))}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in links:
        for b in links[a]:
            root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(links[k]), min(ids) if ids else None))
    return out


def made(rng, n=400, dim=16):
    centres = rng.normal(size=(25, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, rng.normal(size=dim).astype(np.float32).tolist()))
        else:
            rows.append((i, (centres[i % 25] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("shard", [2000, 60])
def test_equals_brute_force(spark, shard):
    rows = made(np.random.default_rng(4))
    rows += [(1000, rows[1][1]), (1001, rows[1][1]), (5, rows[5][1])]  # copies, and a repeated row
    got = V.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard=shard).collect()
    want = sorted(brute(rows))
    have = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    found, true = sum(r[1] for r in have), sum(r[1] for r in want)
    assert found <= true and found >= 0.97 * true
    if shard == 2000:
        assert have == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    dim = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, dim), (8, [2.0, 4.0, 6.0]), (9, [1.0, 2.0]), (None, dim), (10, [-1.0, -2.0, -3.0]), (11, [1e30, 2e30, 3e30]), (12, [1e-30, 2e-30, 3e-30])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    for i in (1, 2, 3, 4, 5, 6, 9, 10):
        assert got[i] == (0, i, True)
    for i in (7, 8, 11, 12):
        assert got[i] == (4, 7, i == 7)
    assert got[None] == (4, 7, False)


def test_empty(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in V.near_vectors(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_robust_prune():
    x = V.unit(np.array([[1, 0], [1, 0.1], [1, 0.12], [0, 1.0]]))
    kept = V.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), 3)
    assert kept[0].tolist()[0] == 1 and 2 not in kept[0].tolist()


def test_graph_search_finds_ranges():
    rng = np.random.default_rng(2)
    x = V.unit(np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=24) + 0.15 * rng.normal(size=(120, 24))]))
    found = list(V.Graph(x, V.build(x, 1)).search(x, np.arange(len(x)), V.medoids_of(x)))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    truth = np.argwhere((x @ x.T >= V.NEAR) & ~np.eye(len(x), dtype=bool))
    assert len(a) >= 0.99 * len(truth)
    assert set(zip(a.tolist(), b.tolist())) <= set(map(tuple, truth.tolist()))


def test_audit(spark):
    rows = made(np.random.default_rng(6), 200)
    from quire.llm.common import Stage

    stage = Stage(spark, "test")
    _, nodes = V._nodes(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), "vec_id", "embedding", stage)
    none = spark.createDataFrame([], "node long, n long")
    assert V.audit_recall(nodes, none) == 0.0


def test_audit_sees_links_missed_at_both_ends(spark):
    from quire.llm.common import Stage

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32))
    x[1:240:2] = x[0:240:2] + 0.01 * rng.normal(size=(120, 32))  # 120 pairs among 4,000 vectors
    _, nodes = V._nodes(spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)], SCHEMA), "vec_id", "embedding", Stage(spark, "test"))
    half = nodes.filter("least < 120").select("node", V.F.lit(1).cast("long").alias("n"))
    assert 0.3 < V.audit_recall(nodes, half) < 0.7


def test_exact_where_no_overlap_suffices(spark, monkeypatch):
    rows = made(np.random.default_rng(9), 300)
    rows += [(1000, rows[1][1])]
    links, tried = V.Index.links, []

    def lossy(self):
        tried.append(self.name)
        counts, edges = links(self)
        return counts.limit(0), edges.limit(0)

    monkeypatch.setattr(V.Index, "links", lossy)
    got = V.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard=20).collect()
    assert tried == ["2", "4"]  # audited, and below the least recall, at both
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


def test_a_third_in_one_dense_cluster(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(6000, 32))
    x[::3] = 6 * x[0] / np.linalg.norm(x[0]) + 0.25 * rng.normal(size=(2000, 32))  # 2,000 of 6,000, most of them alike
    x[1::30] = x[2::30] + 0.02 * rng.normal(size=(200, 32))
    sizes, sent, init = [], [], V.Index.__init__

    def kept(self, *args):
        init(self, *args)
        sizes.extend(r["count"] for r in self.members.groupBy("unit").count().collect())

    monkeypatch.setattr(V.Index, "__init__", kept)
    monkeypatch.setattr(V.Index, "exact", lambda self: sent.append(1))
    got = {r.vec_id: r for r in V.near_vectors(spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)], SCHEMA), shard=150).collect()}
    assert max(sizes) <= 2 * 150 * 2 and not sent  # twice the target, and no fall-back
    unit = V.unit(x.astype(np.float32).astype(float))
    true = (unit @ unit.T >= V.NEAR).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() and true.sum() > 1_000_000
    lone = true == 1
    assert lone.sum() >= 300 and found[lone].sum() >= 0.97 * lone.sum()


def test_visitors_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(V, "VISITORS", 40)
    rows = made(np.random.default_rng(12), 300)
    got = V.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard=60).collect()
    assert sum(r.n_links for r in got) >= 0.97 * sum(r[1] for r in brute(rows))


def test_clashing_columns(spark):
    rows = [(i, [1.0, float(i % 2)], "x", 1, 2, True) for i in range(6)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, n_links long, shard int, kept boolean")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 2, i % 2) for i in range(6)]
