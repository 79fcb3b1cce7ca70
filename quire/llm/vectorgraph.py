"""Operator 5: near-duplicate embeddings by a robust-pruned flat graph.

1. Null, zero and non-finite vectors link with nothing; equal vectors are collapsed into one node that
   counts as often as it occurs.
2. Nodes are dealt to overlapping cluster shards: each to the ``OVERLAP`` nearest of the centres, which come from
   halving a bounded sample (``SAMPLE`` vectors, at most ``CENTRES`` centres), the largest part first, so dense
   regions get more of them. The nearest shard is a node's home. A shard whose members still exceed twice the target
   (``shard`` x overlap) is split by hash into parts within it, and what visits the shard visits every part.
3. Each part builds a graph: a node's nearest members, robust-pruned (a candidate that an already
   chosen neighbour is ``ALPHA`` times nearer to goes) to ``DEGREE``, and ``FAR`` pruned random members, which
   keep the graph connected; edges also lead back. A node's adjacency lists of all its shards are united.
4. Every node visits its shards: it searches the united graph greedily from the part's medoids with a beam of ``BEAM``,
   and then expands the range: every node found within the threshold is expanded in turn, until no new one is found, so a
   result has no fixed size. Where that costs more than reading the part's members, the node is compared with them all.
5. A link is verified by its cosine in double precision. It is counted where its other end is at home, so no pair is
   counted twice and none is sent on. Where a link leads to a node of another home, the one node visits the home of the
   other in the next round, until no round brings a new visit: links of a dense region are followed through all its shards.
6. Recall is audited at every overlap: nodes drawn by hash, whatever was found of them, are compared with all nodes by brute
   force, in blocks, until they hold ``AUDIT_LINKED`` nodes that have a link, or ``AUDIT_MOST`` or all nodes are drawn. Below
   ``RECALL`` the overlap is doubled once; below it again, every node is compared with every member of each shard that can
   hold a link of it: those whose centre is no farther than the threshold's angle and the shard's radius together.

Memory: a task holds one part and at most some ``VISITORS`` nodes that visit it, however skewed the vectors are; links are
counted a batch of queries at a time and not kept. Up to SHARD x CENTRES nodes (8 million) a shard is one part or a few;
beyond, a node's visits grow with the parts. Components come from one edge for each node and part.

Defined results: vectors of another length than most are invalid (ties: the shorter length counts).
Null ids form rows of their own; they never name a component. Repeated rows link with each other (equal vectors have cosine 1). An
empty table gives an empty result. Labels and other columns are ignored.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stage
from quire.llm.components import components

NEAR = 0.9
SHARD, CENTRES, SAMPLE, OVERLAP, MOST_OVERLAP = 2000, 4096, 20_000, 2, 4
DEGREE, FAR, CANDIDATES, ALPHA, BEAM, MEDOIDS = 24, 8, 48, 1.2, 32, 8
AUDIT, RECALL = 1024, 0.97
#: Nodes with a true link that an audit is to hold, nodes of one block of it at most, and of all its blocks.
AUDIT_LINKED, AUDIT_BLOCK, AUDIT_MOST = 128, 4096, 65_536
#: Nodes that visit a part in one task, about.
VISITORS = 16_000
#: Pairs of a query and a neighbour that are handled together, and queries.
PAIRS, TOGETHER = 200_000, 512

log = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (scaled by their greatest component first, so no square overflows or vanishes)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _halves(x: np.ndarray) -> np.ndarray:
    """Which rows go to the second of two parts: the nearer to the second of two means; the part is halved where one is small."""
    one = x[(x @ x[0]).argmin()]
    two = x[(x @ one).argmin()]
    for _ in range(3):
        second = x @ (two - one) > 0
        if second.all() or not second.any():
            break
        one, two = x[~second].mean(0), x[second].mean(0)
    along = x @ (two - one)
    second = along > 0
    return second if 0.25 <= second.mean() <= 0.75 else np.argsort(np.argsort(along, kind="stable"), kind="stable") >= len(x) // 2


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """The mean directions of ``k`` parts at most of the sample, the largest part halved first."""
    parts = [(-len(sample), 0, np.arange(len(sample)))]
    while len(parts) < min(k, len(sample)):
        size, _, rows = parts[0]
        if size > -2:
            break
        second = _halves(sample[rows])
        heapq.heapreplace(parts, (-int((~second).sum()), 2 * len(parts), rows[~second]))
        heapq.heappush(parts, (-int(second.sum()), 2 * len(parts) + 1, rows[second]))
    means = np.stack([sample[rows].mean(0) for _, _, rows in sorted(parts, key=lambda x: x[1])])
    size = np.sqrt((means * means).sum(1))
    means[size <= 1e-9] = sample[0]
    return unit(means)


def robust_prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """For each row up to ``degree`` of its candidates (nearest first; -1 where there are fewer)."""
    n, c = candidates.shape
    valid = candidates >= 0
    points = x[np.maximum(candidates, 0)]
    to_row = 1 - np.einsum("ncd,nd->nc", points, x[rows])
    to_row[~valid] = np.inf
    order = np.argsort(to_row, axis=1, kind="stable")
    candidates, to_row = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_row, order, 1)
    points = np.take_along_axis(points, order[:, :, None], 1)
    alive, out, count = np.isfinite(to_row), np.full((n, degree), -1), np.zeros(n, np.int64)
    every = np.arange(n)
    for k in range(c):
        take = alive[:, k] & (count < degree)
        if not take.any():
            continue
        r = every[take]
        out[r, count[r]] = candidates[r, k]
        count[r] += 1
        if k + 1 < c:
            between = 1 - np.einsum("ncd,nd->nc", points[r, k + 1 :], points[r, k])
            alive[r, k + 1 :] &= alpha * between > to_row[r, k + 1 :]
    return out


def build(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """The adjacency lists of a shard's members (unit rows)."""
    n, rng = len(x), np.random.default_rng(seed)
    if n == 1:
        return [np.zeros(0, np.int64)]
    near = np.empty((n, min(CANDIDATES, n - 1)), np.int64)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
        near[at : at + 512] = np.argpartition(-sims, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    far = rng.integers(0, n, (n, 2 * FAR))
    far[far == np.arange(n)[:, None]] = -1
    left, right = [], []
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        for candidates, degree in ((near, DEGREE), (far, FAR)):
            kept = robust_prune(x, rows, candidates[rows], degree)
            r, c = np.nonzero(kept >= 0)
            left.append(rows[r])
            right.append(kept[r, c])
    a, b = np.concatenate(left), np.concatenate(right)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))  # edges lead back
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def medoids_of(x: np.ndarray) -> np.ndarray:
    """Members nearest to the means of a few clusters of the shard."""
    means = centres_of(x[:: max(1, len(x) // 512)], MEDOIDS)
    return np.unique(np.concatenate([(x @ x.mean(0)).argmax(keepdims=True), (x @ means.T).argmax(0)]))


class Graph:
    """A shard's members and united lists, searched by many queries at once."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x, self.n = x, len(x)
        self.size = np.array([len(v) for v in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.zeros(0, np.int64), *lists])

    def _around(self, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, neighbour) pairs of (query, node) pairs, each once."""
        size = self.size[nodes]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        code = np.unique(np.repeat(queries, size) * self.n + self.flat[np.repeat(self.start[nodes], size) + offset])
        return code // self.n, code % self.n

    def search(self, queries: np.ndarray, own: np.ndarray, medoids: np.ndarray, near: float = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs within the threshold, a batch of queries at a time; own: a query's own place, or -1."""
        for at in range(0, len(queries), TOGETHER):
            a, b = self._search(queries[at : at + TOGETHER], own[at : at + TOGETHER], medoids, near)
            yield at + a, b

    def scan(self, queries: np.ndarray, own: np.ndarray, near: float = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same pairs by comparing every query with every member."""
        for at in range(0, len(queries), TOGETHER):
            a, b = np.nonzero(queries[at : at + TOGETHER] @ self.x.T >= near)
            other = b != own[at + a]
            yield at + a[other], b[other]

    def _search(self, queries: np.ndarray, own: np.ndarray, medoids: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(queries), self.n
        seen = np.zeros((q, n), bool)
        hits: list[np.ndarray] = []

        def visit(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Similarities of pairs not seen before; those within the threshold are kept."""
            fresh = ~seen[query, node]
            query, node = query[fresh], node[fresh]
            seen[query, node] = True
            sims = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", queries[query[k : k + PAIRS]], self.x[node[k : k + PAIRS]]) for k in range(0, len(query), PAIRS))])
            hits.append((query * n + node)[sims >= near])
            return query, node, sims

        # greedy: the best unexpanded entry of each query's beam is expanded, until the beams stay
        query, node = np.repeat(np.arange(q), len(medoids)), np.tile(medoids, q)
        beam, score, done = np.full((q, BEAM), -1), np.full((q, BEAM), -np.inf), np.ones((q, BEAM), bool)
        for _ in range(n):
            query, node, sims = visit(query, node)
            if len(query):
                rank = np.lexsort((-sims, query))
                query, node, sims = query[rank], node[rank], sims[rank]
                first = np.searchsorted(query, np.arange(q))
                place = np.arange(len(query)) - first[query]
                query, node, sims, place = (v[place < BEAM] for v in (query, node, sims, place))
                more, more_score = np.full((q, BEAM), -1), np.full((q, BEAM), -np.inf)
                more[query, place], more_score[query, place] = node, sims
                every, scores, flags = np.hstack([beam, more]), np.hstack([score, more_score]), np.hstack([done, more < 0])
                best = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
                beam, score, done = (np.take_along_axis(v, best, 1) for v in (every, scores, flags))
            todo = np.flatnonzero(~done.all(1))
            if not len(todo):
                break
            pick = (~done[todo]).argmax(1)
            done[todo, pick] = True
            query, node = self._around(todo, beam[todo, pick])

        # range expansion: all that is within the threshold, and the query's own node, is expanded
        member = np.flatnonzero(own >= 0)
        code = np.unique(np.concatenate([*hits, member * n + own[member]]))
        expanded, cost, degree = np.zeros((q, n), bool), np.zeros(q), max(1.0, len(self.flat) / n)
        while len(code):
            # what would cost more than reading all members reads them
            cost += degree * np.bincount(code // n, minlength=q)
            whole = cost > n
            if whole.any():
                a, b = np.nonzero(queries[whole] @ self.x.T >= near)
                hits.append(np.flatnonzero(whole)[a] * n + b)
                code = code[~whole[code // n]]
            expanded[code // n, code % n] = True
            hits_before = len(hits)
            for at in range(0, len(code), PAIRS // 16):
                part = code[at : at + PAIRS // 16]
                visit(*self._around(part // n, part % n))
            code = np.unique(np.concatenate([np.zeros(0, np.int64), *hits[hits_before:]]))
            code = code[~expanded[code // n, code % n] & ~whole[code // n]]
        pair = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]))
        a, b = pair // n, pair % n
        other = b != own[a]
        return a[other], b[other]


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, hash, v or null; nodes: node, hash, v, weight, least id), both written."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x + 0.0)).alias("v"))
    lengths = rows.filter("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0]["n"] if lengths else 0
    rows = rows.withColumn("v", F.when(F.size("v") == length, F.col("v"))).withColumn("hash", F.xxhash64("v"))
    nodes = rows.filter("v is not null").groupBy("hash", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    # ids are drawn once: the written table fixes them
    return rows, stage.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sample(nodes: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` nodes' vectors, chosen by hash."""
    got = nodes.select("v", F.xxhash64(F.lit(seed), "hash").alias("h"), "node").orderBy("h", "node").limit(n).select("v").toArrow()
    return unit(_vectors(got.column(0).combine_chunks())) if got.num_rows else np.zeros((0, 1))


def _homes(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(node, weight, v, home, shards, far): a node's nearest shards, and the cosine between it and its home's centre."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        m = min(overlap, len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sims = unit(_vectors(part.column(2))) @ centres.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :m]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * part.num_rows + 1, m), pa.int32()), pa.array(best.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best[:, 0], pa.int64()), lists, pa.array(sims[np.arange(len(sims)), best[:, 0]])], names=["node", "weight", "v", "home", "shards", "far"])

    return nodes.select("node", "weight", "v").mapInArrow(run, "node long, weight long, v array<double>, home long, shards array<long>, far double")


def _by_shard(spark, values: dict[int, tuple], schema: str) -> DataFrame:
    """A small table with a row for each shard, at most CENTRES of them."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in sorted(values.items())], schema))


def _built(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    node = table.column("node").to_numpy()
    lists = build(unit(_vectors(table.column("v").combine_chunks())), int(table.column("unit")[0].as_py()))
    return pa.table({"node": node, "near": pa.array([node[x] for x in lists], pa.list_(pa.int64()))})


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of every node's component, from those before (``root``) and further edges."""
    pair = np.unique(np.column_stack([root[a], root[b]]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    while len(pair := pair[pair[:, 0] != pair[:, 1]]):
        low, high = pair.min(1), pair.max(1)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        pair = np.unique(root[pair], axis=0)
    return root


def _visited(near: float, exact: bool):
    def run(table: pa.Table) -> pa.Table:
        """What visitors (``asks``) find among a part's members: kind 0 counts (node, weight of its links to nodes at home
        here), 1 edges (node, one of its component), 2 visits to make (node, shard)."""
        table = table.sort_by([("asks", "ascending"), ("node", "ascending")])
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        m, shard = int((~asks).sum()), table.column("shard")[0].as_py()
        node, home, weight = (table.column(k).to_numpy() for k in ("node", "home", "weight"))
        x = unit(_vectors(table.column("v").combine_chunks()))
        member, visitor = node[:m], node[m:]
        at = np.minimum(np.searchsorted(member, visitor), max(m - 1, 0))
        own = np.where(member[at] == visitor, at, -1) if m else np.full(len(visitor), -1)
        lists = []
        if not exact:
            for cell in table.column("near").slice(0, m):
                other = cell.values.to_numpy() if cell.as_py() is not None else np.zeros(0, np.int64)
                place = np.minimum(np.searchsorted(member, other), m - 1)
                lists.append(np.unique(place[member[place] == other]))
        graph = Graph(x[:m], lists)
        found = () if not m or m == len(node) else graph.scan(x[m:], own, near) if exact else graph.search(x[m:], own, medoids_of(x[:m]), near)
        # places in the component search: members first, then visitors that aren't members
        spot = np.where(own >= 0, own, m + np.arange(len(visitor)))
        root, total, routes = np.arange(m + len(visitor)), np.zeros(len(visitor), np.int64), [np.zeros((0, 2), np.int64)]
        for a, b in found:
            here = home[b] == shard
            total += np.bincount(a[here], weight[b[here]], len(visitor)).astype(np.int64)
            root = _joined(root, spot[a], b)
            if not exact:
                there = home[m + a] != shard
                routes.append(np.unique(np.concatenate([np.column_stack([visitor[a[~here]], home[b[~here]]]), np.column_stack([member[b[there]], home[m + a[there]]])]), axis=0))
        some, star = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(root)))
        route = np.unique(np.concatenate(routes), axis=0)
        kinds = np.repeat([0, 1, 2], [len(some), len(star), len(route)])
        left = np.concatenate([visitor[some], node[star], route[:, 0]])
        right = np.concatenate([total[some], node[root[star]], route[:, 1]])
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


class Index:
    """The shards of all nodes at an overlap, and the visits to them."""

    def __init__(self, nodes: DataFrame, centres: np.ndarray, overlap: int, shard: int, near: float, stage: Stage):
        self.spark, self.stage, self.near, self.name, self.centres = nodes.sparkSession, stage, near, str(overlap), centres
        self.homes = stage.keep(_homes(nodes, centres, overlap), f"homes-{overlap}")
        placed = self.homes.select(F.explode("shards").alias("shard"), "node", "weight", "home", "v")
        bound = 2 * shard * overlap
        sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # at most CENTRES rows
        self.parts = {k: 1 if n <= bound else -(-4 * n // (3 * bound)) for k, n in sizes.items()}
        first = dict(zip(self.parts, np.cumsum([0, *self.parts.values()]).tolist(), strict=False))
        units = _by_shard(self.spark, {k: (n, first[k]) for k, n in self.parts.items()}, "shard long, parts long, first long")
        self.units = units
        members = placed.join(units, "shard").select("shard", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("unit"), "node", "weight", "home", "v")
        self.members = stage.keep(members, f"members-{overlap}")
        lists = self.members.groupBy("unit").applyInArrow(_built, "node long, near array<long>")
        united = stage.keep(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"lists-{overlap}")  # at most one list a shard
        self.graph = stage.keep(self.members.join(united, "node", "left"), f"graph-{overlap}")

    def visits(self, who: DataFrame, name: str, exact: bool = False) -> DataFrame:
        """The results (kind, a, b) of visits (node, shard)."""
        callers = {r["shard"]: r["count"] for r in who.groupBy("shard").count().collect()}  # at most CENTRES rows
        if not callers:
            return self.spark.createDataFrame([], "kind int, a long, b long")
        chunks = _by_shard(self.spark, {k: (-(-n // VISITORS),) for k, n in callers.items()}, "shard long, chunks long")
        members = self.graph.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        members = members.select("unit", "chunk", "shard", F.lit(False).alias("asks"), "node", "weight", "home", "v", "near")
        asks = who.join(chunks, "shard").join(self.units, "shard").join(self.homes.select("node", "home", "v"), "node")
        asks = asks.withColumn("unit", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
        asks = asks.select("unit", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).alias("chunk"), "shard", F.lit(True).alias("asks"), "node", F.lit(0).cast("long").alias("weight"), "home", "v", F.lit(None).cast("array<long>").alias("near"))
        return self.stage.keep(members.unionByName(asks).groupBy("unit", "chunk").applyInArrow(_visited(self.near, exact), "kind int, a long, b long"), f"found-{self.name}-{name}")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(counts: node, n; edges: a, b), found through the united graph, round by round."""
        now = self.homes.select("node", F.explode("shards").alias("shard"))
        been, found, k = now, None, 0
        while True:
            got = self.visits(now, str(k))
            found = got if found is None else found.unionByName(got)
            more = got.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("shard")).distinct()
            k += 1
            now = self.stage.keep(more.join(been, ["node", "shard"], "left_anti"), f"visits-{self.name}-{k}")
            if now.isEmpty():
                return self._told(found, "graph")
            been = been.unionByName(now)

    def exact(self) -> tuple[DataFrame, DataFrame]:
        """The same by comparing every node with every member of each shard that can hold a link of it."""
        radius = np.zeros(len(self.centres))
        for r in self.homes.groupBy("home").agg(F.min("far").alias("far")).collect():  # at most CENTRES rows
            radius[r["home"]] = np.arccos(np.clip(r["far"], -1, 1))
        shared = self.spark.sparkContext.broadcast((self.centres, radius + np.arccos(self.near) + 1e-6, np.isin(np.arange(len(radius)), list(self.parts))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, reach, held = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    row, shard = np.nonzero((np.arccos(np.clip(unit(_vectors(part.column(1))) @ centres.T, -1, 1)) <= reach) & held)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(shard, pa.int64())], names=["node", "shard"])

        who = self.stage.keep(self.homes.select("node", "v").mapInArrow(run, "node long, shard long"), f"reach-{self.name}")
        return self._told(self.visits(who, "exact", exact=True), "exact")

    def _told(self, found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        counts = self.stage.keep(found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n")), f"counts-{self.name}-{name}")
        return counts, found.filter("kind = 1").select("a", "b")


def _true_links(nodes: DataFrame, ids: np.ndarray, queries: np.ndarray, near: float) -> np.ndarray:
    """The weight of all links of each query, by brute force."""
    shared = nodes.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                hit = unit(_vectors(part.column(2))) @ queries.T >= near
                hit &= part.column(0).to_numpy()[:, None] != ids
                total += (hit * part.column(1).to_numpy()[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)), pa.int64()), pa.array(total, pa.int64())], names=["q", "n"])

    truth = {r["q"]: r["n"] for r in nodes.select("node", "weight", "v").mapInArrow(run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()}
    return np.array([truth.get(k, 0) for k in range(len(ids))])


def audit_recall(nodes: DataFrame, counts: DataFrame, near: float = NEAR, sample: int = AUDIT, seed: int = 1, linked: int = AUDIT_LINKED) -> float:
    """Found links over links by brute force, of nodes drawn without regard to what was found (1.0 without links).

    ``sample`` nodes first; as long as fewer than ``linked`` of the drawn have a link, four times as many further ones,
    compared in blocks, up to ``AUDIT_MOST`` or all nodes.
    """
    weighed = nodes.join(counts, "node", "left").select("node", "hash", "v", F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64(F.lit(seed), "hash").alias("h"))
    have = want = held = drawn = 0
    last, size = None, sample
    while held < linked and drawn < AUDIT_MOST:
        rest = weighed if last is None else weighed.filter((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("node") > last[1])))
        got = rest.orderBy("h", "node").limit(size).select("node", "v", "n", "h").toArrow()
        if not got.num_rows:
            break
        true = _true_links(nodes, got.column("node").to_numpy(), unit(_vectors(got.column("v").combine_chunks())), near)
        have, want, held = have + int(np.minimum(got.column("n").to_numpy(), true).sum()), want + int(true.sum()), held + int((true > 0).sum())
        drawn += got.num_rows
        last, size = (got.column("h")[-1].as_py(), got.column("node")[-1].as_py()), min(4 * size, AUDIT_BLOCK)
    return have / want if want else 1.0


def near_vectors(vectors: DataFrame, near: float = NEAR, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (least id of its component), kept."""
    stage = Stage(vectors.sparkSession, "vectorgraph")
    rows, nodes = _nodes(vectors, id_col, vector_col, stage)
    n = nodes.count()
    centres = centres_of(_sample(nodes, SAMPLE, 0), min(CENTRES, -(-n // shard))) if n else np.zeros((0, 1))
    for overlap in (OVERLAP, MOST_OVERLAP) if n else ():
        index = Index(nodes, centres, min(overlap, len(centres)), shard, near, stage)
        counts, edges = index.links()
        recall = audit_recall(nodes, counts, near)
        log.info("recall %.4f at overlap %d", recall, overlap)
        if recall >= RECALL:
            break
    else:
        if n:
            counts, edges = index.exact()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(edges, stage)
    placed = nodes.join(counts, "node", "left").join(roots, "node", "left").select("hash", F.col("v").alias("__v"), "weight", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    placed = stage.keep(placed, "placed")
    least = stage.keep(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage.keep(placed.join(least, "root").select("hash", "__v", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter("v is not null").join(named, "hash").filter("v = __v").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
