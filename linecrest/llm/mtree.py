"""Exact top-k inner products by best-first search of M-trees.

An inner product becomes a distance by one more component: with M the greatest norm, every vector x gets
sqrt(M^2 - |x|^2) and every query 0; then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the nearest vector has the greatest
product. The vectors are dealt to the nearest of at most `pivots` routing vectors, and the vectors of a pivot to trees of
about `tree_rows` each, so no pivot is one task. A tree is one row: its nodes hold a routing vector, a covering radius
and the distance to their parent. A search opens the node with the least lower bound first, and computes no distance
that the stored distances to the parent already rule out.

A query first searches one tree of its nearest pivot. Its k-th best score there rules out pivots whose balls are too far;
only the trees of the others are searched, in blocks of queries.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from . import common

LEAF, FANOUT = 256, 16
BLOCK = 256
_EXACT = float(1 << 52)


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as little-endian 64-bit integers. Rows whose vector is null, or
    holds null or a value that is not finite, are left out; so are rows without vec_id. A shorter vector counts as if it
    ended in zeros."""

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec_id, x in zip(batch["vec_id"], batch["embedding"], strict=True):
                v = np.floor(scale * np.asarray(x, float))
                rows.append((vec_id, v.astype("<i8").tobytes(), int(len(v)), float(v @ v)))
            yield pd.DataFrame(rows, columns=["vec_id", "v", "dims", "norm2"])

    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).mapInPandas(quantise, "vec_id long, v binary, dims int, norm2 double")


def _matrix(packed: Iterable[bytes], dims: int) -> np.ndarray:
    rows = [np.frombuffer(bytes(b), "<i8") for b in packed]
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Tree:
    """A bulk-loaded M-tree of integer vectors around a routing vector."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, root: np.ndarray, top: float):
        self.ids, self.top, self.exact = ids, top, top < _EXACT
        self.x = x.astype(float) if self.exact else x
        self.extra = np.sqrt(np.maximum(top - (self.x.astype(float) ** 2).sum(1), 0))
        self.nodes: list[dict] = []
        to_root = self._distances(np.arange(len(ids)), root.astype(float), float(np.sqrt(max(top - float(root.astype(float) @ root), 0))))
        self._build(np.arange(len(ids)), to_root)

    def _distances(self, rows: np.ndarray, router: np.ndarray, extra: float) -> np.ndarray:
        return np.sqrt(((self.x[rows].astype(float) - router) ** 2).sum(1) + (self.extra[rows] - extra) ** 2)

    def _build(self, rows: np.ndarray, to_parent: np.ndarray) -> int:
        """A node of these rows; to_parent: their distances to the node's routing vector."""
        me = len(self.nodes)
        self.nodes.append({})
        if len(rows) <= LEAF:
            self.nodes[me] = {"rows": rows, "far": to_parent}
            return me
        heads = rows[np.unique(np.linspace(0, len(rows) - 1, min(FANOUT, -(-len(rows) // LEAF))).astype(int))]
        apart = np.stack([self._distances(rows, self.x[h].astype(float), float(self.extra[h])) for h in heads])
        nearest = apart.argmin(0)
        if np.bincount(nearest).max() == len(rows):  # all at one place: any split does
            nearest = np.arange(len(rows)) % len(heads)
        children, radii, far, kept = [], [], [], []
        for i, h in enumerate(heads):
            own = nearest == i
            if own.any():
                kept.append(h)
                radii.append(float(apart[i, own].max()))
                far.append(float(to_parent[rows == h][0]))
                children.append(self._build(rows[own], apart[i, own]))
        self.nodes[me] = {"heads": np.array(kept), "radii": np.array(radii), "far": np.array(far), "children": children}
        return me

    def pack(self) -> bytes:
        """Pages lie one after the other, so that a page's vectors are one block."""
        out = io.BytesIO()
        pages = [n["rows"] for n in self.nodes if "rows" in n]
        order = np.concatenate(pages)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.x, self.extra = self.ids[order], self.x[order], self.extra[order]
        for n in self.nodes:
            key = "rows" if "rows" in n else "heads"
            n[key] = place[n[key]]
        inner = [i for i, n in enumerate(self.nodes) if "heads" in n]
        leaf = [i for i, n in enumerate(self.nodes) if "rows" in n]
        join = lambda key, which, kind: np.concatenate([np.asarray(self.nodes[i][key], kind) for i in which] or [np.empty(0, kind)])
        np.savez(out, ids=self.ids, x=self.x.astype(np.int64), top=np.array([self.top]), inner=inner, leaf=leaf, inner_n=[len(self.nodes[i]["heads"]) for i in inner], leaf_n=[len(self.nodes[i]["rows"]) for i in leaf], heads=join("heads", inner, np.int64), radii=join("radii", inner, float), child=join("children", inner, np.int64), inner_far=join("far", inner, float), rows=join("rows", leaf, np.int64), leaf_far=join("far", leaf, float))
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        me = cls.__new__(cls)
        me.ids, me.top = z["ids"], float(z["top"][0])
        me.exact = me.top < _EXACT
        me.x = z["x"].astype(float) if me.exact else z["x"]
        me.nodes = [{} for _ in range(len(z["inner"]) + len(z["leaf"]))]
        at = 0
        heads, radii, child, far = z["heads"], z["radii"], z["child"], z["inner_far"]
        for i, n in zip(z["inner"].astype(int), z["inner_n"].astype(int), strict=True):
            me.nodes[i] = {"heads": heads[at : at + n], "radii": radii[at : at + n], "far": far[at : at + n], "children": child[at : at + n].tolist()}
            at += n
        at, rows, far = 0, z["rows"], z["leaf_far"]
        for i, n in zip(z["leaf"].astype(int), z["leaf_n"].astype(int), strict=True):
            me.nodes[i] = {"rows": rows[at : at + n], "far": far[at : at + n]}
            at += n
        return me

    def search(self, query_ids: list[int], q: np.ndarray, to_root: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """For a block of queries the (score, vec_id) of the k best of this tree but the query's own, equal scores by
        smaller id. floors: scores that at least k vectors are known to reach; what is below them is of no use. The node
        with the least lower bound of any query is opened first, for the queries that it may still serve."""
        found: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # heaps: the worst first, as (score, -vec_id)
        q = q.astype(float) if self.exact else q
        both = (q.astype(float) ** 2).sum(1) + self.top
        slack = 1e-6 * (1 + np.sqrt(both))
        floor = floors.astype(float).copy()
        limit = np.sqrt(np.maximum(both - 2 * floor, 0)) + slack  # beyond it nothing counts
        everyone = np.arange(len(query_ids))
        queue, pushed = [(0.0, 0, 0, everyone, to_root, np.zeros(len(query_ids)))], 0
        while queue:
            _, _, at, live, d, low = heapq.heappop(queue)
            serves = low <= limit[live]
            if not serves.any():
                continue
            live, d, low, node = live[serves], d[serves], low[serves], self.nodes[at]
            near = np.abs(node["far"] - d[:, None]) - node.get("radii", 0) <= limit[live, None]  # without a distance
            wanted = np.flatnonzero(near.any(0))
            if not len(wanted):
                continue
            if "rows" in node:
                whole = 2 * len(wanted) > near.shape[1]  # then the page is one block
                first = int(node["rows"][0])
                x = self.x[first : first + near.shape[1]] if whole else self.x[node["rows"][wanted]]
                near = near if whole else near[:, wanted]
                scores = np.where(near, q[live] @ x.T, -self.top - 2)
                least = floor[live]
                if scores.shape[1] > k + 1:  # the page's own k best, one of which may be the query's row
                    least = np.maximum(least, np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1])
                for i, j in zip(*(v.tolist() for v in np.nonzero(near & (scores >= least[:, None]))), strict=True):
                    me = int(live[i])
                    vec_id = int(self.ids[first + j if whole else node["rows"][wanted[j]]])
                    if vec_id == query_ids[me]:
                        continue
                    item, mine = (int(scores[i, j]), -vec_id), found[me]
                    if len(mine) < k:
                        heapq.heappush(mine, item)
                    elif item > mine[0]:
                        heapq.heapreplace(mine, item)
                    if len(mine) == k and mine[0][0] > floor[me]:
                        floor[me] = mine[0][0]
                limit = np.sqrt(np.maximum(both - 2 * floor, 0)) + slack
                continue
            away = np.sqrt(np.maximum(both[live, None] - 2 * (q[live] @ self.x[node["heads"][wanted]].T).astype(float), 0))
            bound = np.maximum(low[:, None], away - node["radii"][wanted])
            open_to = near[:, wanted] & (bound <= limit[live, None])
            for c, child in enumerate(wanted.tolist()):
                own = np.flatnonzero(open_to[:, c])
                if len(own):
                    pushed += 1
                    heapq.heappush(queue, (float(bound[own, c].min()), pushed, node["children"][child], live[own], away[own, c], bound[own, c]))
        return [[(score, -v) for score, v in mine] for mine in found]


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 96, tree_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all vectors for each query, a row whose vec_id is divisible by
    `every`. A query's own row is the one with its vec_id. Repeated rows count one by one as candidates; of queries with
    the same vec_id one (the least vector) asks. Fewer candidates than k are all returned; no vectors give no rows."""
    spark = embeddings.sparkSession
    schema = "query_id long, vec_id long, score long"
    rows = common.stage(vectors(embeddings, scale), "vectors")
    facts = rows.agg(F.max("dims").alias("dims"), F.max("norm2").alias("top"), F.count("*").alias("n")).collect()[0]
    dims, top = int(facts["dims"] or 0), float(facts["top"] or 0)
    # the routing vectors are a bounded sample; every row is indexed
    heads = _matrix([r["v"] for r in rows.select("v", F.xxhash64("v", "vec_id").alias("h")).orderBy("h").limit(max(1, min(pivots, int(facts["n"]) // tree_rows))).collect()], dims).astype(float)
    extra = np.sqrt(np.maximum(top - (heads**2).sum(1), 0))
    shared = spark.sparkContext.broadcast((heads, extra))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, extra = shared.value
        for batch in batches:
            x = _matrix(batch["v"], dims).astype(float)
            own = np.sqrt(np.maximum(top - (x**2).sum(1), 0))
            d2 = (x**2).sum(1)[:, None] + (heads**2).sum(1) - 2 * x @ heads.T + (own[:, None] - extra) ** 2
            pivot = d2.argmin(1).astype(np.int32) if len(x) else np.empty(0, np.int32)
            d = np.sqrt(((x - heads[pivot]) ** 2).sum(1) + (own - extra[pivot]) ** 2) if len(x) else np.empty(0)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "pivot": pivot, "far": d})

    dealt = common.stage(rows.select("vec_id", "v").mapInPandas(deal, "vec_id long, v binary, pivot int, far double"), "dealt")
    cells = {r["pivot"]: (int(r["n"]), float(r["radius"])) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row per pivot
    split = F.create_map(*(F.lit(x) for p, (n, _) in cells.items() for x in (p, -(-n // tree_rows)))) if cells else F.create_map(F.lit(-1), F.lit(1))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, _ = shared.value
        pdf = pdf.sort_values(["place", "vec_id"])
        pivot = int(pdf["pivot"].iloc[0])
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], dims), heads[pivot], top)
        return pd.DataFrame({"pivot": [pivot], "tree": [int(pdf["tree"].iloc[0])], "packed": [tree.pack()]})

    place = F.xxhash64("v", "vec_id")
    trees = common.stage(dealt.withColumn("place", place).withColumn("tree", F.pmod("place", split[F.col("pivot")]).cast("int")).groupBy("pivot", "tree").applyInPandas(grow, "pivot int, tree int, packed binary"), "trees")
    queries = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("v", "pivot"), F.struct("v")).alias("q")).select(F.col("vec_id").alias("query_id"), F.col("q.v").alias("q"), F.col("q.pivot").alias("pivot"))

    tasks = max(spark.sparkContext.defaultParallelism, 4 * len(cells), sum(-(-n // tree_rows) for n, _ in cells.values()))

    def ask(asked: DataFrame, keys: list[str]) -> DataFrame:
        """asked: keys, query_id, q, floor. Searches every tree that has a query's keys, BLOCK queries or so at a time. A
        tree goes to one task, and blocks of queries to each of its trees; neither passes the driver, as a broadcast
        would, which Catalyst plans since it takes collected blocks for far smaller than they are."""
        size = asked.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        blocks = asked.join(size, keys).withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks")).groupBy(*keys, "_block").agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("asked"))
        if "tree" not in keys:
            blocks = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), split[F.col("pivot")].cast("int") - 1)))
        placed = [x.repartition(tasks, "pivot", "tree") for x in (blocks.select("pivot", "tree", "asked"), trees)]
        met = placed[0].join(placed[1].hint("merge"), ["pivot", "tree"]).select("pivot", "tree", "asked", "packed")

        def look(part: Iterable[Row]) -> Iterator[tuple]:
            heads, extra = shared.value
            at, tree = None, None
            for row in part:
                if at != (row["pivot"], row["tree"]):
                    at, tree = (row["pivot"], row["tree"]), Tree.unpack(bytes(row["packed"]))
                head = heads[row["pivot"]]
                q = _matrix([a["q"] for a in row["asked"]], dims)
                d = np.sqrt(((q - head) ** 2).sum(1) + extra[row["pivot"]] ** 2)
                ids = [a["query_id"] for a in row["asked"]]
                for query_id, best in zip(ids, tree.search(ids, q, d, k, np.array([a["floor"] for a in row["asked"]])), strict=True):
                    for score, vec_id in best:
                        yield query_id, vec_id, score

        return spark.createDataFrame(met.rdd.mapPartitions(look), schema)

    nothing = -float(top) - 1
    first = ask(queries.withColumn("tree", F.pmod(F.xxhash64("query_id"), split[F.col("pivot")]).cast("int")).withColumn("floor", F.lit(nothing)), ["pivot", "tree"])
    floors = common.stage(first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")), "floors")
    radii = np.array([cells.get(p, (0, -1.0))[1] for p in range(len(heads))])
    shared_radii = spark.sparkContext.broadcast(radii)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, extra = shared.value
        radii = shared_radii.value
        for batch in batches:
            q = _matrix(batch["q"], dims).astype(float)
            both = (q**2).sum(1) + top
            d = np.sqrt(np.maximum(both[:, None] - 2 * q @ heads.T, 0))
            limit = np.sqrt(np.maximum(both - 2 * batch["floor"].to_numpy(float), 0)) + 1e-6 * (1 + np.sqrt(both))
            i, p = np.nonzero((d - radii <= limit[:, None]) & (radii >= 0))
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[i], "q": batch["q"].to_numpy()[i], "floor": batch["floor"].to_numpy()[i], "pivot": p.astype(np.int32)})

    known = queries.drop("pivot").join(floors, "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(nothing)).alias("floor"))
    everywhere = common.stage(known.mapInPandas(reach, "query_id long, q binary, floor double, pivot int"), "reach")
    found = ask(everywhere, ["pivot"])
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
