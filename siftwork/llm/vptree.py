"""Nearest neighbours by vantage-point trees, one tree per shard, for the largest inner product.

Vectors are lifted by one coordinate so that all of a shard have the same norm M: x' = (x, sqrt(M^2 - |x|^2)). For queries
q' = (q, 0) then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so that the nearest by distance has the largest inner product and the
triangle inequality holds. A node's subtree is skipped if the distance to its shell exceeds the query's worst kept distance
divided by `factor`: 1 restores exact search, larger factors skip more and may miss some.

Index and queries are packed into rows of a bounded number of vectors; each block of queries meets each shard once, in a join by
shard and slice of SLICE blocks (a shard is repeated for each slice, and its tree built there), so that there are more tasks than shards
where there are many queries, and only the best `k` of every meeting are shuffled. Scores are computed on the original vectors in double precision,
component by component from the first, so equal vectors have equal scores wherever they lie.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows with a null id or a
dimension other than the query's. Ties go to the smaller id; rows with the same id are separate candidates. Extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 8192, 256
LEAF = 256
#: Blocks of queries that share one task's tree.
SLICE = 4
_SLACK = 1e-9


def usable(v: Column) -> Column:
    """A vector with a direction: no null, no component that isn't finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """Over the rows of points: nodes are (vantage point, inner radii, outer radii, children) or leaves of row numbers."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.p, self.rng = points, np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if len(rows) <= LEAF:
                self.nodes.append([None, rows])
                continue
            v = rows[self.rng.integers(len(rows))]
            d = np.sqrt(np.maximum(((points[rows] - points[v]) ** 2).sum(1), 0))
            mid = np.median(d)
            near = d <= mid
            if near.all():  # many equal distances: no shell parts them
                near = d < mid
                if not near.any():
                    self.nodes.append([None, rows])
                    continue
            a, b = d[near], d[~near]
            self.nodes.append([v, (a.min(), a.max(), b.min(), b.max()), None, None])
            todo += [(rows[near], me, 2), (rows[~near], me, 3)]

    def search(self, queries: np.ndarray, k: int, factor: float, ids: np.ndarray | None = None, own: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the rows of at least its k nearest points, those at the kth's distance included; rows whose id is own[i] don't count.

        All queries that reach a node are handled there together.
        """
        n = len(queries)
        best = np.full((n, k), np.inf)
        worst = np.full(n, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(n), np.zeros(n))] if len(self.p) and n else []
        while todo:
            at, qs, least = todo.pop()
            live = least * factor <= worst[qs] * (1 + _SLACK) + _SLACK
            qs = qs[live]
            if not len(qs):
                continue
            node = self.nodes[at]
            if node[0] is None:
                rows = node[1]
                d = self._distances(queries[qs], rows)
                if own is not None:
                    d[ids[rows][None] == own[qs][:, None]] = np.inf
                near = d.min(1) <= worst[qs] * (1 + _SLACK) + _SLACK
                qs, d = qs[near], d[near]
                if len(qs):
                    both = np.concatenate([best[qs], d], 1)
                    both.partition(k - 1, 1)
                    best[qs] = both[:, :k]
                    worst[qs] = both[:, :k].max(1)
                    i, j = np.nonzero((d <= worst[qs][:, None] * (1 + _SLACK) + _SLACK) & np.isfinite(d))
                    found.append((qs[i], rows[j], d[i, j]))
                continue
            v, (a0, a1, b0, b1), near, far = node
            d = self._distances(queries[qs], np.array([v]))[:, 0]
            to_near = np.maximum(0, np.maximum(a0 - d, d - a1))
            to_far = np.maximum(0, np.maximum(b0 - d, d - b1))
            first = to_near <= to_far
            # each query's nearer side is searched first: it lies on top
            for pick, later, sooner in ((first, (far, to_far), (near, to_near)), (~first, (near, to_near), (far, to_far))):
                if pick.any():
                    todo += [(child, qs[pick], low[pick]) for child, low in (later, sooner)]
        if not found:
            return [np.empty(0, int)] * n
        q, rows, d = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = d <= worst[q] * (1 + _SLACK) + _SLACK
        q, rows = q[keep], rows[keep]
        order = np.argsort(q, kind="stable")
        return np.split(rows[order], np.searchsorted(q[order], np.arange(1, n)))

    def _distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        p = self.p[rows]
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T, 0))


def lift(points: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)
    return np.hstack([points, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]])


def inner(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sums of products from the first component to the last, in double precision."""
    out = np.zeros(len(points))
    for i in range(len(q)):
        out += q[i] * points[:, i]
    return out


def _pack(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, dim, ids binary, vectors binary): the vectors of each group (and dimension) in one row."""

    def run(key, table):
        ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype("<i8")
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        return pa.table({group: [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    return rows.groupBy(group, "dim").applyInArrow(run, f"{group} long, dim int, ids binary, vectors binary")


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id long, rank int, id_col long, score double): each query's k nearest rows of the index, but rows with its own id."""
    kind = "<f4" if "float" in index.schema[vector_col].dataType.simpleString() else "<f8"
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    index, queries = take(index), take(queries)
    shards = max(1, -(-index.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    # rows of one id may be many: other bits decide too
    deal = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("long")
    packed = _pack(index.withColumn("shard", deal(shards)), "shard", kind)
    asked = _pack(queries.withColumn("block", deal(blocks)), "block", kind).withColumnRenamed("ids", "q_ids").withColumnRenamed("vectors", "q_vectors")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("slice", F.floor(F.col("block") / SLICE)).withColumn("shard", upto(shards))
    packed = packed.withColumn("slice", upto(-(-blocks // SLICE)))
    meet = packed.join(asked, ["shard", "slice", "dim"]).select("shard", "dim", "ids", "vectors", "q_ids", "q_vectors", "slice").sortWithinPartitions("shard", "slice", "dim")

    def run(batches):
        held, tree, points, ids = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                s, dim, raw_ids, raw, q_ids, q_raw = (batch.column(c)[i].as_py() for c in range(6))  # rows come by shard
                if held != (s, dim):
                    ids, points = np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw, kind).reshape(-1, dim).astype(float)
                    held, tree = (s, dim), Tree(lift(points))
                q_ids, q = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_raw, kind).reshape(-1, dim).astype(float)
                hits = tree.search(np.hstack([q, np.zeros((len(q), 1))]), k, factor, ids, q_ids)
                out = []
                for j, rows in enumerate(hits):
                    score = inner(q[j], points[rows])
                    order = np.lexsort((ids[rows], -score))[:k]
                    out.append((np.full(len(order), q_ids[j]), np.full(len(order), j, np.int32), ids[rows][order], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "nth", "id", "score"])

    found = meet.mapInArrow(run, "query_id long, nth int, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
