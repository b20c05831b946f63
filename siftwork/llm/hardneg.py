"""Hard negatives by bit-sliced integer products.

Vectors are scaled and floored to integers; a row's score is its inner product with the anchor. A shard keeps its components as
bit-planes in two's complement, a bit for each row and component. A search adds plane after plane, the most significant first: after
each of them what the rest can still add is known from the anchor alone, so every score lies in an interval, which halves with each
plane. A candidate is dropped once its interval can't qualify any more, and once few are left their products go on pair by pair. After the last plane
the intervals are the scores.

* positives  the first rows of the anchor's label: what lies wholly below the k-th largest lower end is dropped
* negatives  for each positive the first rows of other labels with low * positive <= 100 * score <= high * positive: what lies wholly outside of
             all these windows is dropped, and in a window what lies wholly below the k-th largest lower end of those wholly inside

Each block of anchors meets each shard once in either search, in a join by shard and slice of SLICE blocks, and only the best of every meeting are
shuffled. Labels don't decide where rows go, so one of any share of all rows is nothing special.

Rows with a null id, a null label, a null or empty vector, a null or non-finite component, or components so large that a product might not
fit 64 bits take no part. Rows of another dimension than the anchor's aren't compared with it. Higher scores come first, ties by the smaller id. Rows that share an id are
candidates of their own, but not of an anchor of that id; of anchors that share an id the one of the smallest label and vector counts. Ids and labels are
integers. Very long texts don't occur; long vectors make shards of more bytes. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in a shard, anchors in a block, and blocks that share one task's shard.
SHARD, BLOCK, SLICE = 8192, 128, 4
#: Of the pairs of a block and a shard, the share below which they are handled pair by pair.
SPARSE = 1 / 16
_LEAST = np.iinfo(np.int64).min


def integers(vector: Column, scale: int) -> Column:
    """Components scaled and floored, null where the vector takes no part."""
    whole = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * F.abs(x) * F.size(vector) >= float(1 << 60)))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(whole, lambda x: F.floor(x).cast("long")))


def planes_of(values: np.ndarray) -> np.ndarray:
    """(planes, rows, bytes): the bits of each component in two's complement, the sign's plane first."""
    top = max((int(x).bit_length() for x in (values.max(initial=0), ~values.min(initial=0))), default=0)
    return np.packbits(np.stack([values >> t & 1 for t in range(top, -1, -1)]).astype(np.uint8), axis=2)


class Products:
    """Scores of the rows with the anchors as intervals, plane by plane: low and high, of all pairs or, once thinned, of the pairs (anchor, row)."""

    def __init__(self, planes: np.ndarray, dim: int, anchors: np.ndarray):
        self.planes, self.dim, self.left = planes, dim, len(planes)
        most = int(np.abs(anchors).sum(1).max(initial=0)) << len(planes)
        self.anchors = anchors.astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)
        self.above, self.below = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
        self.known = np.zeros((len(anchors), planes.shape[1]), self.anchors.dtype)
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def step(self) -> None:
        """Add the next plane."""
        plane = self.planes[len(self.planes) - self.left]
        self.left -= 1
        weight = (1 << self.left) * (-1 if self.left == len(self.planes) - 1 else 1)
        bits = lambda rows: np.unpackbits(rows, axis=1, count=self.dim).astype(self.anchors.dtype)
        if self.pairs is None:
            self.known += weight * (self.anchors @ bits(plane).T)
        else:
            i, j = self.pairs
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                self.known[part] += weight * (self.anchors[i[part]] * bits(plane[j[part]])).sum(1)

    def interval(self) -> tuple[np.ndarray, np.ndarray]:
        rest = (1 << self.left) - 1
        of = (lambda x: x[:, None]) if self.pairs is None else (lambda x: x[self.pairs[0]])
        known = self.known.astype(np.int64)
        return known + of(self.below) * rest, known + of(self.above) * rest

    def can_part(self) -> bool:
        """May any interval lie wholly beside another by now? (else there is nothing to drop)"""
        if self.pairs is not None or not self.left:
            return True
        spread = (self.known.max(1, initial=0) - self.known.min(1, initial=0)).astype(np.int64)
        return bool((spread > (self.above - self.below) * ((1 << self.left) - 1)).any())

    def thin(self, alive: np.ndarray) -> None:
        """Keep the pairs alive, given as a matrix or for each pair; go on pair by pair where few are left."""
        if self.pairs is None:
            i, j = np.nonzero(alive)
            self.pairs, self.known = (i, j), self.known[i, j]
        else:
            self.pairs, self.known = (self.pairs[0][alive], self.pairs[1][alive]), self.known[alive]


def kth(group: np.ndarray, low: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n groups the k-th largest value, the least there is where it has fewer."""
    order = np.lexsort((-low, group))
    starts = np.searchsorted(group[order], np.arange(n + 1))
    out = np.full(n, _LEAST)
    enough = np.diff(starts) >= k
    out[enough] = low[order][starts[:-1][enough] + k - 1]
    return out


def positives_in(planes: np.ndarray, dim: int, anchors: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs allowed that may be among an anchor's first k; ties with the k-th are all there."""
    p, alive = Products(planes, dim, anchors), allowed
    while p.left:
        p.step()
        if not p.can_part():
            continue
        low, high = p.interval()
        if p.pairs is None:
            floor = np.full(len(anchors), _LEAST)
            if alive.shape[1] >= k:
                floor = np.maximum(floor, np.partition(np.where(alive, low, _LEAST), alive.shape[1] - k, axis=1)[:, alive.shape[1] - k])
            alive = alive & (high >= floor[:, None])
            if alive.mean() < SPARSE or not p.left:
                p.thin(alive)
        else:
            p.thin(high >= kth(p.pairs[0], low, len(anchors), k)[p.pairs[0]])
    if p.pairs is None:
        p.thin(alive)
    return *p.pairs, p.known.astype(np.int64)


def negatives_in(planes: np.ndarray, dim: int, anchors: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the windows [least[:, w], most[:, w]] (anchor, row, score) of the pairs allowed that may be among an anchor's first k inside it."""
    p, alive, n = Products(planes, dim, anchors), allowed, len(anchors)
    some = least <= most
    alive = alive & some.any(1)[:, None]
    lowest, highest = np.where(some, least, np.iinfo(np.int64).max).min(1), np.where(some, most, _LEAST).max(1)

    def inside(w: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        i = p.pairs[0]
        touches = (high >= least[i, w]) & (low <= most[i, w]) & some[i, w]
        sure = touches & (low >= least[i, w]) & (high <= most[i, w])
        return touches & (high >= kth(i[sure], low[sure], n, k)[i])

    while p.left:
        p.step()
        if not p.can_part():
            continue
        low, high = p.interval()
        if p.pairs is None:
            alive = alive & (high >= lowest[:, None]) & (low <= highest[:, None])
            if alive.mean() < SPARSE or not p.left:
                p.thin(alive)
        else:
            p.thin(np.any([inside(w, low, high) for w in range(least.shape[1])], axis=0))
    if p.pairs is None:
        p.thin(alive)
    low, high = p.interval()
    return [tuple(x[inside(w, low, high)] for x in (*p.pairs, low)) for w in range(least.shape[1])]


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first k, by score from high to low, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < k]


def _packed(rows: DataFrame, group: str, planes: bool, *more: str) -> DataFrame:
    """(group, dim, ids, labels, values, ...): the rows of a group and dimension in one, as bytes; values as bit-planes, or as 64-bit integers."""
    kinds = {"ids": "binary", "labels": "binary", "values": "binary"} | dict.fromkeys(more, "binary")

    def run(key, table):
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8")
        values = flat("values").reshape(-1, key[1].as_py())
        parts = [column("id"), column("label"), planes_of(values) if planes else values, *map(flat, more)]
        return pa.table({group: pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(kinds, parts, strict=True)})

    return rows.groupBy(group, "dim").applyInArrow(run, f"{group} long, dim int, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _meet(shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int, *more: str) -> DataFrame:
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = blocks.select("dim", upto(n_shards).alias("shard"), F.floor(F.col("block") / SLICE).alias("slice"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("values").alias("a_values"), *more)
    found = shards.withColumn("slice", upto(-(-n_blocks // SLICE))).join(asked, ["shard", "slice", "dim"])
    return found.select("shard", "dim", "ids", "labels", "values", "a_ids", "a_labels", "a_values", *more, "slice").sortWithinPartitions("shard", "slice", "dim")


def _read(batches):
    """(ids, labels, planes, dim, anchors' ids, labels, values, the rest) of each meeting; a shard that comes again isn't unpacked again."""
    held, shard = None, None
    ints = lambda x: np.frombuffer(x.as_py(), "<i8")
    for batch in batches:
        for i in range(batch.num_rows):
            s, dim = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if held != (s, dim):
                ids = ints(batch.column(2)[i])
                planes = np.frombuffer(batch.column(4)[i].as_py(), np.uint8).reshape(-1, len(ids), -(-dim // 8))
                held, shard = (s, dim), (ids, ints(batch.column(3)[i]), planes)
            a_ids, a_labels, a_values = (ints(batch.column(c)[i]) for c in (5, 6, 7))
            yield *shard, dim, a_ids, a_labels, a_values.reshape(-1, dim), [ints(batch.column(c)[i]) for c in range(8, batch.num_columns - 1)]


def _find_positives(k: int):
    def run(batches):
        for ids, labels, planes, dim, a_ids, a_labels, values, _ in _read(batches):
            out = []
            for label in np.unique(a_labels):  # a label's anchors meet its rows only
                rows, some = np.nonzero(labels == label)[0], np.nonzero(a_labels == label)[0]
                if len(rows):
                    i, j, score = positives_in(planes[:, rows], dim, values[some], ids[rows][None] != a_ids[some][:, None], k)
                    keep = first(i, score, ids[rows][j], k)
                    out.append((a_ids[some][i[keep]], ids[rows][j[keep]], score[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor_id", "id", "score"])

    return run


def _find_negatives(k: int, low: int, high: int, n: int):
    def run(batches):
        for ids, labels, planes, dim, a_ids, a_labels, values, (scores, counts) in _read(batches):
            scores = scores.reshape(-1, n)
            real = np.arange(n)[None] < counts[:, None]
            # whole-number bounds: ceil(low * p / 100) and floor(high * p / 100), by way of Python's integers where 64 bits are too few
            exact = scores.astype(object) if np.abs(scores).max(initial=0) > 1 << 53 else scores
            least, most = (-(-(exact * low) // 100)).astype(np.int64), ((exact * high) // 100).astype(np.int64)
            least, most = np.where(real, least, 1), np.where(real, most, 0)
            out = []
            for w, (i, j, score) in enumerate(negatives_in(planes, dim, values, (labels[None] != a_labels[:, None]) & (ids[None] != a_ids[:, None]), least, most, k)):
                keep = first(i, score, ids[j], k)
                out.append((a_ids[i[keep]], np.full(len(keep), w, np.int32), ids[j[keep]], score[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor_id", "nth", "id", "score"])

    return run


def mine(rows: DataFrame, anchors: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` rows of the same
    label, the first `negatives` rows of other labels whose score is low to high per cent of the positive's."""
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(F.col(vector_col), scale).alias("values")).dropna().withColumn("dim", F.size("values"))
    index = take(rows)
    asked = take(anchors).groupBy("id").agg(F.min(F.struct("label", "values", "dim")).alias("v")).select("id", "v.*")
    n_shards, n_blocks = max(1, -(-index.count() // shard)), max(1, -(-anchors.count() // block))
    shards = _packed(index.withColumn("shard", F.pmod(F.xxhash64("id", "values"), F.lit(n_shards)).cast("long")), "shard", True)
    dealt = lambda df: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("long"))
    near = _meet(shards, n_shards, _packed(dealt(asked), "block", False), n_blocks).mapInArrow(_find_positives(positives), "anchor_id long, id long, score long")
    ranked = near.withColumn("nth", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")) - 1).where(F.col("nth") < positives)
    # at most `positives` of an anchor
    each = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("p"))
    filled = F.concat(F.transform("p", lambda x: x["score"]), F.array_repeat(F.lit(0).cast("long"), positives - F.size("p")))
    with_scores = asked.join(each, F.col("id") == F.col("anchor_id")).select("id", "label", "values", "dim", filled.alias("scores"), F.array(F.size("p").cast("long")).alias("counts"))
    hard = _meet(shards, n_shards, _packed(dealt(with_scores), "block", False, "scores", "counts"), n_blocks, "scores", "counts").mapInArrow(_find_negatives(negatives, low, high, positives), "anchor_id long, nth int, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "id"))
    best = hard.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    whose = ranked.select("anchor_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(whose, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM r WHERE rank <= 5
"""
