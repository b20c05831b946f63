"""Near-duplicates by HyperMinHash: registers of leading zeros and mantissa bits, banding, corrected estimates, exact check.

Every set of shingles gets REGISTERS registers. A shingle's hash falls into one bucket; the bucket's smallest hash is stored as
its count of leading zeros and its next MANTISSA bits. Buckets that no shingle hits are filled by further rounds of hashing
(the number of the round is part of the register), so small sets have full sketches too and a register is equal in two sketches
with the probability of their Jaccard similarity, but for collisions of the compressed values, which the estimate takes out.

1. Documents with equal sets are one class, kept by its smallest id; only classes go on.
2. Bands of a few registers (see rows_for) give each class as many keys as there are bands. In each bucket of a key all others are paired with a leader; there are
   few leaders for a group however many buckets it fills, and the pairs are as many as the members.
3. Pairs whose corrected estimate is near the threshold or above are verified on full sets; links are closed to components.
4. Buckets whose other members still lie in several components are gone through for the remaining pairs. Pairs inside one
   component need no check, they cannot change the result: those outside a bucket's largest component meet all its members, in
   blocks, so that what is moved grows with the members where outsiders are few. A pair is compared in the first band it shares.

A key or a leader may have any share of all rows: joins deal such a key into parts (see spread_join).

A pair at the threshold shares no band with a probability of 4e-7 at 0.85 and 5e-8 at 0.8; the filter in front of the verification is six
standard deviations below the threshold. A null or blank text has an empty set, which is linked with nothing. Rows with the same
id are one document; rows with a null id are never linked. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, cut, drop, spread, spread_join

REGISTERS, MANTISSA = 128, 8
ROUNDS = 6
LEADERS = 3
#: Rows of a bucket that are compared together, about: BLOCK, or one in SHARE of larger buckets up to MOST, and bytes of their sets.
BLOCK, SHARE, MOST, BLOCK_BYTES = 128, 32, 1024, 32 << 20
#: Ids (of eight bytes) that are broadcast at most.
SENT = 2_000_000
_LOW = np.uint64((1 << 57) - 1)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
_SEEDS = shingles.mix(np.arange(1, REGISTERS + ROUNDS + 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def minima(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set of 64-bit hashes: each bucket's smallest value of 57 bits, and the round that filled it."""
    value, of = np.zeros(REGISTERS, np.uint64), np.full(REGISTERS, -1)
    x = u
    for r in range(ROUNDS):
        if r:
            x = np.sort(shingles.mix(u ^ _SEEDS[r]))
        at = np.searchsorted(x, _BOUNDS)
        got = x[np.minimum(at, len(x) - 1)]
        new = (at < len(x)) & ((got >> np.uint64(57)) == np.arange(REGISTERS, dtype=np.uint64)) & (of < 0)
        value[new], of[new] = got[new] & _LOW, r
        if (of >= 0).all():
            return value, of
    for b in np.flatnonzero(of < 0):
        value[b], of[b] = (shingles.mix(u ^ _SEEDS[ROUNDS + b]) >> np.uint64(7)).min(), ROUNDS
    return value, of


def compress(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """16-bit registers: 3 bits of the round, 5 of the leading zeros (31 at most), MANTISSA bits behind the leading one."""
    _, length = np.frexp(value.astype(np.float64))  # exact up to rounding of the longest values
    length = np.maximum(length, 1)
    length -= (value >> (length - 1).astype(np.uint64)) == 0
    zeros = np.minimum(57 - length, 31)
    shift = length - 1 - MANTISSA
    bits = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return (of << 13 | zeros << 8 | bits.astype(np.int64)).astype("<u2")


def sketch(sets: list[np.ndarray]) -> list[bytes | None]:
    full = [i for i, u in enumerate(sets) if len(u)]
    out: list[bytes | None] = [None] * len(sets)
    if full:
        both = [minima(sets[i]) for i in full]
        registers = compress(np.array([v for v, _ in both]), np.array([o for _, o in both]))
        for i, r in zip(full, registers, strict=True):
            out[i] = r.tobytes()
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that are equal by compression alone in sketches of disjoint sets of n and m members."""
    a, b = np.maximum(n / REGISTERS, 1.0), np.maximum(m / REGISTERS, 1.0)
    out = np.zeros(len(a))
    for z in range(40):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1)
        out += lo * 2.0**-MANTISSA * a * b / (a + b) * (np.exp(-(a + b) * lo) - np.exp(-(a + b) * hi))
    return out


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from the number of equal registers."""
    by_chance = collisions(n, m)
    return (equal / REGISTERS - by_chance) / (1 - by_chance)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - 6 * (j * (1 - j) / REGISTERS) ** 0.5


def rows_for(percent: int) -> int:
    """Registers in a band."""
    return 5 if percent >= 85 else 4 if percent >= 75 else 3


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_digest, registers): the last two null for empty sets."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = shingles.sets(part.column(1).to_pylist())
                digest = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(u) for u in found], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch(found), pa.binary())], names=["id", "n_shingles", "set_digest", "registers"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    return rows.mapInArrow(run, "id long, n_shingles long, set_digest binary, registers binary")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs(node, leader), a table, whose corrected estimate isn't too low."""
    least = least_estimate(percent)
    side = lambda k: classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    mine = pairs.join(side("node"), "node")
    both = spread_join(mine, side("leader"), "leader", pairs.count(), pairs.groupBy("leader").agg(F.count("*").alias("n"))).select("node", "leader", "n_node", "n_leader", "r_node", "r_leader")

    def run(batches):
        for t in batches:
            if t.num_rows:
                r = [np.frombuffer(b"".join(t.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5)]
                n = [t.column(k).to_numpy().astype(float) for k in (2, 3)]
                keep = estimate((r[0] == r[1]).sum(1), *n) >= least
                yield t.select(["node", "leader"]).filter(pa.array(keep))

    return both.mapInArrow(run, "node long, leader long")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes binary): the sets of the nodes' texts, six bytes for each shingle, as a table. Up to SENT ids of nodes are broadcast; beyond that the texts are shuffled, this once."""
    nodes = cut(nodes.select("node").distinct(), "minhash-nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= SENT else nodes
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").cast("binary").alias("text")).join(nodes, "node", "left_semi")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [np.unique(u >> np.uint64(16)) for u in shingles.sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for u in found], pa.binary())], names=["node", "hashes"])

    return cut(rows.mapInArrow(run, "node long, hashes binary"), "minhash-sets")


def unpack(hashes: bytes) -> np.ndarray:
    out = np.zeros((len(hashes) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(hashes, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def similar(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs(node, leader), a table, whose full sets of shingles are similar enough."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h_{k}"))
    mine = pairs.join(side("node"), "node")
    both = spread_join(mine, side("leader"), "leader", pairs.count(), pairs.groupBy("leader").agg(F.count("*").alias("n"))).select("node", "leader", "h_node", "h_leader")

    def run(batches):
        known, its = None, np.empty(0, np.uint64)
        for t in batches:
            keep = []
            for i in range(t.num_rows):
                h = t.column(3)[i].as_py()
                if h != known:  # pairs of one leader mostly follow one another
                    known, its = h, unpack(h)
                mine = unpack(t.column(2)[i].as_py())
                keep.append(similar(shingles.shared(mine, its), len(mine), len(its), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in t.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right, both of bounded number, by products of slices of the membership matrices."""
    sets, m = [*left, *right], len(left)
    owner = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    often = times[number] > 1  # what one member alone has is in no intersection
    owner, number = owner[often], number[often]
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    out = np.zeros((m, len(right)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], number[a:b] - lo] = 1
        out += part[:m] @ part[m:].T
    return out


def links_across(band: int, rows: int, out: list[tuple], every: list[tuple], percent: int, least: float) -> tuple[list[int], list[int]]:
    """Links between outsiders and members of a bucket's block that suffice to connect what their links connect. Both sides are
    lists of (node, outside, comp, n, registers, hashes), the outsiders' own rows being among the members of some block."""

    def columns(side):
        node, outside, comp, n, registers, hashes = zip(*side, strict=True)
        return np.array(node), np.array(outside), np.array(comp), np.array(n, float), np.frombuffer(b"".join(registers), "<u2").reshape(-1, REGISTERS), hashes

    node, _, comp, n, r, hashes = columns(out)
    nodes, outside, comps, ns, rs, its = columns(every)
    maybe = []
    for x in range(len(node)):
        y = np.flatnonzero((comps != comp[x]) & ~(outside & (nodes < node[x])))  # two outsiders meet both ways
        if len(y):
            equal = rs[y] == r[x]
            first = equal[:, : band * rows].reshape(len(y), band, rows).all(2).any(1) if band else np.zeros(len(y), bool)
            y = y[~first & (estimate(equal.sum(1), ns[y], np.full(len(y), n[x])) >= least)]
            if len(y):
                maybe.append((x, y))
    if not maybe:
        return [], []
    sets, others = [unpack(h) for h in hashes], [unpack(h) for h in its]
    size, sizes = np.array([len(u) for u in sets]), np.array([len(u) for u in others])
    dense = intersections(sets, others) if sum(len(y) for _, y in maybe) > 2 * (len(out) + len(every)) else None
    a, b = [], []
    for x, ys in maybe:
        for y in ys.tolist() if dense is None else ys[similar(dense[x, ys], size[x], sizes[ys], percent)].tolist():
            if comp[x] != comps[y] and (dense is not None or similar(shingles.shared(sets[x], others[y]), size[x], sizes[y], percent)):
                was, now = comps[y], comp[x]
                comp[comp == was], comps[comps == was] = now, now
                a.append(int(node[x]))
                b.append(int(nodes[y]))
    return a, b


def meetings(members: DataFrame) -> DataFrame:
    """(key, band, i, j, side, outside, node, comp) from members(key, band, node, comp, n), a table: who meets whom. In each bucket of
    several components, those outside its largest one (side 0, block i) meet all (side 1, block j; side 2 where
    one row is both). Block sizes are bounded in rows and in bytes of sets; a bucket has n_all * blocks_out + n_out * blocks_all rows at most."""
    per = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    most = F.max(F.struct("c", "w", "comp"))
    open_ = per.groupBy("key").agg(most.alias("most"), F.sum("c").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    size = F.least(F.greatest(F.lit(BLOCK), F.floor(F.col("n") / SHARE)), F.lit(max(BLOCK, MOST)))
    blocks = lambda c, w: F.greatest(F.ceil(c / size), F.ceil(w * 6 / BLOCK_BYTES)).cast("long")
    open_ = cut(open_.select("key", "n", F.col("most.comp").alias("largest"), blocks(F.col("n"), F.col("w")).alias("n_j"), blocks(F.col("n") - F.col("most.c"), F.col("w") - F.col("most.w")).alias("n_i")), "minhash-open")
    both = spread_join(members.select("key", "band", "node", "comp"), open_.drop("n"), "key", members.count(), open_.select("key", "n"))
    outside = F.col("comp") != F.col("largest")
    mine = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(f"n_{k}"))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(f"n_{k}") - 1)
    as_member = F.transform(F.filter(upto("i"), lambda i: ~outside | (i != mine("i"))), lambda i: F.struct(i.alias("i"), mine("j").alias("j"), F.lit(1).alias("side")))
    as_outsider = F.transform(upto("j"), lambda j: F.struct(mine("i").alias("i"), j.alias("j"), F.when(j == mine("j"), 2).otherwise(0).alias("side")))
    rows = both.select("key", "band", outside.alias("outside"), "node", "comp", F.explode(F.when(outside, F.concat(as_outsider, as_member)).otherwise(as_member)).alias("to"))
    return rows.select("key", "band", "to.i", "to.j", "to.side", "outside", "node", "comp")


def remaining(met: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links between those who meet in meetings(), a table. Each pair of blocks is one small group: what comes out are links, never more than members."""
    least, width = least_estimate(percent), rows_for(percent)
    whole = classes.select("node", "n", "registers").join(sets, "node")
    rows = spread_join(met, whole, "node", met.count(), met.groupBy("node").agg(F.count("*").alias("n")))
    rows = rows.select("key", "i", "j", "band", "side", "node", "outside", "comp", "n", "registers", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        def found(group: list[tuple]):
            sides = [[row[5:] for row in group if row[4] in side] for side in ((0, 2), (1, 2))]
            a, b = links_across(group[0][3], width, *sides, percent, least) if all(sides) else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if group and group[0][:3] != row[:3]:
                        yield found(group)
                        group = []
                    group.append(row)
        if group:
            yield found(group)

    return rows.mapInArrow(run, "a long, b long")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id_col, n_shingles long, component_id long, kept boolean) for every row: components of documents with a Jaccard similarity of percent / 100 or more."""
    sketched = cut(sketches(docs, id_col, text_col), "minhash-sketches")
    linkable = sketched.where("set_digest IS NOT NULL AND id IS NOT NULL")
    classes = cut(linkable.groupBy("set_digest").agg(F.min("id").alias("node"), F.max("n_shingles").alias("n"), F.min("registers").alias("registers"), F.count("*").alias("copies")), "minhash-classes")

    rows = rows_for(percent)
    bands = REGISTERS // rows
    key = lambda b: F.struct(F.xxhash64(b, F.col("registers").substr((b * 2 * rows + 1).cast("int"), F.lit(2 * rows))).alias("key"), b.alias("band"))
    banded = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("k")).select("node", "k.*")
    which = F.pmod("band", F.lit(LEADERS))
    by = F.when(which == 0, F.col("node")).otherwise(F.xxhash64("node", which))
    crowd = cut(banded.groupBy("key").agg(F.min_by("node", by).alias("leader"), F.count("*").alias("n")).where("n > 1"), "minhash-crowd")
    buckets = cut(spread_join(banded, crowd.withColumnRenamed("n", "size"), "key", bands * classes.count(), crowd), "minhash-buckets")

    sets = full_sets(docs, buckets, id_col, text_col)

    star = cut(buckets.where("node <> leader").select("node", "leader").distinct(), "minhash-star")
    pairs = cut(likely(star, classes, percent), "minhash-pairs")
    found = cut(verified(pairs, sets, percent), "minhash-links")
    comp = cut(components(found, "minhash-edges"), "minhash-roots")

    # what a leader is linked with is known
    members = buckets.where("size > 2 AND node <> leader").select("key", "band", "node").join(classes.select("node", "n"), "node").join(comp, "node", "left")
    members = cut(members.select("key", "band", "node", "n", F.coalesce("root", "node").alias("comp")), "minhash-members")
    met = cut(meetings(members), "minhash-meetings")
    late = cut(remaining(met, classes, sets, percent), "minhash-links")
    roots = cut(components(found.unionByName(late), "minhash-edges"), "minhash-roots")
    drop(crowd, buckets, star, pairs, comp, members, met, found, late, sets)

    of_class = classes.select("set_digest", "node").join(roots, "node", "left").select("set_digest", F.coalesce("root", "node").alias("root"))
    out = spread_join(sketched.select("id", "n_shingles", "set_digest"), of_class, "set_digest", sketched.count(), classes.select("set_digest", F.col("copies").alias("n")), "left")
    # rows with one id are one document: they share what any of them reaches
    component = F.when(F.col("id").isNotNull(), F.least(F.coalesce("root", "id"), "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id, once. Rows with a null id all stay."""
    kept = cluster(docs, id_col, text_col, percent).where("kept").select(F.col(id_col).alias("__kept")).where("__kept IS NOT NULL").distinct()
    rows = docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


#: DuckDB SQL for cluster() over documents at 85 %: all pairs that share a shingle, and their closure.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN s m ON m.doc_id = p.a JOIN s n ON n.doc_id = p.b WHERE 100 * c >= 85 * (len(m.s) + len(n.s) - c)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.node = u.a
), k AS (
  SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN k ON k.doc_id = s.doc_id
"""
