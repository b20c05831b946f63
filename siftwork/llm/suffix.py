"""Suffix-array dedup: repeated byte strings of SPAN bytes by merging Burrows-Wheeler transforms of shards.

A byte goes if a SPAN-byte string covers it that also starts earlier: in a document with a smaller id, or earlier in the same one.

The suffixes of all texts are dealt out so that equal strings meet. Of the ANCHOR-byte strings inside a SPAN-byte window, the one
with the smallest hash (the leftmost of several) is its anchor: equal windows have equal anchors at equal places. Windows that follow
one another and have one anchor form a run, and runs are dealt into buckets by their anchors.

1. Texts are packed. Each group of packs, those of one task, asks for its anchors, by 32 bits of their hashes in each bucket, how often
   they occur in all texts. Anchors that occur once have no repeated windows; a collision only lets a run through that the
   next step tells apart.
2. The runs with repeated anchors go to their buckets. Equal runs are one string with its earliest place. Runs of an anchor that
   HOT of them or more have are parted by the anchor's place in the window, WIDE places at a time, and dealt by all the bytes that such windows
   share, so that no bucket holds all texts around one passage.
3. A bucket's strings are dealt into shards. Each shard is sorted by suffix and gives its transform: before each suffix, the STEP
   symbols in front of it. An anchor is one symbol of the alphabet, so a window has SPAN - ANCHOR + 1 symbols. The transforms
   are merged by iterative interleave refinement (after Holt and McMillan 2014): the interleave vector that is right for
   prefixes of d symbols, placed by counting the symbols in front, is right for d + STEP. Common prefixes of neighbours in the merged order
   give the repeated intervals. Suffixes are not sorted again across shards.
4. Of each repeat all but the earliest place is marked; packs gather their marks and cut the texts.

Equal anchors are equal 64-bit hashes, equal runs equal pairs of such hashes and lengths; the other 35 bytes of a window are compared themselves.
Null texts count as empty. Texts shorter than SPAN lose nothing. Of rows with the same id the one whose text has the smaller
checksum counts as the earlier; rows with a null id come last, in the same order. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, spread
from .shingles import _BYTE, _power, mix

SPAN, ANCHOR, STEP, SHARDS = 100, 65, 4, 4
#: Symbols of a window, a multiple of STEP.
DEPTH = SPAN - ANCHOR + 1
#: Bytes of text in a pack, unless one text alone is longer, and for which there is one bucket.
PACK = BUCKET = 4 << 20
#: Bytes of text for which there is one bucket of questions, least and most, and anchors that are asked for together, about.
ASKED, TOGETHER = (16 << 20, 64 << 20), 1 << 20
#: Runs from which on an anchor is hot, and places of it in a window that then stay together.
HOT, WIDE = 1 << 15, 6
#: Symbols that are merged at a time, unless one anchor's runs are more; anchors, which are symbols above the bytes.
UNIT, ANCHORS = 1 << 20, 60_000
_LAST = (1 << 63) - 1
_POS = np.uint64((1 << 26) - 1)


def packs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pack long, part long, ids binary, sums binary, lens binary, text binary, n_bytes long): many texts in a row, compressed, with their checksums."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row():
            nonlocal ids, texts, size, n
            whole = b"".join(texts)
            raw = (np.array(ids, "<i8"), np.array([zlib.crc32(t) for t in texts], "<u4"), np.array([len(t) for t in texts], "<i8"))
            made = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), pa.array([part], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in raw], pa.array([zstandard.ZstdCompressor(1).compress(whole)], pa.binary()), pa.array([len(whole)], pa.int64())],
                names=["pack", "part", "ids", "sums", "lens", "text", "n_bytes"],
            )
            ids, texts, size, n = [], [], 0, n + 1
            return made

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t or b""
                if ids and size + len(t) > PACK:
                    yield row()
                ids.append(_LAST if i is None else i)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    return rows.mapInArrow(run, "pack long, part long, ids binary, sums binary, lens binary, text binary, n_bytes long")


class Runs:
    """The runs of a pack: windows first..last - 1 with the anchor at `at`, whose hash is `anchor`."""

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        n = len(data) - SPAN + 1
        self.first = self.last = self.at = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.uint64)
        if n < 1:
            return
        up, down = _power(len(data) + 1)
        self.c = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * up[: len(data)], out=self.c[1:])
            self.down = down
            h = mix((self.c[ANCHOR:] - self.c[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
        m = (h & ~_POS) | (np.arange(len(h), dtype=np.uint64) & _POS)
        wide, have = SPAN - ANCHOR + 1, 1
        while have * 2 <= wide:
            m, have = np.minimum(m[:-have], m[have:]), have * 2
        if have < wide:
            m = np.minimum(m[: len(m) - (wide - have)], m[wide - have :])
        ends = np.cumsum(lens)
        valid = np.ones(n, bool)  # windows inside one text
        for e in ends[:-1].tolist():
            valid[max(0, e - SPAN + 1) : e] = False
        edge = np.flatnonzero((m[1:] != m[:-1]) | (valid[1:] != valid[:-1])) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [n]])
        keep = valid[first]
        self.first, self.last = first[keep], last[keep]
        base = self.first
        self.at = base + ((m[base] - (base.astype(np.uint64) & _POS)) & _POS).astype(np.int64)
        self.anchor = h[self.at]

    def content(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from begin to end."""
        with np.errstate(over="ignore"):
            return mix((self.c[end] - self.c[begin]) * self.down[begin])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8), np.frombuffer(row["lens"], "<i8")


def _by(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket and (bucket, from, to) in it."""
    order = np.argsort(bucket, kind="stable")
    s = bucket[order]
    edge = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]) if len(s) else np.zeros(1, int)
    return order, [(int(s[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def questions(packs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, packs, counts, asked, several): 32 bits of the hashes of all anchors of some packs of a task in a bucket, `counts` of them for each
    pack; several holds pairs of an index and a number where a pack has an anchor more than once."""

    def run(batches):
        def asked(part, found):
            names, anchors, times = zip(*found, strict=True)
            of = np.repeat(np.arange(len(names)), [len(x) for x in anchors])
            anchors, times = np.concatenate(anchors), np.concatenate(times)
            order, parts = _by((anchors % np.uint64(buckets)).astype(np.int64))
            low, times, of = (anchors >> np.uint64(32)).astype("<u4")[order], times[order], of[order]
            rows = []
            for b, i, j in parts:
                more = np.flatnonzero(times[i:j] > 1)
                several = np.stack([more, times[i:j][more]], 1).astype("<u4")
                rows.append((b, part, np.array(names, "<i8").tobytes(), np.bincount(of[i:j], minlength=len(names)).astype("<u4").tobytes(), low[i:j].tobytes(), several.tobytes()))
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "part", "packs", "counts", "asked", "several"])

        part, found, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if found and (row["part"] != part or size >= TOGETHER):
                    yield asked(part, found)
                    found, size = [], 0
                data, lens = _open(row)
                anchors, times = np.unique(Runs(data, lens).anchor, return_counts=True)
                part = row["part"]
                if len(anchors):
                    found.append((row["pack"], anchors, times))
                    size += len(anchors)
        if found:
            yield asked(part, found)

    return packs.mapInArrow(run, "bucket long, part long, packs binary, counts binary, asked binary, several binary")


def answers(asked: DataFrame) -> DataFrame:
    """(pack, repeated, hot): for each pack those of its anchors that occur twice or more in all packs, as bucket << 32 | 32 bits of the hash, and those of them that are hot.

    Buckets answer the groups of packs that asked, and each group's answers are then parted by pack: there is no row for each pack and bucket.
    """

    def counted(key, t):
        low, times = [], []
        for x, several in zip(t.column("asked").to_pylist(), t.column("several").to_pylist(), strict=True):
            low.append(np.frombuffer(x, "<u4"))
            n = np.ones(len(low[-1]), np.int64)
            at, more = np.frombuffer(several, "<u4").reshape(-1, 2).T
            n[at] = more
            times.append(n)
        _, number = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(number, weights=np.concatenate(times))[number]
        out, begin = [], 0
        for x, part, packs, counts in zip(low, t.column("part").to_pylist(), t.column("packs").to_pylist(), t.column("counts").to_pylist(), strict=True):
            n = total[begin : begin + len(x)]
            begin += len(x)
            keep = n > 1
            if keep.any():
                of = np.repeat(np.arange(len(counts) // 4), np.frombuffer(counts, "<u4"))[keep]
                out.append((key[0].as_py(), part, packs, np.bincount(of, minlength=len(counts) // 4).astype("<u4").tobytes(), x[keep].tobytes(), np.packbits(n[keep] >= HOT).tobytes()))
        names = ["bucket", "part", "packs", "counts", "repeated", "hot"]
        return pa.table([pa.array([r[k] for r in out], pa.int64() if k < 2 else pa.binary()) for k in range(6)], names=names)

    def parted(key, t):
        by: dict[int, list[np.ndarray]] = {}
        for b, packs, counts, repeated, hot in zip(*(t.column(c).to_pylist() for c in ("bucket", "packs", "counts", "repeated", "hot")), strict=True):
            x = np.frombuffer(repeated, "<u4").astype(np.uint64) | np.uint64(b << 32)
            flags = np.unpackbits(np.frombuffer(hot, np.uint8), count=len(x)).astype(bool)
            ends = np.cumsum(np.frombuffer(counts, "<u4"))
            for p, i, j in zip(np.frombuffer(packs, "<i8").tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if i < j:
                    by.setdefault(p, []).append((x[i:j], x[i:j][flags[i:j]]))
        whole = [(p, *[np.sort(np.concatenate(y)).astype("<u8").tobytes() for y in zip(*found, strict=True)]) for p, found in by.items()]
        return pa.table([pa.array([r[k] for r in whole], pa.binary() if k else pa.int64()) for k in range(3)], names=["pack", "repeated", "hot"])

    found = asked.groupBy("bucket").applyInArrow(counted, "bucket long, part long, packs binary, counts binary, repeated binary, hot binary")
    return found.groupBy("part").applyInArrow(parted, "pack long, repeated binary, hot binary")


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted known?"""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _ranges(first: np.ndarray, last: np.ndarray) -> bytes:
    """Pairs of byte places that the windows first..last - 1 cover."""
    return np.stack([first, last + SPAN - 1], 1).astype("<i4").tobytes()


def strings(packs: DataFrame, answered: DataFrame, buckets: int, asked: int) -> DataFrame:
    """(bucket, pack, what): with a bucket, the pack's distinct runs with repeated anchors; with a negative one, places that repeat inside the pack."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, lens = _open(row)
                ids, sums = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sums"], "<u4")
                r = Runs(data, lens)
                mine = (r.anchor >> np.uint64(32)) | (r.anchor % np.uint64(asked)) << np.uint64(32)
                use = _among(mine, np.frombuffer(row["repeated"], "<u8"))
                hot = use & _among(mine, np.frombuffer(row["hot"], "<u8"))
                first, last, at, anchor = (x[use & ~hot] for x in (r.first, r.last, r.at, r.anchor))
                bucket = (anchor % np.uint64(buckets)).astype(np.int64)
                if hot.any():
                    # windows with the anchor at low, low + 1 ... low + WIDE - 1 share the bytes from low in front of it on
                    low = np.tile(np.arange(0, SPAN - ANCHOR + 1, WIDE), int(hot.sum()))
                    f, e, t, k = (np.repeat(x[hot], (SPAN - ANCHOR) // WIDE + 1) for x in (r.first, r.last, r.at, r.anchor))
                    f, e = np.maximum(f, t - low - WIDE + 1), np.minimum(e, t - low + 1)
                    some = f < e
                    f, e, t, k, low = f[some], e[some], t[some], k[some], low[some]
                    share = mix(r.content(t - low, t - low + SPAN - WIDE + 1) + low.astype(np.uint64))
                    first, last, at, anchor = (np.concatenate(x) for x in ((first, f), (last, e), (at, t), (anchor, k)))
                    bucket = np.concatenate([bucket, (share % np.uint64(buckets)).astype(np.int64)])
                if not len(first):
                    continue
                # of texts that begin at one place all but the last are empty
                doc = np.searchsorted(np.cumsum(lens) - lens, first, side="right") - 1
                size, same, ident, check = last - first, r.content(first, last + SPAN - 1), ids[doc], sums[doc]
                order = np.lexsort((first, check, ident, size, same, anchor))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (same, anchor, size, at - first)], 0)
                again = order[~new]
                rows = [(-1 - row["pack"] % buckets, _ranges(first[again], last[again]))] if len(again) else []
                u = order[new]
                by, parts = _by(bucket[u])
                u = u[by]
                left, right = at[u] - first[u], last[u] + SPAN - 1 - at[u] - ANCHOR
                for b, i, j in parts:
                    w, v = slice(i, j), u[i:j]
                    size = left[w] + right[w]
                    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    flanks = data[np.repeat(first[v], size) + k + np.where(k >= np.repeat(left[w], size), ANCHOR, 0)]
                    head = np.array([j - i], "<i8").tobytes()
                    body = b"".join(x.astype(t).tobytes() for x, t in ((anchor[v], "<u8"), (same[v], "<u8"), (ident[v], "<i8"), (check[v], "<u4"), (first[v], "<i4"), (left[w], "u1"), (right[w], "u1")))
                    rows.append((b, zstandard.ZstdCompressor(1).compress(head + body + flanks.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([row["pack"]] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["bucket", "pack", "what"])

    return packs.join(answered, "pack").select("pack", "ids", "sums", "lens", "text", "repeated", "hot").mapInArrow(run, "bucket long, pack long, what binary")


def grams(t: np.ndarray) -> np.ndarray:
    """At each place of a cyclic text of 16-bit symbols, the number of the STEP symbols that begin there, in lexical order."""
    x = np.zeros(len(t), np.uint64)
    for i in range(STEP):
        x = x << np.uint64(16) | np.roll(t, -i).astype(np.uint64)
    return x


def suffixes(rank: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text in the order of their first `depth` symbols or more, by doubling; rank orders the first STEP."""
    have, order = STEP, np.argsort(rank, kind="stable")
    while have < depth:
        key = rank.astype(np.uint64) << np.uint64(32) | np.roll(rank, -have).astype(np.uint64)
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(len(k), np.uint32)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        have *= 2
    return order


def placed(symbols: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit symbols, by counting: numpy counts where numbers have 16 bits."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = (symbols >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): the places of all texts, one text after another, in merged order, and how many symbols, by steps of STEP up to
    depth (a multiple of it), each has in common with the one before.

    The interleave vector z starts as the order of no symbols: text after text.
    """
    sizes = [len(t) for t in texts]
    _, number = np.unique(np.concatenate([grams(t) for t in texts]), return_inverse=True)
    number = number.astype(np.uint32)
    ranks = np.split(number, np.cumsum(sizes)[:-1])
    orders = [suffixes(rank, depth) for rank in ranks]
    front = [rank[o - STEP] for rank, o in zip(ranks, orders, strict=True)]  # the transform: the STEP symbols before each suffix, cyclically
    z = np.repeat(np.arange(len(texts), dtype=np.uint8), sizes)
    symbols = np.empty(len(z), np.uint32)
    for _ in range(0, depth, STEP):
        for s, f in enumerate(front):
            symbols[z == s] = f
        z = z[placed(symbols)]
    places, begin = np.empty(len(z), np.int64), 0
    for s, o in enumerate(orders):
        places[z == s] = o + begin
        begin += sizes[s]
    # (behind the end of a text stands the next one: no window reaches there)
    common, equal = np.zeros(len(z), np.uint8), np.arange(1, len(z))
    for k in range(0, depth, STEP):
        equal = equal[number.take(places[equal] + k, mode="wrap") == number.take(places[equal - 1] + k, mode="wrap")]
        common[equal] += STEP
    return places, common


def repeats(groups: np.ndarray, left: np.ndarray, right: np.ndarray, flanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, interval) of all windows of the runs that equal another window; groups number the anchors."""
    size = left + right
    long = size + 2
    at = np.cumsum(long) - long
    t = np.zeros(long.sum(), np.uint16)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    t[np.repeat(at, size) + k + (k >= np.repeat(left, size))] = flanks.astype(np.uint16) + 1
    t[at + left] = groups + 257
    # a window never reaches the mark behind its run, so what texts are cut where doesn't matter
    edges = sorted({int(at[len(at) * s // SHARDS]) for s in range(SHARDS)} | {len(t)})
    places, common = merge([t[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], DEPTH)
    interval = np.cumsum(common < DEPTH)
    run = np.searchsorted(at, places, side="right") - 1
    offset = places - at[run]
    window = offset < size[run] + 2 - DEPTH
    run, offset, interval = run[window], offset[window], interval[window]
    often = np.bincount(interval, minlength=1)[interval] > 1
    return run[often], offset[often], interval[often]


def _later(groups, left, right, flanks, ident, check, pack, place) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows that equal an earlier one, by run and offset."""
    run, offset, interval = repeats(groups, left, right, flanks)
    order = np.lexsort((place[run] + offset, pack[run], check[run], ident[run], interval))
    i = interval[order]
    late = order[1:][i[1:] == i[:-1]]
    run, offset = run[late], offset[late]
    order = np.lexsort((offset, run))
    return run[order], offset[order]


def marks(dealt: DataFrame) -> DataFrame:
    """(pack, what): the places in packs of runs and windows that repeat earlier ones, and those known already."""

    def run(key, t):
        if key[0].as_py() < 0:
            return t.select(["pack", "what"])
        parts: list[list[np.ndarray]] = [[] for _ in range(9)]
        for p, raw in zip(t.column("pack").to_pylist(), t.column("what").to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(raw)
            n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
            for k, kind in enumerate(("<u8", "<u8", "<i8", "<u4", "<i4", "u1", "u1")):
                x = np.frombuffer(raw, kind, n, at)
                at += x.nbytes
                parts[k].append(x)
            parts[7].append(np.frombuffer(raw, np.uint8, -1, at))
            parts[8].append(np.full(n, p))
        anchor, same, ident, check, place, left, right, flanks, pack = (np.concatenate(x) for x in parts)
        place, left, right = place.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
        size = left + right
        flank_at = np.cumsum(size) - size
        order = np.lexsort((place, pack, check, ident, left, size, same, anchor))
        differ = np.zeros(len(order), bool)
        differ[0] = True
        for x in (anchor, same, size, left):
            y = x[order]
            differ[1:] |= y[1:] != y[:-1]
        again, order = order[~differ], order[differ]
        windows = size + 2 - DEPTH
        out_pack, out_first, out_last = [pack[again]], [place[again]], [(place + windows)[again]]
        a = anchor[order]
        group = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])])
        begin = 0
        weight = np.cumsum(size[order] + 2)
        while begin < len(order):
            base = weight[begin - 1] if begin else 0
            end = max(begin + 1, min(int(np.searchsorted(weight, base + UNIT)), int(np.searchsorted(group, group[begin] + ANCHORS))))
            # whole anchors only
            end = int(np.searchsorted(group, group[end - 1], side="left" if group[end - 1] > group[begin] and end < len(order) and group[end] == group[end - 1] else "right"))
            u = order[begin:end]
            k = np.arange(size[u].sum()) - np.repeat(np.cumsum(size[u]) - size[u], size[u])
            r, o = _later(group[begin:end] - group[begin], left[u], right[u], flanks[np.repeat(flank_at[u], size[u]) + k], ident[u], check[u], pack[u], place[u])
            if len(r):
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(r)) - 1
                out_pack.append(pack[u[r[first]]])
                out_first.append(place[u[r[first]]] + o[first])
                out_last.append(place[u[r[last]]] + o[last] + 1)
            begin = end
        p, first, last = (np.concatenate(x) for x in (out_pack, out_first, out_last))
        by, found = _by(p)
        return pa.table({"pack": pa.array([b for b, _, _ in found], pa.int64()), "what": pa.array([_ranges(first[by[i:j]], last[by[i:j]]) for _, i, j in found], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "pack long, what binary")


def removed_from(packs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): the texts of packs without the bytes at the places(pack, what)."""
    per = places.groupBy("pack").agg(F.collect_list("what").alias("places"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, lens = _open(row)
                ids = np.frombuffer(row["ids"], "<i8")
                gone = np.zeros(len(data) + 1, np.int32)
                for x in row["places"] or []:
                    x = np.frombuffer(x, "<i4").reshape(-1, 2)
                    np.add.at(gone, x[:, 0], 1)
                    np.add.at(gone, x[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                out, at = [], 0
                for i, n in zip(ids.tolist(), lens.tolist(), strict=True):
                    g = gone[at : at + n]
                    spans = int(n > 0 and g[0]) + int((g[1:] & ~g[:-1]).sum())
                    out.append((None if i == _LAST else i, n, int(g.sum()), spans, data[at : at + n][~g].tobytes()))
                    at += n
                for k in range(0, len(out), 500):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 500], strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return packs.join(per, "pack", "left").select("pack", "ids", "lens", "text", "places").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for every row: its text without repeated bytes."""
    packs = cut(packs_of(docs, id_col, text_col), "suffix-packs")
    n = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, asked = max(8, n // BUCKET), max(8, n // min(ASKED[1], max(ASKED[0], n >> 11)))
    answered = cut(answers(questions(packs.select("pack", "part", "lens", "text"), asked)), "suffix-answers")
    found = cut(marks(strings(packs, answered, buckets, asked)), "suffix-marks")
    drop(answered)
    return removed_from(packs, found).withColumnRenamed("id", id_col)
