"""Packing: token ids of documents into windows of one size, by multiway differencing (Karmarkar and Karp).

Each task encodes its documents and packs them as they come, so that ids never leave the task: what is held is one group of documents
of GROUP windows and the document at hand. Documents of a window's size and more give full windows first; their rests and all shorter
documents are the group's pieces. One in SHARE of a group's tokens is cut into pieces of SMALL ids, which are what differencing levels
windows with; other pieces stay whole but for the one in which a group ends. Differencing merges partial partitions, the fullest window
of the one with the emptiest of the other, until one is left. A group has SLACK ids less than its windows hold; where a window exceeds the size nevertheless, the
group gets one window more, and is parted anew (few windows are first tried with finer pieces). What is left in a task's last group is parted into as many windows as it fills and into
windows of powers of two, which need no padding.

encode() gives the ids of the whole text: what stands between ASCII white space is encoded by the tokenizer on its own, once for equal
words (no split, normal form or change of case of a tokenizer that drops white space reaches across it), and KEEP words are remembered.

Null texts count as empty; an empty text is its end mark alone. Repeated rows and rows with a null or the same id are documents of
their own. Very long texts are encoded BLOCK by BLOCK; their ids are held whole, four bytes each. Equal sizes come in the order of the
rows, so that a task that runs again on the same rows gives the same windows. Extra columns are ignored; the results have the columns
named here and no others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, spread

SIZE = 4096
#: Windows of a group; one in SHARE of its tokens is cut into SMALL ids; ids for each window that a group leaves free.
#: Where a window of fewer than FEW exceeds the size, one in FINER is cut into SMALL ids first.
GROUP, SHARE, SMALL, SLACK, FEW, FINER = 128, 32, 16, 8, 64, 3
#: Words that are remembered, the longest of them in characters, and the bytes of a text that are parted into words at once.
KEEP, LONGEST, BLOCK = 500_000, 64, 1 << 20
#: What a batch holds at most.
ROWS, BYTES = 2048, 4 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = True):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return found


def blocks(raw: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A long text in blocks that end before white space; a stretch without any stays whole."""
    at = 0
    while len(raw) - at > size and (m := _SPACE.search(raw, at + size)):
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:]


class Words:
    """Ids of words by a tokenizer that sees each word once while it is remembered: the last KEEP words or so, and those among the KEEP before them that came again."""

    def __init__(self, tok, keep: int = KEEP):
        self.tok, self.keep, self.known, self.older = tok, keep, {}, {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit. Different words are looked up once for all texts."""
        parts = [list(blocks(t)) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, part in enumerate(parts):
            for b in part:
                held.append((i, b))
                size += len(b)
                if size >= BYTES:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode(self, held: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        if not held:
            return
        lists = pc.ascii_split_whitespace(pa.array([b for _, b in held], pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = coded.indices.to_numpy()
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        # the places of each word's ids, one word after another
        places = np.repeat((np.cumsum(lengths) - lengths)[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        found = flat[places].tobytes()
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets)] * 4
        for (i, _), a, b in zip(held, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i].append(found[a:b])

    def _ids(self, different: list[str]) -> list[bytes]:
        found = list(map(self.known.get, different))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            w = different[i]
            if (x := self.older.get(w)) is None:
                fresh.append(i)
            else:
                found[i] = self.known[w] = x
        for i, e in zip(fresh, self.tok.encode_batch_fast([different[i] for i in fresh], add_special_tokens=False), strict=True):
            found[i] = array("I", e.ids).tobytes()
            if len(different[i]) <= LONGEST:
                self.known[different[i]] = found[i]
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        return found


@functools.lru_cache(maxsize=2)
def words(path: str, special_as_text: bool = True) -> Words:
    """What this worker remembers for a tokenizer, from one task to the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    return Words(tokenizer(path, special_as_text))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway differencing: the numbers of the pieces in each of k windows, whose sums come out nearly equal.

    A partial partition has k sums, the largest first, less the smallest of them, and the first and last piece of each window's chain. The
    two partitions of the largest differences are merged, the largest sums of one with the smallest of the other.
    """
    if not sizes:
        return [[] for _ in range(k)]
    after = np.full(len(sizes), -1)
    heap = []
    for i, x in enumerate(sizes):
        sums, first = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], first[0] = x, i
        heap.append((-x if k > 1 else 0, i, sums, first, first))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a, a_first, a_last), (_, _, b, b_first, b_last) = heapq.heappop(heap), heapq.heappop(heap)
        sums, b_first, b_last = a + b[::-1], b_first[::-1], b_last[::-1]
        both = (a_first >= 0) & (b_first >= 0)
        after[a_last[both]] = b_first[both]
        first, last = np.where(a_first >= 0, a_first, b_first), np.where(b_first >= 0, b_last, a_last)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n, sums - sums[-1], first[order], last[order]))
        n += 1
    out = []
    for at in heap[0][3].tolist():
        chain = []
        while at >= 0:
            chain.append(at)
            at = int(after[at])
        out.append(chain)
    return out


def finer(pieces: list[tuple[int, int, int]], part: int) -> list[tuple[int, int, int]]:
    """The pieces, the last ones cut into SMALL ids until one in `part` of all ids is in such."""
    out, small, most = list(pieces), sum(p[2] for p in pieces if p[2] <= SMALL), sum(p[2] for p in pieces)
    for i in reversed(range(len(out))):
        if small * part >= most:
            break
        doc, start, n = out[i]
        if n > SMALL:
            out[i : i + 1] = [(doc, start + at, min(SMALL, n - at)) for at in range(0, n, SMALL)]
            small += n
    return out


def windows(pieces: list[tuple[int, int, int]], size: int = SIZE, least: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) in windows of at most `size`: as few as hold them all, or `least`. Whenever a window exceeds the size,
    there is one window more; of few windows, for which one more is much padding, finer pieces are tried first."""
    k = max(-(-sum(p[2] for p in pieces) // size), least or 0)
    while True:
        for some in (pieces, finer(pieces, FINER))[: 1 if k >= FEW else 2]:
            parted = difference([p[2] for p in some], k)
            if all(sum(some[i][2] for i in w) <= size for w in parted):
                return [joined(some[i] for i in w) for w in parted if w]
        k += 1


def joined(pieces: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces in order, those of one document that follow one another made one."""
    out: list[tuple[int, int, int]] = []
    for doc, start, length in sorted(pieces):
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + length)
        else:
            out.append((doc, start, length))
    return out


class Packer:
    """Groups of pieces as documents come; add() and end() yield windows, lists of (document, start, length)."""

    def __init__(self, size: int = SIZE, group: int = GROUP):
        self.size, self.group = size, group
        self.full = group * size - group * SLACK
        self.held: list[tuple[int, int, int]] = []
        self.total = self.small = 0

    def add(self, doc: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        while length - start >= self.size:
            yield [(doc, start, self.size)]
            start += self.size
        while start < length:
            n = min(length - start, self.full - self.total)
            self._hold(doc, start, n)
            start += n
            if self.total == self.full:
                yield from windows(self.held, self.size, self.group)
                self.held, self.total, self.small = [], 0, 0

    def _hold(self, doc: int, start: int, n: int) -> None:
        self.total += n
        while n and self.small * SHARE < self.total:
            m = min(SMALL, n)
            self.held.append((doc, start, m))
            start, n, self.small = start + m, n - m, self.small + m
        if n:
            self.held.append((doc, start, n))

    def end(self) -> Iterator[list[tuple[int, int, int]]]:
        """The last group: what fills no window to SLACK is cut off, the last documents first, in lengths of powers of two."""
        rest = self.total % (self.size - SLACK)
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                window, need = [], 1 << bit
                while need:
                    doc, start, n = self.held.pop()
                    m = min(n, need)
                    window.append((doc, start + n - m, m))
                    if n > m:
                        self.held.append((doc, start, n - m))
                    need -= m
                yield joined(window)
        if self.held:
            yield from windows(self.held, self.size)
        self.held, self.total, self.small = [], 0, 0


def pack(docs: DataFrame, path: str, end: int, size: int = SIZE, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """(id_col, start, length, ids binary, doc_tokens, sequence_id, offset): the pieces of all documents, each ended by the id `end`.

    The tokenizer's file must be at path on every executor, and drop white space. special_as_text: the names of special tokens are text where a document holds them.
    A sequence's pieces come from one task, one after another.
    """
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        ids_of, packer, last = words(path, special_as_text), Packer(size, group), np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, bytes, list[int]]] = {}  # by the document's number: its id, ids, and how many are still to place
        n = 0

        def placed(found):
            nonlocal sequence
            rows = []
            for window in found:
                at = 0
                for doc, start, length in window:
                    key, ids, left = held[doc]
                    rows.append((key, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, at))
                    at += length
                    left[0] -= length
                    if not left[0]:
                        del held[doc]
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3), strict=True)], names=names)

        kind = pa.int64()
        for batch in bounded(batches, "text", ROWS, BYTES):
            kind = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), ids_of.encode([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                ids += last
                held[n] = (key, ids, [len(ids) // 4])
                yield from placed(packer.add(n, len(ids) // 4))
                n += 1
        yield from placed(packer.end())

    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, pad: int, size: int = SIZE) -> DataFrame:
    """(sequence_id, ids binary, n_tokens, starts): each sequence's ids one after another, padded to `size` unless their number is a power of two,
    and the offsets at which its pieces begin. A group has `size` pieces at most."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    one = F.lit(np.array([pad], "<u4").tobytes())
    room = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, 0).otherwise(size - F.col("n_tokens")).cast("int")
    body = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return whole.select("sequence_id", F.concat(body, F.when(room > 0, F.unhex(F.repeat(F.hex(one), room))).otherwise(F.lit(b""))).alias("ids"), "n_tokens", F.transform("p", lambda x: x["offset"]).alias("starts"))
