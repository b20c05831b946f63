"""Hard negatives, fill-in-middle and packing against brute force, and on the odd cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import fim, hardneg, packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns have names that the operators use themselves.
CLASH = "start int, length int, ids string, n int, form string, output string, id string, batch string, sequence_id string, label2 int, values int, shard int, block int, score int, rank int"


def with_clashes(df):
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CLASH.split(", ")) if c not in have])


# ---- hard negatives

VEC = "vec_id long, label int, embedding array<float>"


def mined(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    usable = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in usable:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in usable if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            found = sorted(x for x in scored if x[2] != lab and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(a, pid, rank + 1, i, -p, -s) for rank, (s, i, _) in enumerate(found)]
    return sorted(out)


def vectors(n, dim, seed, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = [(25 * k, int(r.integers(labels)), [float(np.float32(x)) for x in (centres[r.integers(6)] + r.normal(size=dim) * 0.4) / math.sqrt(dim)]) for k in range(n)]
    return rows + [(i, lab, v) for i, lab, v in rows[: n // 5]]  # repeated rows


def test_mine_equals_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0] * 12), (100, None, [1.0] * 12), (7, 1, None), (8, 1, []), (9, 1, [nan] + [1.0] * 11), (11, 1, [inf] + [1.0] * 11), (12, 1, [None] + [1.0] * 11), (13, 1, [1.0] * 5), (5000, 2, [0.0] * 12), (14, 2, [0.0] * 12), (15, 3, [0.0] * 12), (300, 0, [0.5] * 12), (301, 0, [1e30] * 12)]
    rows = vectors(160, 12, 3) + odd
    df = with_clashes(spark.createDataFrame(rows, VEC)).repartition(5)
    got = hardneg.mine(df, df.where("vec_id % 100 = 0"), shard=50, block=6)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined([r for r in rows if r[0] != 301])  # 301's products don't fit 64 bits
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    fewer = hardneg.mine(df, df.where("vec_id % 100 = 0"), positives=2, negatives=9, low=10, high=90, scale=1000, shard=1 << 20, block=1 << 20)
    assert sorted(map(tuple, fewer.collect())) == mined([r for r in rows if r[0] != 301], 2, 9, 10, 90, 1000)


def test_mine_of_nothing(spark):
    none = spark.createDataFrame([], VEC)
    assert hardneg.mine(none, none).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0])], VEC)
    assert hardneg.mine(one, one).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 50), st.integers(1, 5), st.integers(1, 70), st.sampled_from([1, 3, 40, 1 << 24]))
def test_planes_drop_nothing_that_qualifies(seed, n, m, d, most):
    r = np.random.default_rng(seed)
    v, a = r.integers(-most, most + 1, (n, d)), r.integers(-most, most + 1, (m, d))
    allowed, ids, planes = r.random((m, n)) < 0.7, r.permutation(n), hardneg.planes_of(v)
    exact = a @ v.T
    best = lambda i, ok: sorted((-int(exact[i, j]), int(ids[j])) for j in range(n) if ok[i, j])[:3]
    told = lambda i, j, s: [[(-int(s[x]), int(ids[j[x]])) for x in hardneg.first(i, s, ids[j], 3) if i[x] == k] for k in range(m)]
    assert told(*hardneg.positives_in(planes, d, a, allowed, 3)) == [best(i, allowed) for i in range(m)]
    least = r.integers(-d * most * most, d * most * most + 1, (m, 2))
    most_of = least + r.integers(-5, d * most * most + 1, (m, 2))
    for w, found in enumerate(hardneg.negatives_in(planes, d, a, allowed, least, most_of, 3)):
        inside = allowed & (exact >= least[:, w : w + 1]) & (exact <= most_of[:, w : w + 1])
        assert told(*found) == [best(i, inside) for i in range(m)]


def test_planes_are_dropped_early():
    """Candidates go before the last plane, so the search does more than compute all products."""
    r = np.random.default_rng(5)
    v = np.floor(r.normal(0, 32, (4000, 64))).astype(np.int64)
    p = hardneg.Products(hardneg.planes_of(v), 64, v[:4])
    left = []
    step = p.step
    while p.left > 3:
        step()
    low, high = p.interval()
    exact = v[:4] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    floor = np.partition(low, -5, axis=1)[:, -5]
    left = (high >= floor[:, None]).mean()
    assert left < 0.1


# ---- fill-in-middle

DOC = "doc_id long, text string"
TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "é́\n𝒳y\r\n\x0bz", "with <M> inside\nb", "<P>", "<S", "<\nP>\n<S\n>", "a\x00b\nc\x00", "x" * 200_000 + "\n" + "\n" * 50_000 + "tail", "l\n" * 60_000]


def cut(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(prefix), len(middle), s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("told", [{}, {"rate": 60, "spm": 20, "seed": 11}, {"marks": ("[PRE]", "«S»", "{m}")}])
def test_fim_equals_brute_force(spark, told):
    r = random.Random(2)
    rows = [*enumerate(TEXTS), *((100 + k, "".join(r.choice("ab<\n ") for _ in range(r.randint(1, 60)))) for k in range(150)), (None, "a\nb"), (5, "one\n"), (5, "one\n")]
    df = with_clashes(spark.createDataFrame(rows, DOC)).repartition(4)
    done = fim.restore(fim.transform(df, **told), **({"marks": told["marks"]} if "marks" in told else {})).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(c := cut(i, t, **told)), digest(c[-1]), t or "", digest(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, done))) == sorted(map(repr, want))
    assert {x.form for x in done} == {"plain", "psm", "spm"}


def test_fim_of_nothing_and_of_what_is_no_output(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], DOC))).count() == 0
    broken = spark.createDataFrame([(1, 1, "psm", 0, 0, "<S>b<P>a<M>", "")], f"doc_id long, {fim._CUT}")
    assert fim.restore(broken).first().restored is None
    with pytest.raises(ValueError):
        fim.transform(broken, marks=("<P>", "<P>x", "<M>"), text_col="output")


# ---- packing


def check_pack(rows, packed, tok, size=4096):
    """Every id in one piece, sequences gapless and not too long; the padding's share."""
    want = collections.Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in packed:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, p.doc_tokens, ids))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i in {r[0] for r in rows}:
        whole = sum((c[1] if isinstance(c[1], int) else len(c[1])) * n for c, n in want.items() if c[0] == i)
        assert sum(len(x[2]) for x in by_doc[i]) == whole
    for (i, ids), n in want.items():
        mine = [x for x in by_doc[i] if x[1] == len(ids) and list(ids[x[0] : x[0] + len(x[2])]) == x[2]]
        covered = collections.Counter(k for start, _, part in mine for k in range(start, start + len(part)))
        assert all(covered[k] >= n for k in range(len(ids)))
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort()
        n = sum(x[1] for x in pieces)
        assert n <= size and [x[0] for x in pieces] == [sum(y[1] for y in pieces[:k]) for k in range(len(pieces))]
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding / sum(sum(y[1] for y in x) for x in by_sequence.values())


def test_pack(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(int(r.paretovariate(0.9) * 40) % 3000 + 1)) for i in range(400)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, text(30_000)), (1004, "x" * 90_000), (None, "a b"), (7, "same"), (7, "same")]
    df = with_clashes(spark.createDataFrame(rows, DOC)).repartition(4)
    packed = packing.pack(df, WORD_BPE, 2)
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert check_pack(rows, packed.collect(), packing.tokenizer(WORD_BPE)) < 0.01
    small = packing.pack(df, WORD_BPE, 2, size=256, group=16)
    assert check_pack(rows, small.collect(), packing.tokenizer(WORD_BPE), 256) < 0.08
    assert packing.pack(spark.createDataFrame([], DOC), WORD_BPE, 2).count() == 0


def test_sequences(spark):
    rows = [(1, "a b c d e f g"), (2, "one two"), (3, None)]
    packed = packing.pack(spark.createDataFrame(rows, DOC).repartition(2), WORD_BPE, 2)
    parts = collections.defaultdict(list)
    for p in packed.collect():
        parts[p.sequence_id].append((p.offset, p.ids))
    for s in packing.sequences(packed, 0).collect():
        joined = b"".join(x for _, x in sorted(parts[s.sequence_id]))
        n = len(joined) // 4
        assert s.n_tokens == n and bytes(s.ids) == joined + (b"" if n & (n - 1) == 0 else bytes(4 * (4096 - n))) and s.starts == sorted(x for x, _ in parts[s.sequence_id])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_places_each_piece_once_and_levels(sizes, k):
    parted = packing.difference(sizes, k)
    assert len(parted) == k and sorted(i for w in parted for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in parted]
    assert max(sums) - min(sums) <= max(sizes)  # merging opposing imbalances never leaves more than the largest piece


def test_windows_rise_when_a_window_exceeds_the_size():
    found = packing.windows([(i, 0, packing.SMALL) for i in range(3)], packing.SMALL * 3 // 2)  # two windows would hold all, but no window two pieces
    assert len(found) == 3 and all(len(w) == 1 for w in found)
    found = packing.windows([(i, 0, 60) for i in range(150)], 100)  # many windows: whole pieces
    assert len(found) == 150
    assert len(packing.windows([(i, 0, 60) for i in range(3)], 100)) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=80), st.sampled_from([64, 256]), st.integers(1, 6))
def test_packer_places_every_id_once(lengths, size, group):
    p = packing.Packer(size, group)
    found = [w for i, n in enumerate(lengths) for w in p.add(i, n)] + list(p.end())
    seen = collections.Counter((doc, start + k) for w in found for doc, start, n in w for k in range(n))
    assert seen == collections.Counter((i, k) for i, n in enumerate(lengths) for k in range(n))
    assert all(0 < sum(x[2] for x in w) <= size for w in found)


@pytest.mark.parametrize("text", ["a\x0bb\x0cc\x1cd\x85e f g　h", "don't I'LL 'S x's", "ΑΣ ΟΔΟΣ Σ ΣΑ.", "é ́a ộ", "<|endoftext|>a <|startoftext|>", "İstanbul ǅ ﬁ 12345 ½", "\0 a\0b", "😀👍🏽 x", "a" * 5000 + " b", "word " * 300_000, "ab­​cd ０１", "H̱ ẖ"])
def test_words_encode_as_whole_texts(text):
    tok = packing.tokenizer(WORD_BPE)
    got = packing.Words(tok, keep=3).encode([text.encode(), b"", b" a ", text.encode()])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in (text, "", "a", text)]


def test_words_that_are_forgotten_come_again():
    tok, r = packing.tokenizer(WORD_BPE), random.Random(1)
    w = packing.Words(tok, keep=20)
    for _ in range(30):
        texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
