"""The training-data operators against brute force and on the odd cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import datetime
import gzip
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import bpe, chat, common, minhash, mixing, pii, quality, secrets, shingles, suffix, vptree, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, ids int, score string, verdict int, key string, id string, node string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "k", "i", "n") for i, t, s in rows], DOC).repartition(3)


def words(n, seed, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


LONG = words(30_000, 5)
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "One TWO three four", "b"), (6, words(60, 1), "a"), (7, words(60, 1), "a"), (7, words(60, 1), "a"), (8, LONG, "c"), (None, words(60, 1), "a"), (9, words(60, 1).upper(), "é"), (10, words(59, 1), "b")]


def tokens_of(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = tokens_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed, n=120):
    """Bases with copies that differ in more and more words."""
    r, rows = random.Random(seed), []
    for base in range(6):
        w = words(80, 100 + base).split()
        for _ in range(n // 6):
            c = list(w)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = f"edit{r.random()}"
            rows.append((len(rows), " ".join(c)))
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_equals_brute_force(spark, percent):
    rows = near_copies(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.cluster(docs(spark, [(i, t, "s") for i, t in rows]), percent=percent).collect()}
    want = brute_components(rows, percent)
    assert got == {i: (len(shingle_set(t)), want[i], want[i] == i) for i, t in rows}


def test_near_dedup_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "MOST", 4)
    rows = near_copies(3)
    got = {r.doc_id: r.component_id for r in minhash.cluster(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows, 85)


def outsiders(n):
    """A large group of near copies, and five texts that share bands with it but are not similar enough."""
    r, base = random.Random(n), words(300, 77).split()

    def edited(k):
        c = list(base)
        for at in r.sample(range(len(c)), k):
            c[at] = f"edit{r.random()}"
        return " ".join(c)

    return [(i, edited(2)) for i in range(n)] + [(n + i, edited(14)) for i in range(5)]


def test_near_dedup_grows_with_the_group(spark, monkeypatch):
    """Rows that are compared in blocks grow with the members, not with their square; hot keys are dealt into parts."""
    counted, cut = {}, minhash.cut

    def counting(df, name):
        out = cut(df, name)
        counted.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "cut", counting)
    monkeypatch.setattr(common, "LEAST", 50)
    met = []
    for n in (800, 3200):
        counted.clear()
        rows = outsiders(n)
        got = minhash.cluster(docs(spark, [(i, t, "s") for i, t in rows])).where("kept").collect()
        assert [r.doc_id for r in got if r.doc_id < n] == [0] and len(got) == 6
        met.append(counted["minhash-meetings"][0])
    assert 800 < met[0] and met[1] < 5 * met[0]


def test_near_dedup_shuffles_where_ids_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SENT", 0)
    rows = near_copies(9)
    got = {r.doc_id: r.component_id for r in minhash.cluster(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows, 85)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 7)
    many = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(200)] + [(900, 77)], "id long, k long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, v string")
    sizes = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(common.spread_join(many, one, "k", 201, sizes, how).select("id", "k", "v").collect(), key=str)
        assert got == sorted(many.join(one, "k", how).select("id", "k", "v").collect(), key=str)
    parts = common.spread_join(many, one, "k", 201, sizes, "left")
    assert "__part" not in parts.columns


def test_shared_folder(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        assert common.shared_dir(spark) == common.shared_dir(spark)
    since = common.mark()
    a, b = common.cut(spark.range(3), "test"), common.cut(spark.range(4), "test")
    common.sweep(spark, since, b)
    assert b.count() == 4 and common.mark() == since + 1
    common.drop(b)
    assert common.mark() == since


def test_near_dedup_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.cluster(docs(spark, ODD)).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == len(ODD)
    assert by[1] == (1, 0, 1, True) and by[3] == (3, 0, 3, True) and by[4] == (4, 1, 4, True)
    assert by[7][2] == by[9][2] == by[10][2] == 6 and by[None] == (None, 56, None, True)
    kept = minhash.representatives(docs(spark, [*ODD, (4, "one", "b")]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8]
    assert kept.columns == docs(spark, ODD).columns


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        errors = []
        for n in (3, 40, 2000):
            both = shingles.mix(r.integers(0, 1 << 63, n, dtype=np.uint64))
            extra = shingles.mix(r.integers(0, 1 << 63, round(n * (1 / share - 1)), dtype=np.uint64))
            a, b = np.unique(both), np.unique(np.concatenate([both, extra]))
            x, y = (np.frombuffer(s, "<u2") for s in minhash.sketch([a, b]))
            errors.append(minhash.estimate(np.array([(x == y).sum()]), np.array([len(a)]), np.array([len(b)]))[0] - len(a) / len(b))
        assert max(map(abs, errors)) < 0.2
    sets = [np.arange(5, dtype=np.uint64), np.arange(3, 9, dtype=np.uint64), np.arange(3, dtype=np.uint64)]
    assert np.array_equal(minhash.intersections(sets[:2], sets), [[5, 2, 3], [2, 6, 0]])


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def repeated_rows(seed):
    r = random.Random(seed)
    parts = [words(r.randint(5, 60), 900 + k, "abé") for k in range(12)] + ["x" * 300, "ab" * 200, words(15, 1)]
    return [(i, "".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 6)))) for i in range(40)]


@pytest.mark.parametrize(("seed", "pack", "bucket", "unit", "hot"), [(1, 4 << 20, 4 << 20, 1 << 20, 8192), (2, 700, 500, 300, 8192), (3, 2000, 10**9, 50, 8192), (4, 700, 500, 300, 3), (5, 2000, 900, 50, 2)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, seed, pack, bucket, unit, hot):
    monkeypatch.setattr(suffix, "PACK", pack)
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "TOGETHER", 60 if hot < 10 else 1 << 22)
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    monkeypatch.setattr(suffix, "UNIT", unit)
    rows = repeated_rows(seed)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect())
    assert got == brute_repeats(rows)


def test_suffix_dedup_parts_a_hot_anchor(spark, monkeypatch):
    """One passage in every document: the texts around it are dealt into many buckets, and rows of one id don't depend on the partitions."""
    passage, r = words(40, 8), random.Random(8)
    rows = [(i, f"{words(6, 1000 + i)} {passage} {words(6, 5000 + i)}") for i in range(1500)]
    dealt, marks = {}, suffix.marks

    def seen(out):
        dealt[suffix.HOT] = max(x.n for x in out.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.length("what")).alias("n")).collect())
        return marks(out)

    monkeypatch.setattr(suffix, "marks", seen)
    monkeypatch.setattr(suffix, "BUCKET", 1000)
    got = {}
    for hot in (8192, 50):
        monkeypatch.setattr(suffix, "HOT", hot)
        got[hot] = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix.dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect())
        assert got[hot] == brute_repeats(rows)
    assert dealt[50] < dealt[8192] / 3
    twice = [(7, passage + words(9, k), "s") for k in range(12)]
    r.shuffle(twice)
    both = [sorted((x.n_removed, bytes(x.kept)) for x in suffix.dedup(docs(spark, twice).repartition(n)).collect()) for n in (1, 5)]
    assert both[0] == both[1] and [n for n, _ in both[0]].count(0) == 1


def test_suffix_dedup_odd_rows(spark):
    got = suffix.dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    twice = sorted(r.n_removed for r in got if r.doc_id == 7)
    text = words(60, 1)
    assert twice == [len(text)] * 2  # document 6 has the text already
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (1, 2, 3, 4, 6)} == dict.fromkeys((1, 2, 3, 4, 6), 0)
    assert [r.n_removed for r in got if r.doc_id is None] == [len(text)]


def test_merged_transforms_are_sorted():
    r = np.random.default_rng(3)
    texts = [np.append(r.integers(1, 4, n), 0).astype(np.uint16) for n in (50, 80, 7)]
    places, common = suffix.merge(texts, 8)
    assert np.array_equal(suffix.placed(np.array([70000, 3, 70000, 1], np.uint32)), [3, 1, 0, 2])
    whole = np.concatenate(texts)
    heads = [tuple(whole[p : p + 8]) for p in places if 0 not in whole[p : p + 8] and p + 8 <= len(whole)]
    assert heads == sorted(heads)
    inside = [0 not in whole[p : p + 8] and p + 8 <= len(whole) for p in places]
    for i in range(1, len(places)):
        if inside[i] and inside[i - 1]:
            a, b = whole[places[i - 1] : places[i - 1] + 8], whole[places[i] : places[i] + 8]
            assert common[i] == (8 if (a == b).all() else 4 if (a[:4] == b[:4]).all() else 0)


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii_formats_and_links(spark):
    cards = [p + str(next(c for c in range(10) if luhn(p + str(c)))) for p in (f"{4000 + k}{k:07}{k % 7}555"[:15] for k in range(200))]
    ssns = [f"{100 + k % 500:03}-{1 + k % 98:02}-{1000 + k:04}" for k in range(200)]
    dates = [f"{1900 + k % 150}-{1 + k % 12:02}-{1 + k % 28:02}" for k in range(336)]
    ips = [f"{k}.{k + 1}.{k % 7}.{255 - k}" for k in range(200)]
    mails = [f"n{k}.ab@host.example.org" for k in range(100)]
    everything = cards + ssns + sorted(set(dates)) + ips + mails
    rows = [(i, f"a {v} b, {v}; c", "s") for i, v in enumerate(everything)]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "key").collect()}
    after = []
    for i, v in enumerate(everything):
        m = re.fullmatch(r"a (.+) b, (.+); c", got[i].text)
        assert m[1] == m[2] and len(m[1]) == len(v) and len(got[i].pii_kinds) == 2
        assert re.sub(r"\d", "9", m[1]) == re.sub(r"\d", "9", v) or v in mails
        after.append(m[1])
    assert len(set(after)) == len(everything)  # a permutation: different values stay different
    assert sum(a == b for a, b in zip(after, everything)) < 3
    assert all(luhn(x) for x in after[: len(cards)])
    again = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, rows), "other key").collect()}
    assert sum(again[i] == got[i].text for i in again) < 3


def test_pii_leaves_the_rest(spark):
    texts = [None, "", "no numbers", "1234567890123456", "256.1.1.1", "1990-02-30", "000-12-3456", "user@host", "GB82WEST12345698765431", LONG]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), "k").collect()}
    assert [got[i].text for i in range(len(texts))] == texts and not any(got[i].pii_kinds for i in got)
    same = pii.pseudonymise(docs(spark, [(1, "4337166598464399 and 4337-1665-9846-4399, GB82 WEST 1234 5698 7654 32", "s")]), "k").first()
    a, b = re.findall(r"[0-9-]{16,}", same.text)
    assert a == b.replace("-", "") and same.pii_kinds == ["card", "card", "iban"]


def test_pii_of_texts_that_repeat_a_group(spark):
    """A host of 120 labels gets one pseudonym alone and beside a card; long texts that repeat what a pattern repeats end no worker."""
    host = "me@" + "ab." * 119 + "org"
    long = ["x@" + "a." * 500_000 + "org", "a@b.org +" + "1" * 100_000, "x@" + "a." * 2_000 + "org 4111 1111 1111 1111 1", "+1" + " 2" * 300 + "\n@", "4111 " * 100 + "@", "DE89" + " A1" * 100, "1." * 300]
    rows = [(1, host, "s"), (2, f"4111 1111 1111 1111 12/26 {host} 4111 1111 1111 1111 1", "s"), *[(10 + i, t, "s") for i, t in enumerate(long)]]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "k").collect()}
    assert got[1].pii_kinds == ["email"] and got[1].text != host
    assert got[2].pii_kinds == ["card", "email", "card"] and got[1].text in got[2].text
    assert [len(got[10 + i].text) for i in range(len(long))] == [len(t) for t in long]


def test_pii_beside_other_digits(spark):
    """Numbers that touch a neighbour across a separator: text, number in it, kinds; the rest stays, and all copies get one pseudonym."""
    card, iban = "4111 1111 1111 1111", "DE89370400440532013000"
    around = ["{} 12/26", "{} 123", "{}-1234", "98765 {}", "98765 {} 12/26 123", "{} 42, or {} 7", "order 12-{} 2026", "a\n{} 12\nb", "1234 {} 00", "ID12 {} X"]
    cards = [(a, c, ["card"] * a.count("{}")) for a in around for c in (card, card.replace(" ", "-"), card.replace(" ", ""), "3782 822463 10005")]
    rows = [
        *cards,
        *[(a, i, ["iban"]) for a in ("{} USD 500", "{} EUR", "{} A1 B2", "AB12 {} X") for i in (iban, "DE89 3704 0044 0532 0130 00")],
        *[(f"order 1234 {{}} {x}".rstrip(), "456-78-9012", ["ssn"]) for x in ("", "b")],
        ("12345678 {}", "555-123-4567", ["phone"]),
        (f"+49 30 123456 {{}}", card, ["phone", "card"]),
        (f"+1 {{}}", card, ["card"]),
        ("{} 10.0.0.1", card, ["card", "ipv4"]),
        ("{} 12/26/2024", card, ["card", "date"]),
        ("{} 12.ab@host.example.org", card, ["card", "email"]),
        (f"{iban} {{}}", card, ["iban", "card"]),
    ]
    texts = [a.format(*[v] * a.count("{}")) for a, v, _ in rows]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, [(i, t, "s") for i, t in enumerate([*texts, "4111111111111111", iban])]), "k").collect()}
    flat = lambda s: re.sub("[ -]", "", s)
    alone = {flat(card): got[len(texts)].text, iban: got[len(texts) + 1].text}
    for i, (a, v, kinds) in enumerate(rows):
        assert got[i].pii_kinds == kinds, texts[i]
        assert v not in got[i].text and len(got[i].text) == len(texts[i])
        at = texts[i].index(v)
        assert flat(got[i].text[at : at + len(v)]) == alone.get(flat(v), flat(got[i].text[at : at + len(v)])), texts[i]
        if len(set(kinds)) == 1:
            assert got[i].text.replace(got[i].text[at : at + len(v)], v) == texts[i]


def plain_feistel(values, radix, half, key, tweak, rounds):
    for r in range(rounds):
        left = r % 2 == 0
        seed = f"{key}|{tweak}|{r}|{','.join(map(str, values[half:] if left else values[:half]))}"
        bits = "".join(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:60] for k in range((len(values) - 1) // 10 + 1))
        values = [(v + int(bits[6 * i : 6 * i + 6], 16)) % radix[i] if (i < half) == left else v for i, v in enumerate(values)]
    return values


def plain_chars(text, fixed, key, tweak):
    head, tail = text[:fixed], text[fixed:]
    shape = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", tail)))
    chars = re.sub("[^0-9A-Za-z]", "", tail)
    if not chars:
        return text
    base = [48 if c.isdigit() else 97 if c.islower() else 65 for c in chars]
    radix = [10 if b == 48 else 26 for b in base]
    values, key = [ord(c) - b for c, b in zip(chars, base)], f"{key}|{head}{shape}"
    if len(chars) == 1:
        w = radix[0] // 2
        a, b = plain_feistel([values[0] // w, values[0] % w], [2, w], 1, key, tweak, pii.SMALL_ROUNDS)
        values = [a * w + b]
    else:
        values = plain_feistel(values, radix, (len(chars) + 1) // 2, key, tweak, pii.SMALL_ROUNDS if len(chars) <= 3 else pii.ROUNDS)
    new = iter(chr(v + b) for v, b in zip(values, base))
    return head + re.sub("[0-9A-Za-z]", lambda m: next(new), tail)


def plain_pseudonym(kind, m, key):
    """What pii.pseudonym() must give, told again for one value."""
    flat = re.sub("[^0-9A-Za-z]", "", m)
    put = lambda new: (lambda it: re.sub("[0-9A-Za-z]", lambda _: next(it), m))(iter(new))
    if kind == "email":
        local, at = m[: m.index("@")], m[m.index("@") :]
        return plain_chars(local, 0, f"{key}|{at.lower()}", "email") + at
    if kind == "card":
        front = plain_chars(flat[:-1], 0, key, "card")
        return put(front + next(str(c) for c in range(10) if luhn(front + str(c))))
    if kind == "iban":
        made = plain_chars(flat[:2] + "00" + flat[4:], 4, key, "iban")
        number = int("".join(str(int(c, 36)) for c in made[4:] + made[:2] + "00"))
        return put(f"{made[:2]}{98 - number % 97:02}{made[4:]}")
    if kind == "phone":
        code = re.match(r"\+([0-9]{1,3})(?=[ .(-])|\+[0-9]", m)
        return put(plain_chars(flat, len(code[0]) - 1 if code else 0, key, "phone"))
    if kind == "ssn":
        m = plain_chars(m, 0, key, "ssn")
        while not re.fullmatch("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", m):
            m = plain_chars(m, 0, key, "ssn")
        return m
    if kind == "ipv4":
        parts = m.split(".")
        low, wide = ([{1: a, 2: b, 3: c}[len(x)] for x in parts] for a, b, c in ((0, 10, 100), (10, 90, 156)))
        moved = plain_feistel([int(x) - b for x, b in zip(parts, low)], wide, 2, f"{key}|{''.join(str(len(x)) for x in parts)}", "ipv4", pii.ROUNDS)
        return ".".join(str(v + b) for v, b in zip(moved, low))
    d = datetime.date.fromisoformat(m)
    block, inside = divmod((d - datetime.date(1600, 1, 1)).days, 146097)
    a, b = plain_feistel(list(divmod(inside, 773)), [189, 773], 1, key, "date", pii.ROUNDS)
    return (datetime.date(1600, 1, 1) + datetime.timedelta(block * 146097 + a * 773 + b)).isoformat()


def test_pii_equals_a_plain_feistel_network(spark):
    values = [("email", f"{'a' * n}@example.org") for n in range(1, 65)] + [("email", f"{c}@example.org") for c in "bcdefghijklmnopqrstuvwxyz"]
    values += [("email", x) for x in ("a.@b.example.org", "X@Example.org", "7@example.org", "a_b-c.9@example.org", "a1@example.org", "...@example.org")]
    values += [("card", x) for x in ("4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005")] + [("iban", x) for x in ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32")]
    values += [("phone", x) for x in ("+49 30 1234567", "+4930123456", "(555) 123-4567", "555-123-4567")] + [("ssn", f"{k:03}-12-3456") for k in range(100, 160)]
    values += [("ipv4", x) for x in ("10.1.2.3", "192.168.1.1", "1.2.3.4")] + [("date", x) for x in ("1999-12-31", "2000-02-29", "2026-01-01", "1600-01-01")]
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k1").collect()}
    for i, (kind, v) in enumerate(values):
        assert (got[i].pii_kinds, got[i].text) == ([kind], plain_pseudonym(kind, v, "k1"))


def test_pii_leaks_no_relation_of_places(spark):
    """Equal characters of one value get independent ones: no difference between two places is the same whatever the key."""
    df = spark.createDataFrame([(n, f"{'a' * n}@example.org") for n in (2, 3, 12, 21, 40, 64)] + [(100 + i, f"{c}@example.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string")
    seen = {}
    for key in ("a", "b", "c", "d", "e"):
        got = {r.doc_id: r.text.split("@")[0] for r in pii.pseudonymise(df, key).collect()}
        for n in (2, 3, 12, 21, 40, 64):
            for i in range(n):
                for j in range(i):
                    seen.setdefault((n, j, i), set()).add((ord(got[n][i]) - ord(got[n][j])) % 26)
        single = [ord(got[100 + i]) - 97 for i in range(26)]
        assert sorted(single) == list(range(26))
        assert len({(b - a) % 26 for a, b in zip(single, single[1:])}) > 3  # no plain shift
    assert min(len(x) for k, x in seen.items() if k[0] > 2) > 1


def test_pii_key_shows_in_no_plan(spark, capsys):
    d = spark.createDataFrame([(1, "a@example.org")], "doc_id long, text string")
    pii.pseudonymise(d, "very-hidden").explain("extended")
    assert "very-hidden" not in capsys.readouterr().out
    with pytest.raises(ValueError):
        pii.pseudonymise(d)
    spark.conf.set(pii.KEY_SETTING, "very-hidden")
    try:
        assert pii.pseudonymise(d).collect() == pii.pseudonymise(d, "very-hidden").collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def base_counts(text):
    t = text or ""
    w = tokens_of(t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_base_counts(spark):
    rows = [*ODD, (20, "a b c d e f g h " * 6, "s"), (21, "x\ny\nx\n \nx \n#*$ <|>", "s"), (22, words(40, 3) + "\n" + words(40, 3), "s")]
    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = quality.judge(d, quality.fit(d, labels)).select("text", "verdict.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(r.text)
        assert not (r.base_failed and r.kept)
    none = quality.judge(d, quality.fit(d, labels.limit(0))).select("verdict.*").collect()
    assert {r.score for r in none} == {0.0} and all(r.kept != r.base_failed for r in none)


def brute_scores(rows, good, buckets=None):
    """Score of each text, told again with counters."""
    buckets = buckets or quality.BUCKETS
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long_hash = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)

    def grams(text):
        tokens = WORD.findall(re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", text or ""))
        h = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in tokens]
        return [x % buckets for x in h] + [signed(long_hash(y, long_hash(x, 42))) % buckets for x, y in zip(h, h[1:])]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    r, n = sum(raw.values()), sum(target.values())
    if not n:
        return [0.0] * len(rows), 0.0
    more = r / n
    llr = [math.log((target[b] + 1) / (n + buckets)) - math.log((raw[b] + more) / (r + more * buckets)) for b in range(buckets)]
    return [sum(llr[b] for b in g) / len(g) if (g := grams(t)) else 0.0 for _, t in rows], -math.log(1 + n / r)


def test_quality_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t, _ in ODD] + [(100 + i, words(30 + i, i) + (" ***" * (i % 4))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100, 130)] + [(6, 1, 0), (6, 0, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(100, 130) if i % 3} | {8}
    d = docs(spark, [(i, t, "s") for i, t in rows])
    got = sorted(((r.doc_id, r.text, r.score, r.base_failed, r.kept) for r in quality.judge(d, quality.fit(d, labels)).select("doc_id", "text", "verdict.*").collect()), key=str)
    scores, least = brute_scores(rows, good)
    want = sorted([(i, t, s) for (i, t), s in zip(rows, scores)], key=lambda x: str(x[:2]))
    for (i, t, s, failed, kept), (wi, wt, ws) in zip(sorted(got, key=lambda x: str(x[:2])), want, strict=True):
        assert (i, t) == (wi, wt) and s == pytest.approx(ws, abs=1e-9)
        assert failed == base_counts(t)[5] and kept == (not failed and s >= least - quality.MARGIN)
    assert quality.judge(d.limit(0), quality.fit(d.limit(0), labels.limit(0))).count() == 0


def test_quality_holds_on_labels_that_were_not_fitted(spark):
    """Documents and labels of the driver's table: the score parts good from bad ones among those that the model never saw a label of."""
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.fit(d.select("doc_id", "text"), labels.where("doc_id % 2 = 0"))
    held = quality.judge(d.select("doc_id", "text"), fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "verdict.score", "verdict.base_failed").where("NOT base_failed").collect()
    good, bad = ([r.score for r in held if r.quality == k] for k in (1, 0))
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert len(good) > 50 and (not bad or above / (len(good) * len(bad)) > 0.9)


def test_quality_parts_good_from_junk(spark):
    good = [(i, " ".join(random.Random(i).choices("the of and house river stone walk green light".split(), k=80)), "s") for i in range(60)]
    junk = [(100 + i, " ".join(w + "***" for w in words(80, i).split()), "s") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    d = docs(spark, good + junk)
    got = {r.doc_id: r.kept for r in quality.judge(d, quality.fit(d, labels)).select("doc_id", "verdict.kept").collect()}
    assert [i for i, k in got.items() if not k and i < 100] == [] and not any(k for i, k in got.items() if i >= 100)


def test_vp_trees_are_exact(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 6)).astype(np.float32)
    x[100:160] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1), (905, [float("inf")] + [0.0] * 5, 1), (906, [1.0, 2.0], 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    df = df.unionByName(df.where("vec_id = 45"))  # rows of one id are candidates of their own
    x = np.concatenate([x, x[45:46]])
    ident = [*range(700), 45]
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), shard=150, block=4).collect()
    found = {}
    for h in sorted(got, key=lambda h: h["rank"]):
        found.setdefault(h.query_id, []).append((h.vec_id, h.score))
    assert set(found) == set(range(0, 700, 20))
    for q, hits in found.items():
        scores = vptree.inner(x[q].astype(float), x.astype(float))
        want = sorted((i for i in range(701) if ident[i] != q), key=lambda i: (-scores[i], ident[i]))[:20]
        assert [i for i, _ in hits] == [ident[i] for i in want] and [s for _, s in hits] == [scores[i] for i in want]
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 1.0], 1)], df.schema)
    assert [(h.query_id, h["rank"], h.vec_id, h.score) for h in vptree.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]


def test_vp_tree_recall_with_a_relaxed_factor():
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 4
    x = (centres[r.integers(0, 20, 3000)] + r.normal(size=(3000, 8)))
    tree = vptree.Tree(vptree.lift(x))
    q = np.hstack([x[:50], np.zeros((50, 1))])
    exact = np.argsort(-(x[:50] @ x.T), 1)[:, :10]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = tree.search(q, 10, factor)
        assert np.mean([len({*e} & {*g}) / 10 for e, g in zip(exact, got)]) >= least


def brute_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "apikey", "API_KEY", "=", ": ", '"', " ", "\n", "AKIA", "AKIA9Z8Y7X6W5V4U3T", "deadbeef", "0123456789abcdef", "é", "abcdefghijkl", "Xy9+/-_.", "=="]), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert secrets._said(secrets.base_spans(text)) == brute_spans(text)
    base, spans = secrets.spans_of(text)
    assert set(base) <= set(spans)


def test_secrets_link_weak_parts(spark):
    alone = "user: bob"
    both = "user: bob\npassword: short1"
    far = "user: bob" + " x" * 400 + "\npassword: short1"
    apart = "user: bob\n\npassword: short1"
    three = "https://db.example.org/x user=bob password=hunter2"
    d = docs(spark, [(i, t, "s") for i, t in enumerate([alone, both, far, apart, three, None, "", LONG])])
    got = {r.doc_id: r.spans for r in secrets.scan(d).collect()}
    assert [got[i] for i in (0, 3, 5, 6)] == [""] * 4
    assert got[2] == f"ident:0:9,part:{far.index('password')}:{len(far)}"
    assert got[1] == "ident:0:9,part:10:26" and [x.split(":")[0] for x in got[4].split(",")] == ["endpoint", "ident", "part"]
    assert secrets.summary(secrets.scan(d)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def brute_links(text):
    """Each weak part against all other parts of its scope, pair by pair, in scopes cut out of the text."""
    base, weak = secrets.base_spans(text), secrets.weak_parts(text)
    clear = lambda x, y: x[2] <= y[0] or y[2] <= x[0]
    weak = [w for w in weak if w[1] == 5 or all(clear(w, x) for x in base)]
    scope = lambda x: len(re.findall(r"\n[ \t\r]*\n", text[: x[0]]))
    out = set(base)
    for w in weak:
        others = [x for x in {*base, *weak} if scope(x) == scope(w) and clear(x, w)]
        secret, ident = [x for x in others if x[1] in (0, 2, 4)], [x for x in others if x[1] in (1, 3)]
        if {3: bool(secret), 4: bool(ident), 5: any(clear(x, y) for x in secret for y in ident)}[w[1]]:
            out.add(w)
    return sorted(out)


PARTS = ["user: bob", "password: short1", "token=abc123def456ghi7", "AKIA9Z8Y7X6W5V4U3T", "0123456789abcdef", "https://db.example.org/x", "https://h/?user=aB3dEfGh1jKlMnOpQ", "account: aB3dEfGh1jKlMnOpQ", "user: password: hunter2", "Zm9vYmFyOTk4N2FiQ0RFRkdI", " and words ", "\n", "\n\n", "\n \n", "filler " * 80]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map(" ".join))
def test_secret_links_equal_all_pairs(text):
    assert secrets.spans_of(text)[1] == brute_links(text)


def test_secret_links_at_any_distance_but_not_with_themselves():
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)[1]]
    for lone in ("account: aB3dEfGh1jKlMnOpQ", "user=aB3dEfGh1jKlMnOpQ\n", "password: hunter2", "key_id: Zm9vYmFyOTk4N2FiQ0RFRkdI", "https://h/?user=aB3dEfGh1jKlMnOpQ"):
        assert kinds(lone) == []
    assert kinds("user: bob" + "-" * 500_000 + " password: hunter2") == ["ident", "part"]
    assert kinds("user: bob\n\npassword: hunter2") == []
    assert kinds("user: bob " * 20_000 + "password: hunter2").count("ident") == 20_000


def test_arc_lines_and_lengths():
    for version in (1, 2):
        data = warc.arc_head(version, "a.arc") + warc.arc_record(version, "http://a b/ü", "20010203040506", b"HTTP/1.1 200 OK\r\n\r\nhi\n\nthere") + warc.arc_record(version, "http://c/", "2001", b"") + b"\nnonsense\n" + warc.arc_record(version, "http://d/", "2001", b"abc")[:-1]
        got = list(warc.parse_arc(data))
        assert [(r.version, r.fields["url"], r.block, r.truncated) for r in got] == [(version, "http://a_b/ü", b"HTTP/1.1 200 OK\r\n\r\nhi\n\nthere", False), (version, "http://c/", b"", False), (version, "http://d/", b"ab", True)]
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert list(warc.parse_arc(b"")) == []


@given(st.integers(-(2**63), 2**63 - 1))
def test_record_ids_hold_their_keys(key):
    made = warc.record_id(key, "x")
    assert warc.key_in(f"<{made}>") == key and made[23] == "8" and made[28] in "89ab"


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "u5", big), (3, "u 3", big), (9, None, big), (9, "u9", big), (1, "u1", "small"), (2, "u2", "small"), (4, "u4", None), (6, "u6", ""), (7, "u7", "y" * 200_000), (-8, "u8", "y" * 200_000), (None, "n", big)]
    pages = spark.createDataFrame([(a, b, c, "k", "d") for a, b, c in rows], "page_id long, url string, html string, key string, digest string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    first = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", k)
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        again = k is not None and len(b) >= 100 and k > first[h or ""]
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_foreign_archives(spark, tmp_path):
    """Keys that are no numbers, bytes that aren't UTF-8, bare line feeds, origins that told no length: nothing fails, and lengths are those of the payloads."""
    page = b"<p>" + b"\xff\xfe" * 100
    heads = [b"HTTP/1.0 200 OK\r\nX-Record-Key: 5\r\n\r\n", b"HTTP/1.0 200 OK\nX-Record-Key: 7\nContent-Type: text/html\n\n", b"HTTP/1.0 200 OK\r\nX-Record-Key: no number\r\n\r\n", b"HTTP/1.0 200 OK\r\nX-Record-Key: \xff\xfe\r\n\r\n", b"HTTP/1.0 200 OK\r\nX-Record-Key: 99999999999999999999\r\n\r\n", b""]
    data = warc.arc_head(1, "f.arc") + b"".join(warc.arc_record(1, f"http://h/{i}", "2001", h + page) for i, h in enumerate(heads))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.arc").write_bytes(data)
    warc.write_warcs(warc.read_arcs(warc.load_arcs(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    got = sorted(map(tuple, warc.read_warcs(spark, str(tmp_path / "out")).collect()), key=str)
    digest = hashlib.sha256(page).hexdigest()
    assert got == sorted([(5, len(page), digest, "response", None), (7, len(page), digest, "revisit", 5)] + [(None, len(page), digest, "response", None)] * 4, key=str)
    assert warc.whole("12") == 12 and warc.whole("-3") == -3 and warc.whole("1e3") is None and warc.whole(None) is None


def test_arcs_are_bounded_in_bytes(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("x"), 1 << 20), F.col("id").cast("string")).alias("html")).coalesce(1)
    sizes = [r.n for r in warc.make_arcs(pages).select(F.octet_length("content").alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < warc.ARC_BYTES + (2 << 20)
    assert warc.round_trip(pages).where(F.col("payload_bytes") >= 1 << 20).count() == 40


def test_warc_files(spark, tmp_path):
    """Each record is a gzip member of its own, each file begins with a warcinfo and stays within its bytes; archives come from a folder, gzipped or not."""
    (tmp_path / "arcs").mkdir()
    pages = [(i, f"http://h/{i}", "HTTP/1.1 200 OK\r\n" + f"{warc.KEY}: {i}\r\n\r\n" + "x" * (i * 100)) for i in range(30)]
    for n, version in ((0, 1), (1, 2)):
        parts = [warc.arc_head(version, f"{n}.arc"), *[warc.arc_record(version, u, "20010101", b.encode()) for i, u, b in pages if i % 2 == n]]
        raw = b"".join(map(gzip.compress, parts)) if n else b"".join(parts)
        (tmp_path / "arcs" / f"{n}.arc").write_bytes(raw)
    records = warc.read_arcs(warc.load_arcs(spark, str(tmp_path / "arcs")))
    warc.write_warcs(records.coalesce(1), str(tmp_path / "out"), per_file=3, bundle=2000)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 3
    n = 0
    for f in files:
        data, members = f.read_bytes(), 0
        while data:
            z = zlib.decompressobj(31)
            record = z.decompress(data)
            assert z.eof and record.startswith(b"WARC/1.1\r\n") and (b"WARC-Type: warcinfo" in record) == (members == 0)
            data, members = z.unused_data, members + 1
        n += members - 1
    assert n == 30
    got = {r.key: r.payload_bytes for r in warc.read_warcs(spark, str(tmp_path / "out")).collect()}
    assert got == {i: i * 100 for i in range(30)}
    assert len(warc.member(b"a" * (1 << 24))) > 40 and warc.member(b"a" * (1 << 24))[-1] == 0
    assert warc.inflated(gzip.compress(b"one") + gzip.compress(b"two") + b"\x1f\x8bbroken") == b"onetwo"


def enc():
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["don't", " a", "  b", "\n", "\t", "é_9", "12 3", "！", " ", " ", "x" * 40, "…", "\x1c", "'s", "🙂"]), max_size=40).map("".join), st.integers(1, 20))
def test_pieces_encode_as_the_whole(text, limit):
    e = bpe.encoding(*enc())
    assert "".join(bpe.pieces(text, limit)) == text
    assert bpe.encode_text(e, text, limit).tolist() == e.encode_ordinary(text)


def test_bpe_round_trip(spark):
    path, pattern = enc()
    d = docs(spark, [*ODD, (30, "x" * 100_000, "s")])
    got = bpe.decode(bpe.encode(d, path, pattern), path, pattern).collect()
    texts = {i: t for i, t, _ in [*ODD, (30, "x" * 100_000, "s")]}
    e = bpe.encoding(path, pattern)
    assert len(got) == len(ODD) + 1
    for r in got:
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
        assert bytes(r.ids) == struct.pack(f"<{r.n_tokens}I", *e.encode_ordinary(texts[r.doc_id] or ""))


def brute_targets(sizes):
    total, target, free = sum(s for s in sizes.values()), {}, {k: 1 + i % 3 for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k or "")))}
    left = total
    while free:
        share = sum(free.values())
        capped = [k for k, w in free.items() if left * w / share >= 3 * sizes[k]]
        if not capped:
            return target | {k: left * w / share for k, w in free.items()}
        for k in capped:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            del free[k]
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, words(r.randint(1, 30), i), r.choice(["a", "a", "a", "a", "b", "c", None, "é"])) for i in range(500)] + [(i, "w " * 5, "tiny") for i in (1000, 1001)] + [(2000, "", "void"), (2001, None, "void"), (None, "one two", "a"), (7, "same id", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets, largest = {}, {}, {}, {}
    source = {(i, len(tokens_of(t))): s for i, t, s in rows}
    for x in got:
        s = source[x.doc_id, x.size]
        sizes[s] = sizes.get(s, 0) + x.size
        taken[s] = taken.get(s, 0) + x.taken
        targets[s], largest[s] = x.target, max(largest.get(s, 0), x.size)
        assert x.taken % max(x.size, 1) == 0 and x.taken <= 3 * x.size
    assert targets == pytest.approx(brute_targets(sizes))
    assert all(abs(taken[s] - targets[s]) <= 2 * largest[s] for s in sizes)
    again = {(x.doc_id, x.size): x.taken for x in mixing.mix(docs(spark, rows[::-1])).collect()}
    assert again == {(x.doc_id, x.size): x.taken for x in got}
    d = docs(spark, rows)
    made = mixing.resample(d)
    assert made.columns == d.columns and made.groupBy().agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(d.limit(0)).count() == 0


TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", ">", "/", "s>", "\n", "é", " ok ", "<\\s>", "[\\\\/INST]"]), max_size=6).map("".join)


def test_chat_round_trip(spark):
    cases = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "x\\n", "<s>"]), TEXT), min_size=1, max_size=4))
    def collect(turns):
        cases.append(turns)

    collect()
    rows = [(c, t, role, text, "f", 1) for c, turns in enumerate(cases) for t, (role, text) in enumerate(turns)]
    rows += [(-5, 1, "assistant", None, "f", 1), (-5, None, None, "first", "f", 1), (None, 1, "user", "hi", "f", 1), (-6, 1, "user", "b", "f", 1), (-6, 1, "user", "a", "f", 1), (-6, 1, "user", "a", "f", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns int").repartition(3)
    done = chat.read_back(chat.format_chats(df))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in done.collect()}
    assert {c: got[c] for c in range(len(cases))} == dict(enumerate(cases))
    assert got[-5] == [("", "first"), ("assistant", "")] and got[None] == [("user", "hi")] and got[-6] == [("user", "a"), ("user", "a"), ("user", "b")]
    by = {r.conv_id: r for r in chat.summary(done).collect()}
    for c, turns in enumerate(cases):
        assert by[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert by[c].loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [lambda d: minhash.cluster(d), lambda d: minhash.representatives(d), lambda d: suffix.dedup(d), lambda d: secrets.summary(secrets.scan(d)), lambda d: pii.pseudonymise(d, "k"), lambda d: bpe.decode(bpe.encode(d, *enc()), *enc())])
def test_empty_tables(spark, run):
    assert run(docs(spark, ODD).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_quality_parts_a_text_once(spark):
    """No word is asked for marks by itself."""
    d = spark.createDataFrame([(1, "well, well *** done"), (2, None), (3, "  "), (4, "one")], "doc_id long, text string")
    judged = quality.judge(d, quality.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert "RLIKE" not in judged._jdf.queryExecution().optimizedPlan().toString().upper()
    assert [(r.doc_id, r.verdict.n_words) for r in judged.orderBy("doc_id").collect()] == [(1, 4), (2, 0), (3, 0), (4, 1)]
