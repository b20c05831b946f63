"""The pipeline beside a brute-force version of all its stages, over a fixture with odd rows."""

import hashlib
import random

import public_tokenizers
import pytest
from test_training_operators import LONG, base_counts, brute_components, brute_scores, brute_targets, luhn, plain_pseudonym, tokens_of, words

import corpus_pipeline
from siftwork.llm import bpe, mixing, quality
from siftwork.llm.queries import pii_key

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, verdict int, key string"
CARD = "4532015112830366"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(i, words(60 + i % 40, i), r.choice(["a", "a", "a", "b", None, "é"])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "too short", "a"), (103, LONG, "c"), (104, " ".join(w + "***" for w in words(80, 7).split()), "a")]
    rows += [(200 + k, words(61, 1).replace("a", "e", k), "a") for k in range(4)] + [(30, words(90, 30), "a")] * 2 + [(None, words(70, 99), "b")]
    rows += [(300, f"{words(40, 300)} card {CARD} or x@example.org on 2020-01-02", "b"), (301, f"{words(40, 301)} again {CARD}", "c")]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "k") for i, t, s in rows], DOC).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(104, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def brute_pipeline(rows, key):
    good = {i for i in range(0, 60, 2)}
    scores, least = brute_scores([(i, t) for i, t, _ in rows], good)
    rows = [r for r, s in zip(rows, scores) if not base_counts(r[1])[5] and s >= least - quality.MARGIN]
    known = [r for r in rows if r[0] is not None]
    root = brute_components([(i, t) for i, t, _ in known], 80)
    first = {}
    for r in known:
        if root[r[0]] == r[0]:
            first.setdefault(r[0], r)
    rows = [*first.values(), *[r for r in rows if r[0] is None]]
    for kind, v in (("card", CARD), ("email", "x@example.org"), ("date", "2020-01-02")):
        rows = [(i, t.replace(v, plain_pseudonym(kind, v, key)), s) for i, t, s in rows]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(tokens_of(t))
    target, out = brute_targets(sizes), []
    for s, size in sizes.items():
        copies, rest = divmod(target[s], size)
        below = 0
        for _, t, i in sorted((int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16), t, i) for i, t, of in rows if of == s):
            n = len(tokens_of(t))
            more = below + n <= rest or (below <= rest and (rest - below) * 2 > n)
            below += n
            out += [(i, t)] * (int(copies) + more)
    return out


def test_pipeline_equals_brute_force(spark, table):
    at, rows = table
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted(((i, len(ids := enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in brute_pipeline(rows, pii_key(spark))), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()), key=str)
    assert len(got) > 40 and got == want
    assert not any(i in (100, 101, 102, 104) for i, _, _ in got) and luhn(plain_pseudonym("card", CARD, "k"))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
