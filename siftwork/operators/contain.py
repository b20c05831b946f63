"""Which texts hold which secrets: exact containment by seeds, shared n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from siftwork.functions.text import grams

SEED = 6
#: Patterns and secrets' runs, and characters of them, that are sent to all tasks at most; beyond, both sides are shuffled.
BROADCAST, CHARS = 200_000, 32_000_000
#: Texts that a task looks through at once, and their characters (or one longer text).
TEXTS, AT_ONCE = 512, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _join(left: DataFrame, right: DataFrame, on: str, within: str | None) -> DataFrame:
    """An equi-join on a column and, where null is a value like others, a second one."""
    if not within:
        return left.join(right, on)
    a, b = left.alias("a"), right.alias("b")
    both = (F.col(f"a.{on}") == F.col(f"b.{on}")) & F.col(f"a.{within}").eqNullSafe(F.col(f"b.{within}"))
    return a.join(b, both).select("a.*", *[f"b.{c}" for c in right.columns if c not in (on, within)])


def _seeds(patterns: DataFrame, pattern_col: str, part: list[str], least: int, most: int | None = None) -> tuple[DataFrame | None, int]:
    """(within, pattern, seed) of the patterns from `least` characters on, under `most`, and how many there are; the seed is a hash of the first `least` characters. They are sent to all tasks where they are few enough."""
    n = F.length("pattern")
    found = patterns.select(*part, F.col(pattern_col).alias("pattern")).where(n >= least if most is None else (n >= least) & (n < most)).distinct().withColumn("seed", F.xxhash64(F.substring("pattern", 1, least)))
    count = found.count()
    return F.broadcast(found) if count <= BROADCAST else found, count


def _met(texts: DataFrame, seeds: DataFrame, key: str, text_col: str, within: str | None, seed: int) -> DataFrame:
    """(key, within, text, pattern), each once, of texts that hold a pattern.

    A pattern can only be where its first `seed` characters are: hashes of the runs of as many characters of each text, each once, meet those of the seeds, and what meets is compared itself. Only hashes of the
    texts travel with their many runs, and not even these where the seeds are sent to the tasks; equal texts are gone through once.
    """
    part = [within] if within else []
    rows = texts.select(F.col(key), *part, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__h"))
    runs = rows.select("__h", *part, F.explode(F.array_distinct(F.transform(grams(F.col("text"), seed), lambda g: F.xxhash64(g)))).alias("seed"))
    meet = _join(runs, seeds, "seed", within).select("__h", *part, "pattern").distinct()
    return _join(rows, meet, "__h", within).where(F.contains("text", "pattern")).select(key, *part, "text", "pattern").distinct()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters."""
    out = np.zeros(max(len(points) - n + 1, 0), np.uint64)
    for k in range(n):
        out *= _ODD
        out += points[k : k + len(out)]
    out *= _ODD
    return out ^ (out >> np.uint64(29))


class _Runs:
    """Runs of n characters that are looked for in many texts: a table of bits tells most others apart, their sorted hashes the rest."""

    def __init__(self, runs: list[str], n: int):
        self.n = n
        hashes = _hashes(_points("".join(runs)), n)[::n] if runs else np.zeros(0, np.uint64)
        self.sorted, self.nth = np.unique(hashes, return_inverse=True)
        self.bits = np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.sorted >> self.bits).astype(np.int64)] = True

    def places(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in all texts, number of the hash) of the runs that are found inside a text."""
        hashes = _hashes(points, self.n)
        at = np.flatnonzero(self.maybe[(hashes >> self.bits).astype(np.int64)])
        nth = np.searchsorted(self.sorted, hashes[at])
        good = nth < len(self.sorted)
        good[good] = self.sorted[nth[good]] == hashes[at[good]]
        at, nth = at[good], nth[good]
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.n <= ends[text]
        return text[inside], at[inside], nth[inside]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, texts, their characters one behind another, where each begins and ends): parts of a batch of a bounded size."""
    at = 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    while at < batch.num_rows:
        n = max(1, min(TEXTS, int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS]), AT_ONCE))))
        part = batch.slice(at, n)
        texts = [t or "" for t in part.column(column).to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        yield part, texts, _points("".join(texts)), ends - [len(t) for t in texts], ends
        at += n


def _few(rows: DataFrame, text_col: str) -> list[tuple] | None:
    """The rows, where they are few and short enough to be sent to all tasks."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    if size.n > BROADCAST or size.chars > CHARS:
        return None
    return list(map(tuple, zip(*[c.to_pylist() for c in rows.toArrow().columns], strict=True)))


def _holding_few(texts: DataFrame, patterns: list[tuple], key: str, text_col: str, within: str | None, least: int, seed: int) -> DataFrame:
    """holding() with all patterns sent to the tasks, where each text is gone through once and nothing but what is found leaves: patterns are met by the hash of their first characters, then compared at the place."""
    part = [within] if within else []

    def run(batches):
        sides = []
        for n, lot in ((seed, [p for p in patterns if len(p[-1]) >= seed]), (least, [p for p in patterns if least <= len(p[-1]) < seed])):
            if lot:
                runs, by = _Runs([p[-1][:n] for p in lot], n), {}
                for h, p in zip(runs.nth.tolist(), lot, strict=True):
                    by.setdefault((h, p[0]) if within else h, []).append(p[-1])
                sides.append((runs, by))
        for batch in batches:
            for rows, every, points, begins, ends in _slices(batch, 1):
                groups = rows.column(2).to_pylist() if within else None
                found = {}
                for runs, by in sides:
                    for nth, at, h in zip(*[x.tolist() for x in runs.places(points, begins, ends)], strict=True):
                        place = at - int(begins[nth])
                        for pattern in by.get((h, groups[nth]) if within else h, ()):
                            if (nth, pattern) not in found and every[nth].startswith(pattern, place):
                                found[nth, pattern] = None
                take = pa.array([n for n, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), *[rows.column(2).take(take) for _ in part], pa.array([p for _, p in found], pa.string())], names=[key, *part, "pattern"])

    rows = texts.select(F.col(key), F.col(text_col).alias("__text"), *part)
    fields = [StructField(c, rows.schema[c].dataType) for c in (key, *part)]
    return rows.mapInArrow(run, StructType([*fields, StructField("pattern", rows.schema["__text"].dataType)])).distinct()


def search(texts: DataFrame, patterns: DataFrame, key: str = "id", text_col: str = "text", pattern_col: str = "pattern", within: str | None = None, seed: int = SEED) -> DataFrame:
    """(key, pattern, start, end): all places of all patterns of `seed` characters or more, overlapping ones too. Exact and complete at any number of patterns.
    within: a column of both tables, and then of the result; patterns are looked for in texts with the same value (nulls are the same) only.
    """
    part = [within] if within else []
    found = _met(texts, _seeds(patterns, pattern_col, part, seed)[0], key, text_col, within, seed)
    # lengths of what stands before each place give the offsets
    ahead = F.concat(F.lit("(?s)(?=\\Q"), F.replace("pattern", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    cuts = found.withColumn("cuts", F.split("text", ahead, -1)).withColumn("begins", F.startswith("text", "pattern"))
    upto = lambda i: F.aggregate(F.slice("cuts", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
    # a split drops the empty piece in front of a match at the start
    inner = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), upto)
    starts = F.concat(F.when(F.col("begins"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(F.size("cuts") > 1, inner).otherwise(F.array().cast("array<int>")))
    return cuts.select(key, *part, "pattern", F.explode(F.array_distinct(starts)).alias("start")).withColumn("end", F.col("start") + F.length("pattern"))


def holding(texts: DataFrame, patterns: DataFrame, key: str = "id", text_col: str = "text", pattern_col: str = "pattern", within: str | None = None, least: int = 3, seed: int = SEED) -> DataFrame:
    """(key, pattern), each once, of texts that hold a pattern of `least` characters or more, without places. Patterns under `seed` characters, if there are any, are looked for by their first `least`."""
    part = [within] if within else []
    few = _few(patterns.select(*part, F.col(pattern_col).alias("pattern")).where(F.length("pattern") >= min(least, seed)).distinct(), "pattern")
    if few is not None:
        return _holding_few(texts, few, key, text_col, within, least, seed)
    long, n_long = _seeds(patterns, pattern_col, part, seed)
    found = _met(texts, long, key, text_col, within, seed)
    if least < seed:
        short, n_short = _seeds(patterns, pattern_col, part, least, seed)
        if n_short:
            few = _met(texts, short, key, text_col, within, least)
            found = found.unionByName(few) if n_long else few
    return found.select(key, *part, "pattern").distinct()


def shared_grams(texts: DataFrame, secrets: DataFrame, key: str = "id", text_col: str = "text", secret_col: str = "secret", n: int = 8) -> DataFrame:
    """(key, secret, n_shared, n_grams): pairs that share runs of n characters, and how many different ones. Secrets under n characters take no part.

    Runs meet by 64-bit hashes; where the secrets are few enough they are sent to the tasks, which go through each text once, so that only pairs travel, a secret by its number.
    """
    few = _few(secrets.select(F.col(secret_col).alias("secret")).where(F.length("secret") >= n), "secret")
    if few is not None and sum(len(s) - n + 1 for (s,) in few) <= BROADCAST * 10:
        return _shared_few(texts, [s for (s,) in few], key, text_col, n)
    left = texts.select(F.col(key), F.explode(F.array_distinct(F.transform(grams(F.col(text_col), n), lambda g: F.xxhash64(g)))).alias("g"))
    distinct = F.array_distinct(grams(F.col(secret_col), n))
    right = secrets.select(F.col(secret_col).alias("secret"), F.size(distinct).cast("long").alias("n_grams"), F.explode(F.transform(distinct, lambda g: F.xxhash64(g))).alias("g"))
    return left.join(right, "g").groupBy(key, "secret", "n_grams").agg(F.count("*").alias("n_shared"))


def _shared_few(texts: DataFrame, secrets: list[str], key: str, text_col: str, n: int) -> DataFrame:
    counts: dict[str, int] = {}  # a secret that stands several times counts as often
    for s in secrets:
        counts[s] = counts.get(s, 0) + 1
    names = list(counts)
    grams_of = [sorted({s[i : i + n] for i in range(len(s) - n + 1)}) for s in names]

    def run(batches):
        runs = _Runs([g for gs in grams_of for g in gs], n)
        owner = np.repeat(np.arange(len(names)), [len(gs) for gs in grams_of])
        # secrets of a hash: those from first[h] on, as many as it has
        by_hash = np.argsort(runs.nth, kind="stable")
        many = np.bincount(runs.nth, minlength=len(runs.sorted))
        first = np.cumsum(many) - many
        for batch in batches:
            for rows, _, points, begins, ends in _slices(batch, 1):
                text, _, h = runs.places(points, begins, ends)
                pair = np.unique(text * (len(runs.sorted) + 1) + h)
                text, h = pair // (len(runs.sorted) + 1), pair % (len(runs.sorted) + 1)
                total = int(many[h].sum())
                which = owner[by_hash[np.repeat(first[h] - np.cumsum(many[h]) + many[h], many[h]) + np.arange(total)]]
                met, shared = np.unique(np.repeat(text, many[h]) * (len(names) + 1) + which, return_counts=True)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(met // (len(names) + 1))), pa.array(met % (len(names) + 1), pa.int32()), pa.array(shared, pa.int64())], names=[key, "__nth", "n_shared"])

    rows = texts.select(F.col(key), F.col(text_col).alias("__text"))
    pairs = rows.mapInArrow(run, StructType([StructField(key, rows.schema[key].dataType), StructField("__nth", IntegerType()), StructField("n_shared", LongType())]))
    named = texts.sparkSession.createDataFrame(pa.table({"__nth": pa.array(range(len(names)), pa.int32()), "secret": pa.array(names, pa.string()), "n_grams": pa.array([len(g) for g in grams_of], pa.int64()), "__times": pa.array(list(counts.values()), pa.int64())}))
    summed = pairs.groupBy(key, "__nth").agg(F.sum("n_shared").alias("n_shared"))
    return summed.join(F.broadcast(named), "__nth").select(key, "secret", "n_grams", (F.col("n_shared") * F.col("__times")).alias("n_shared"))
