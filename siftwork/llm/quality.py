"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The verdict compares two multinomials over hashed uni- and bigrams: one of a trusted target (documents labelled good), one of
the raw corpus (all documents). A document's score is the mean of log p(target) - log p(raw) over its n-grams, so length
does not matter. A document of n-grams that no other has scores -log(1 + T / R), with T and R n-grams in the target and the
corpus; every document that scores no more than MARGIN below that passes. N-grams are over tokens: words cut between
punctuation and the rest, so that "word***" gives "word" and "***".

The raw counts cover all n-grams of all documents. The target takes at most TRUSTED labelled documents, those with the
smallest hash of their id; that many ids are broadcast. The model has BUCKETS numbers at any size of input.

Null and empty texts have zero counts, score 0 and fail. Rows are independent: repeated rows give repeated results (and
count repeatedly in the corpus). Without labels the score is 0 for all. Extra columns of docs and labels are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, spread

BUCKETS = 1 << 16
TRUSTED = 20_000
#: Below the score of a document all of whose n-grams occur in it alone, once.
MARGIN = 0.1
WINDOW = 8

_SPACES = r"[\x20\x09-\x0D]+"
#: Punctuation, which is set apart from what it touches.
_MARKS = r"([!-/:-@\[-`{-~]+)"


def _split(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACES, -1))


def words_of(text: Column) -> Column:
    """array<string>: runs of characters other than ASCII white space."""
    return _split(text)


def all_token_hashes(text: Column) -> Column:
    """array<bigint>: hashes of a text's tokens, in order."""
    return F.transform(_split(F.regexp_replace(text, _MARKS, " $1 ")), lambda t: F.xxhash64(t))


def _bucket(hash_: Column) -> Column:
    return hash_.bitwiseAND(BUCKETS - 1)


def _bigrams(h: Column) -> Column:
    """Hashes of neighbouring hashes of an array that is bound."""
    return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def buckets_of(hashes: Column) -> Column:
    """array<bigint>: the hash buckets of the uni- and bigrams of tokens."""
    return let(hashes, lambda h: F.concat(F.transform(h, _bucket), F.transform(_bigrams(h), _bucket)))


def mean_of(hashes: Column, llr: Column) -> Column:
    """The mean of llr over buckets_of(), added up in the same order without writing the buckets down; 0 without tokens."""

    def mean(h: Column) -> Column:
        add = lambda s, x: s + F.get(llr, _bucket(x).cast("int"))
        total = F.aggregate(_bigrams(h), F.aggregate(h, F.lit(0.0), add), add)
        return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(0.0)

    return let(hashes, mean)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur at least twice in the text. Windows are compared by 64-bit hashes."""

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda t, i: F.coalesce(F.get(s, i - 1)["x"] == t["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == t["x"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda t: t["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), F.aggregate(let(pairs, twins), start, step, lambda a: a["n"])).otherwise(0)

    def runs(h: Column) -> Column:
        """Hashes of the runs of four."""
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 3, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3)))

    def windows(four: Column) -> Column:
        # a window of eight found twice holds runs of four found twice; most texts have none
        eight = F.transform(F.slice(four, F.lit(1), F.greatest(F.size(four) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(four, i + 4)))
        return F.when(F.size(F.array_distinct(four)) < F.size(four), let(eight, covered)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(runs(h), windows)).cast("long")


def base_counts(text: Column, words: Column) -> list[Column]:
    """Fields of the verdict that don't need a model; words must be bound."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return [
        F.size(words).cast("long").alias("n_words"),
        repeated_words(words).alias("n_repeat_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: int = TRUSTED) -> DataFrame:
    """One row with least double, the score of a document of new n-grams, and llr array<double>: the log-likelihood ratio of each bucket, with one added to every count of the target."""
    good = labels.groupBy(F.col("doc_id").alias("__good")).agg(F.min("quality").alias("q")).where("q = 1 AND __good IS NOT NULL")
    good = good.orderBy(F.xxhash64("__good"), "__good").limit(trusted).select("__good")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.join(F.broadcast(good), F.col("__id") == F.col("__good"), "left")
    grams = rows.select(F.col("__good").isNotNull().cast("long").alias("t"), F.explode(buckets_of(all_token_hashes(F.col("__text")))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"))
    sides = every.join(counts, "b", "left").agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("m"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # the raw side gets as many more pseudo-counts as it has counts: equal shares then have ratio 1 at any size
    more = F.coalesce(F.col("raw") / F.col("target"), F.lit(1.0))
    ratio = F.transform("m", lambda x: F.log((x["target"] + 1) / (F.coalesce("target", F.lit(0)) + BUCKETS)) - F.log((x["raw"] + more) / (F.coalesce("raw", F.lit(0)) + more * BUCKETS)))
    least = -F.log(1 + F.coalesce(F.col("target") / F.col("raw"), F.lit(0.0)))
    return sides.select(least.alias("least"), F.when(F.coalesce("target", F.lit(0)) > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("llr"))


def judge(docs: DataFrame, fitted: DataFrame, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with verdict struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept>, in place of any column of that name."""
    llr = F.col("__llr")  # of BUCKETS numbers, a scalar subquery's result
    text = F.col(text_col)
    # parting the whole text at marks once takes less than asking each word for them
    score = mean_of(all_token_hashes(F.coalesce(text, F.lit(""))), llr)
    parts = let(words_of(text), lambda w: F.struct(*base_counts(text, w), score.alias("score")))

    def verdict(v: Column) -> Column:
        n, r = v["n_words"], v["n_repeat_words"]
        failed = (n < 20) | (r * 100 > n * 30)
        return F.struct(n.alias("n_words"), v["word_chars"].alias("word_chars"), v["n_symbols"].alias("n_symbols"), v["n_dup_lines"].alias("n_dup_lines"), r.alias("n_repeat_words"), v["score"].alias("score"), failed.alias("base_failed"), (~failed & (v["score"] >= F.col("__least") - margin)).alias("kept"))

    rows = spread(docs).withColumn("__llr", fitted.select("llr").scalar()).withColumn("__least", fitted.select("least").scalar())
    return rows.withColumn("verdict", let(parts, verdict)).drop("__llr", "__least")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """model() as a table of one row in the shared folder, so that it is computed once."""
    return cut(model(spread(docs), labels, id_col, text_col), "quality-model")
