"""A token classifier's plumbing: its tags as spans of the text, windows for long texts, and what of it counts as evidence. The model is a function of the caller."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema
from siftwork.operators import intervals, session


#: Texts that a task turns into Python's at once.
TEXTS = 32
_LOWER = {c: c + 32 for c in range(65, 91)}


def _behind(text: str, words: list[str], at: int) -> int | None:
    """Where words that begin at a place, with any white space between them, end."""
    for nth, word in enumerate(words):
        end = at
        while nth and end < len(text) and text[end] in " \t\n\x0b\f\r":
            end += 1
        while end > at and not text.startswith(word, end):  # words may begin with white space
            end -= 1
        if not text.startswith(word, end):
            return None
        at = end + len(word)
    return at


def located(text: str, groups: list[list[str]]) -> list[tuple[int, int, int]]:
    """(nth, start, end) of the groups of words that are found, each from the end of the one before, whatever the case of A-Z."""
    text, cursor, out = text.translate(_LOWER), 0, []
    for nth, words in enumerate(groups):
        words = [w.translate(_LOWER) for w in words]
        at = text.find(words[0], cursor)
        while at >= 0 and (end := _behind(text, words, at)) is None:
            at = text.find(words[0], at + 1)
        if at >= 0:
            out.append((nth, at, end))
            cursor = end
    return out


def bio_decode(texts: DataFrame, tokens: DataFrame, key: str, mark: str = "##") -> DataFrame:
    """(key, start, end, type, confidence): texts(key, text) and tokens(key, ord, entity, score, word) in order. A group is a B- token and the I- tokens or
    pieces behind it (those that begin with the mark) of its type; each is looked for, with any white space between its words, from the end of the one before. A text's tokens meet in one row."""
    told = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "entity", F.col("score").cast("double").alias("score"), "word"))).alias("tokens"))
    met = texts.select(key, F.coalesce("text", F.lit("")).alias("text")).join(told, key)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                nths, starts, ends, types, means = [], [], [], [], []
                for nth, (text, told) in enumerate(zip(part.column(1).to_pylist(), part.column(2), strict=True)):
                    flat = told.values
                    groups, kinds, scores = [], [], []
                    for entity, score, word in zip(*[flat.field(n).to_pylist() for n in ("entity", "score", "word")], strict=True):
                        type_, goes_on = entity[2:] if entity[:2] in ("B-", "I-") else entity, word.startswith(mark)
                        piece = word[len(mark) :] if goes_on else word
                        if not groups or kinds[-1] != type_ or not (goes_on or entity.startswith("I-")):
                            groups.append([piece])
                            kinds.append(type_)
                            scores.append([score])
                            continue
                        scores[-1].append(score)
                        if goes_on:
                            groups[-1][-1] += piece
                        else:
                            groups[-1].append(piece)
                    for g, start, end in located(text, groups):
                        nths.append(nth)
                        starts.append(start)
                        ends.append(end)
                        types.append(kinds[g])
                        known = [x for x in scores[g] if x is not None]
                        means.append(sum(known) / len(known) if known else None)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(nths, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(types, pa.string()), pa.array(means, pa.float64())], names=[key, "start", "end", "type", "confidence"])

    return met.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, start int, end int, type string, confidence double")


def chunked(texts: DataFrame, key: str, text_col: str, model: Callable[[DataFrame], DataFrame], threshold: float, size: int = intervals.SIZE, overlap: int = intervals.OVERLAP) -> DataFrame:
    """(key, start, end, type, confidence) of texts in windows of words: model turns windows(key, nth, offset, text) into (key, nth, start, end, type, confidence); weak spans
    go, the others are lifted to the text and merged where windows overlap."""
    windows = intervals.chunk_text(texts.where(F.col(text_col).isNotNull()), key, text_col, size, overlap)
    found = model(windows).where(F.col("confidence") >= threshold).join(windows.select(key, "nth", "offset"), [key, "nth"])
    span = F.struct((F.col("start") + F.col("offset")).cast("int").alias("start"), (F.col("end") + F.col("offset")).cast("int").alias("end"), "type", F.col("confidence").cast("double").alias("confidence"))
    per = found.groupBy(key).agg(F.collect_list(span).alias("spans"))
    return per.select(key, F.explode(intervals.merge_spans(F.col("spans"))).alias("s")).select(key, "s.*")


def generic(surface: Column) -> Column:
    """Is a span made of words of ordinary pages and short ones only?"""
    words = F.filter(F.split(F.lower(surface), "[^a-z0-9]+"), lambda w: w != "")
    return ~F.exists(words, lambda w: (F.length(w) > 2) & ~w.isin(*schema.GENERIC_WORDS, *schema.NER_STOP_WORDS))


def evidence(spans: DataFrame, nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(obs, ord, id, pii_type, confidence, surface) of spans(obs, start, end, type, confidence) over the joined texts of nodes(obs, ord, id, text, owner): people and places
    outside controls, of three characters or more, that aren't words of ordinary pages."""
    ranges = intervals.join_nodes(nodes, "obs", "ord", "text")
    met = intervals.map_spans(spans.select("obs", "start", "end"), ranges, "obs", "ord").join(spans.select("obs", F.col("start").alias("s_start"), "type", "confidence"), ["obs", "s_start"])
    controls = elements.where(F.col("tag").isin("button", "a", "select", "option", "summary", "label", "input", "textarea") | F.col("role").isin("button", "link")).select("obs", F.col("id").alias("owner"))
    free = nodes.join(controls, ["obs", "owner"], "left_anti").select("obs", "ord", "id", "text")
    rows = met.join(free, ["obs", "ord"]).withColumn("surface", F.col("text").substr(F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))).withColumn("pii_type", session.ner_type(F.col("type")))
    kept = F.col("pii_type").isin("PERSON_NAME", "STREET_ADDRESS", "NAME", "ADDRESS") & (F.length(F.trim("surface")) >= 3) & ~generic(F.col("surface"))
    return rows.where(kept).select("obs", "ord", "id", "pii_type", "confidence", "surface")
