"""Byte-level BPE with a local rank file: encode whole texts, decode ids to raw bytes.

Null texts count as empty and give no ids. Rows are independent: repeated rows give repeated results, an empty table an
empty result. Extra columns are ignored; the results have the columns named here and no others.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, spread

#: Characters beyond which a text is encoded piece by piece.
PIECE = 1 << 16
#: Between a letter or digit and a space or newline every split pattern of this family begins a new match. (An underscore is
#: punctuation to them, which may take newlines along.)
SAFE = re.compile(r"[^\W_](?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Cut a long text at safe boundaries; a stretch without any stays whole."""
    at = 0
    while len(text) - at > limit and (m := SAFE.search(text, at + limit - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode_text(enc, text: str, limit: int = PIECE) -> np.ndarray:
    found = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, limit) if p]
    return np.concatenate(found).astype("<u4") if found else np.empty(0, "<u4")


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = PIECE) -> DataFrame:
    """(id_col, n_tokens long, ids binary): ids are little-endian unsigned 32-bit integers. The rank file must be at rank_path on every executor."""

    def run(batches):
        enc = encoding(rank_path, pattern)
        for batch in small(batches):
            ids = [encode_text(enc, t or "", limit) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=[id_col, "n_tokens", "ids"])

    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """encode()'s rows with decoded binary: the bytes of the ids one after another, valid UTF-8 or not."""

    def run(batches):
        enc = encoding(rank_path, pattern)
        for batch in small(batches):
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    rows = encoded.select(id_col, "n_tokens", "ids")
    return rows.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
