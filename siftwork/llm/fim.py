"""Fill-in-middle: lines of a text are parted into prefix, middle and suffix, which change places around three marks.

DuckDB does the work inside mapInArrow: each batch is registered as a table, one statement cuts, draws, joins and hashes, and its
Arrow result goes back; no Python sees a row. Draws come from the SHA-256 of seed and id, so that reruns agree whatever the order.

Null texts count as empty; empty texts, and those that hold a mark, stay as they are (form plain). A null id draws as an empty one.
Rows are independent: repeated rows and ties of cuts (an empty middle) are nothing special, an empty table gives an empty result. Very
long texts are handled whole: a batch holds at most ROWS rows and BYTES of text, or one longer text. DuckDB works in memory only.
Extra columns are ignored; the results have the columns named here and no others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, spread

#: Of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: What a batch holds at most.
ROWS, BYTES = 1024, 8 << 20
CONFIG = {"threads": 1, "temp_directory": "", "preserve_insertion_order": True}

CUT = """
WITH b AS (
  SELECT id, coalesce(text, '') AS text FROM batch
), u AS (
  SELECT id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, sha256(concat($seed, ':', id)) AS h FROM b
), d AS (
  SELECT id, text, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
    CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR h3 % 100 >= $rate THEN 'plain' WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT id, text, n, form, array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle, array_to_string(list_slice(units, high + 1, n), '') AS suffix FROM c
), o AS (
  SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
  FROM p
)
SELECT id, n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, output, sha256(output) AS output_sha256 FROM o
"""

#: The first mark opens, the second stands at k, that of the middle at j.
RESTORE = """
WITH t AS (
  SELECT *, CASE form WHEN 'psm' THEN $p WHEN 'spm' THEN $s END AS first, CASE form WHEN 'psm' THEN $s WHEN 'spm' THEN $p END AS second FROM batch
), k AS (
  SELECT *, strpos(output, second) AS k, strpos(output, $m) AS j, starts_with(output, first) AS opens FROM t
), s AS (
  SELECT *, substr(output, length(first) + 1, k - length(first) - 1) AS a, substr(output, k + length(second), j - k - length(second)) AS b, substr(output, j + length($m)) AS c FROM k
), r AS (
  SELECT *, CASE WHEN form = 'plain' THEN output WHEN opens AND k > length(first) AND j > k THEN CASE form WHEN 'psm' THEN a || c || b ELSE b || c || a END END AS restored FROM s
)
SELECT id, n, form, prefix_chars, middle_chars, output, output_sha256, restored, sha256(restored) AS restored_sha256 FROM r
"""

_CUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
_BACK = f"{_CUT}, restored string, restored_sha256 string"


def _told(marks: tuple[str, str, str]) -> dict:
    p, s, m = marks
    if not all(marks) or any(x[0] in y[1:] for x in marks for y in marks) or any(x != y and (x.startswith(y) or y.startswith(x)) for x in marks for y in marks) or len({*marks}) < 3:
        raise ValueError("three different marks are needed, none the beginning of another, whose first characters stand nowhere else in them")
    return {"p": p, "s": s, "m": m}


def _by_statement(rows: DataFrame, statement: str, told: dict, column: str, schema: str, names: list[str]) -> DataFrame:
    """What the statement makes of each batch, its first column named id."""
    told = {k: v for k, v in told.items() if f"${k}" in statement}

    def run(batches):
        import duckdb

        with duckdb.connect(config=CONFIG) as con:
            for batch in bounded(batches, column, ROWS, BYTES):
                con.register("batch", pa.Table.from_batches([batch.rename_columns(["id", *batch.schema.names[1:]])]))
                for got in con.sql(statement, params=told).to_arrow_reader(ROWS):
                    yield got.rename_columns(names)
                con.unregister("batch")

    return rows.mapInArrow(run, schema)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output, output_sha256): rate per cent of the documents are parted, spm per cent of those
    with the suffix first."""
    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    names = [id_col, *(x.split()[0] for x in _CUT.split(", "))]
    return _by_statement(rows, CUT, _told(marks) | {"seed": seed, "rate": rate, "spm": spm}, "text", f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_CUT}", names)


def restore(cut: DataFrame, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id") -> DataFrame:
    """transform()'s rows with restored and restored_sha256: the text read back from output and form, null where output isn't of its form."""
    names = [id_col, *(x.split()[0] for x in _BACK.split(", "))]
    rows = cut.select(*names[:-2])
    return _by_statement(rows, RESTORE, _told(marks), "output", f"`{id_col}` {cut.schema[id_col].dataType.simpleString()}, {_BACK}", names)


#: Cuts by counting line ends instead of matching lines.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), e AS (
  SELECT *, string_split(t, chr(10)) AS parts, length(t) - length(replace(t, chr(10), '')) AS ends FROM d
), f AS (
  SELECT *, ends + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS n FROM e
), g AS (
  SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS z, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS w FROM f
), p AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR z >= 100 THEN 'plain' WHEN w < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), q AS (
  SELECT *, CASE WHEN a = 0 THEN 0 WHEN a > ends THEN length(t) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS u,
    CASE WHEN b = 0 THEN 0 WHEN b > ends THEN length(t) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS v FROM p
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN u END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN v - u END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, u) || '<S>' || substr(t, v + 1) || '<M>' || substr(t, u + 1, v - u) ELSE '<S>' || substr(t, v + 1) || '<P>' || substr(t, 1, u) || '<M>' || substr(t, u + 1, v - u) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""
