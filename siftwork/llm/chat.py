"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar: a user's turn is [INST]text[/INST], an assistant's <s>text</s>, any other <<SYS>>role, newline, text<</SYS>>; turns
follow one another with nothing between. Inside a text a control string, whose first character may already be followed by
backslashes, gets one more backslash there; the parser takes one away. A conversation is first rendered as it is; only if the
parser does not give back the very turns is it rendered with its conflicting content escaped, and compared again.

Turns are ordered by turn, then role, then text, so that ties and repeated rows have one order; null roles and texts count as
empty, null turns come first, rows with a null conversation are one conversation. An empty table gives an empty result. Extra
columns are ignored. One conversation is one training example and is held whole in a row, as its digest asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First character, backslashes so far, the rest of a control string.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>)"
BARE = r"(<|\[)(/?s>|/?INST\]|</?SYS>>)"
#: One rendered turn; the shortest body that a closing string ends.
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """The reverse of escape_role: pairs of a backslash and a character, from the left."""
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped: bool) -> Column:
    text = (lambda t: escape(t["text"])) if escaped else (lambda t: t["text"])
    role = (lambda t: escape_role(t["role"])) if escaped else (lambda t: t["role"])
    one = lambda t: F.when(t["role"] == "user", F.concat(F.lit("[INST]"), text(t), F.lit("[/INST]"))).when(t["role"] == "assistant", F.concat(F.lit("<s>"), text(t), F.lit("</s>"))).otherwise(F.concat(F.lit("<<SYS>>"), role(t), F.lit("\n"), text(t), F.lit("<</SYS>>")))
    return F.array_join(F.transform(turns, one), "")


def parse(text: Column) -> Column:
    """array<struct<role, text>> of a rendered text. A body with a control string left in it is no turn of the grammar: its text is null."""
    body = lambda s, left, right: s.substr(F.lit(left + 1), F.length(s) - left - right)
    checked = lambda s: F.when(~s.rlike(BARE), s)

    def one(s: Column) -> Column:
        other = body(s, 7, 8)
        cut = F.instr(other, "\n")
        return (
            F.when(s.startswith("[INST]"), F.struct(F.lit("user").alias("role"), unescape(checked(body(s, 6, 7))).alias("text")))
            .when(s.startswith("<s>"), F.struct(F.lit("assistant").alias("role"), unescape(checked(body(s, 3, 4))).alias("text")))
            .otherwise(F.struct(unescape_role(checked(F.substring_index(other, "\n", 1))).alias("role"), unescape(checked(other.substr(cut + 1, F.length(other)))).alias("text")))
        )

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), one)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, formatted string, escaped boolean): the training text of each conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chats = rows.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")))).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    chats = chats.select(conv_col, turns.alias("turns"))
    chats = chats.select("*", render(F.col("turns"), False).alias("plain"))
    chats = chats.select("*", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)).alias("same"))
    chats = chats.select(conv_col, "turns", (~F.col("same")).alias("escaped"), F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), True)).alias("formatted"))
    wrong = F.raise_error(F.lit("a conversation does not come back from its rendered text"))
    return chats.select(conv_col, "escaped", F.when(~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns")), F.col("formatted")).otherwise(wrong).alias("formatted"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turns, loss string, formatted): all of it parsed out of the rendered text; loss is the text under the loss mask."""
    out = formatted.select(conv_col, "formatted", parse(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select(conv_col, "turns", loss.alias("loss"), "formatted")


def summary(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), x AS (
  SELECT *, bool_or(regexp_matches(text, '(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)')) OVER (PARTITION BY conv_id) AS escaped FROM c
), y AS (
  SELECT *, CASE WHEN escaped THEN regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') ELSE text END AS shown FROM x
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END)::BIGINT AS formatted_chars
FROM y GROUP BY conv_id
"""
