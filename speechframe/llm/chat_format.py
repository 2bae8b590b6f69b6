"""Chat formatting: a finite-state machine over roles, text segments with loss flags, from a declarative template.

DataFrame functions only. A text is escaped so that no control string of the template can stand in it, and can be
read back: a backslash becomes \\b, the first of three hash signs \\h, the angle bracket of a turn's end \\l.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers before and after a turn, the roles that carry loss, and the machine that turns must follow."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepts: tuple[str, ...] = ("assistant",)
    end: str = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, "#(?=##)", r"\\h")
    return F.regexp_replace(text, "<(?=/turn>)", r"\\l")


def unescape(text: Column) -> Column:
    for mark, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def marker(role: Column, t: Template) -> Column:
    """What stands before a turn. A role the template doesn't name is written out, escaped, after an at sign."""
    out = F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for name, shown in t.names.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return F.concat(F.lit("### "), out, F.lit(": "))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, turns (as they came), segments (text, loss), formatted, state, valid.

    turns: conv_id, turn, role, text; other columns are not read. Turns are ordered by (turn, role, text), nulls
    first, which settles ties; repeated rows stay. A null text or role is empty. Conversations that break the turn
    order are formatted too, with valid false and state 'error'. A null conv_id is a conversation like any other.
    """
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])

    def segments(x: Column) -> Column:
        loss = x["role"].isin(*t.loss_roles)
        parts = ((marker(x["role"], t), F.lit(False)), (escape(x["text"]), loss), (F.lit(t.end), F.lit(False)))
        return F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in parts])

    chats = chats.select(
        "conv_id",
        "turns",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(moves, F.concat(s, F.lit("\n"), x["role"])), F.lit("error"))).alias("state"),
    )
    return chats.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("state").isin(*t.accepts).alias("valid"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    t = template or Template()

    def turn(x: Column) -> Column:
        name = F.regexp_extract(x, r"(?s)\A### (.*?): (.*)\z", 1)
        role = unescape(F.substring(name, 2, 1 << 30))
        for plain, shown in t.names.items():
            role = F.when(name == shown, F.lit(plain)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_extract(x, r"(?s)\A### (.*?): (.*)\z", 2)).alias("text"))

    parts = F.split(formatted, r"</turn>\n")
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    own = spark.sql(r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(turns).select("conv_id", read_back(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("loss"), "formatted", "valid")
    joined = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### @' || role || ': ' END AS marker,
    -- each escape makes one character two
    length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '</turn>', '/turn>'))
      + len(list_filter(range(1, length(text) - 1), lambda i: substr(text, i, 3) = '###')) AS escaped,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(marker) + escaped + 8)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, '>' ORDER BY k), '(system>)?user>assistant(>user>assistant)*') AS valid
FROM f GROUP BY conv_id
"""
