"""Chat formatting by schema fingerprinting, in DataFrame expressions only.

A layout is a set of nested field paths. The hash of the sorted paths that are filled in a record selects a declarative
mapping, which turns prompt, instruction and message records into canonical turns. Turns are rendered with a template
whose control strings are escaped inside texts, reversibly, and a loss mask lists the spans of assistant texts.

Nulls: a null role or text counts as empty, a record whose filled paths match no mapping gets null turns. Empty tables
give empty results, columns outside the known paths are ignored, repeated rows are kept as turns of their own.
A text is escaped whole, whatever its length; a conversation's turns and its output are one row. Turns of one number, ties,
stand in the order of their role and text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Openers of the control strings of common templates, as a pattern: first character, any escapes, the rest.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """fields: the paths that a record of this layout fills. turns: (role, path) pairs, or the path of a message array with the names of its role and text fields, or (row) the paths of the role and the text of a record that is one turn, whose role is kept as it is."""

    name: str
    fields: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None

    @property
    def key(self) -> str:
        return fingerprint(self.fields)


#: Common public layouts and the role names they use.
LAYOUTS = (
    Mapping("messages", ("messages.content", "messages.role"), messages=("messages", "role", "content")),
    Mapping("dialogue", ("conversations.from", "conversations.value"), messages=("conversations", "from", "value")),
    Mapping("completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_completion", ("completion", "prompt", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_question", ("answer", "question", "system"), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Mapping("system_instruction", ("instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("system_instruction_input", ("input", "instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: A record that is one turn. A null field isn't filled, so the layout has a fingerprint for each set of filled fields.
TURN_ROWS = tuple(Mapping("turn", fields, row=("role", "text")) for fields in (("role", "text"), ("role",), ("text",), ()))
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Leaf paths of a schema; arrays of structs count as their fields."""
    out = {}
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            out |= field_paths(kind, f"{prefix}{f.name}.")
        else:
            out[prefix + f.name] = f.dataType
    return out


def row_fingerprint(df: DataFrame, mappings=LAYOUTS) -> Column:
    """The hash of the sorted known paths that the record fills."""
    known, have = {p for m in mappings for p in m.fields}, field_paths(df.schema)
    filled = [F.when(F.col(p).isNotNull(), F.lit(p)) for p in sorted(known & have.keys())]
    return F.sha2(F.concat_ws("\n", *filled), 256) if filled else F.lit(fingerprint(()))


def canonical_turns(df: DataFrame, mappings=LAYOUTS, roles=ROLES) -> DataFrame:
    """df with `layout` and `turns`, an array of (role, text)."""
    have = field_paths(df.schema)
    usable = [m for m in mappings if set(m.fields) <= have.keys()]
    names = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])

    def turns(m: Mapping) -> Column:
        if m.messages:
            path, role, text = m.messages
            return F.transform(F.col(path), lambda x: F.struct(F.coalesce(names[x[role].cast("string")], x[role].cast("string"), F.lit("")).alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text")))
        if m.row:
            return F.array(F.struct(*[F.coalesce(F.col(p).cast("string"), F.lit("")).alias(n) for n, p in zip(("role", "text"), m.row, strict=True)]))
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("text")) for r, p in m.turns])

    key = row_fingerprint(df, mappings)
    layout, picked = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for m in usable:
        layout, picked = F.when(key == m.key, F.lit(m.name)).otherwise(layout), F.when(key == m.key, turns(m)).otherwise(picked)
    return df.withColumns({"layout": layout, "turns": picked})


def escape(text: Column) -> Column:
    """One backslash more behind the first character of every control string, so that none is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _read_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(rows: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its key, `formatted`, and `loss_spans` (start and length in code points).

    rows has a row per turn; equal turn numbers are ordered by role, then text. A conversation is one output string, so
    its turns meet in one task by definition; offsets are running sums, linear in the number of turns.
    """
    clean = rows.select(F.col(conversation).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_x"))
    head = F.concat(F.lit(START), _role(F.col("_r")), F.lit("\n"))
    parts = clean.select("_c", "_t", "_r", "_x", head.alias("_head"), escape(F.col("_x")).alias("_body"))
    piece = F.concat("_head", "_body", F.lit(END + "\n"))
    order = Window.partitionBy("_c").orderBy("_t", "_r", "_x")
    placed = (
        parts.withColumns({"_piece": piece, "_n": F.row_number().over(order)})
        .withColumn("_end", F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.length("_piece") + F.length("_head"))
    )
    span = F.when(F.col("_r") == loss_role, F.struct(F.col("_start").alias("start"), F.length("_body").cast("long").alias("length")))
    whole = placed.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_n", "_piece", span.alias("span")))).alias("all"))
    return whole.select(
        F.col("_c").alias(conversation),
        F.array_join(F.transform("all", lambda x: x["_piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(_read_role(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substr(body(p), F.locate("\n", body(p)) + 1)).alias("text")),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    from shelfmark.llm.common import table

    told = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(told))
    # a record without a mapping has null turns: it stays as one empty turn, so that no row is lost
    turns = canonical_turns(rows, TURN_ROWS).select("conv_id", "turn", F.explode_outer("turns").alias("own")).select("conv_id", "turn", "own.role", "own.text")
    done = format_turns(turns, "conv_id", "turn").withColumns({"turns": read_back(F.col("formatted")), "masked": masked_text(F.col("formatted"), F.col("loss_spans"))})
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
