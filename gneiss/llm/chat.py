"""Chat formatting, in DataFrame operations only.

A declarative template names the control strings of a turn, the roles whose text bears loss, and the transitions of
a finite-state machine over roles.  A conversation becomes a list of segments with loss flags, their
concatenation, and the state in which the machine ends.  Texts and roles are escaped in each row, before rows of a conversation meet.

Escaping doubles each backslash and puts one behind the ``<`` of each control string; taking one backslash
away before any character undoes it.  Control strings begin with the only ``<`` in them, so an escaped text holds none, also
together with its neighbours.

Defined results: a null text or role is empty; turns are ordered by number (null first), then role and text; repeated rows are turns of their own;
a null conversation id is a conversation of its own; an empty table gives no conversation.
A conversation whose roles the machine refuses is formatted too and marked ``valid`` = false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<turn>"
    body: str = "<text>"
    close: str = "</turn>\n"
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    accept: tuple = ("assistant",)
    #: state: role: next state
    transitions: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})

    def controls(self) -> list[str]:
        return [self.open.strip(), self.body.strip(), self.close.strip()]

    def __post_init__(self):
        for c in self.controls():
            if not c.startswith("<") or c.count("<") > 1 or "\\" in c:
                raise ValueError(f"a control string begins with its only '<' and has no backslash: {c!r}")


def escape(col: Column, template: Template) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit("<\\" + c[1:]))
    return out


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segments, formatted, state, valid) of each conversation; segments: array of (text, loss)."""
    t = template or Template()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("raw"), escape(empty(role_col), t).alias("head"), escape(empty(text_col), t).alias("text"))
    chats = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = lambda x: x["role"].isin(*t.loss_roles)
    seg = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(seg(F.concat(F.lit(t.open), x["head"], F.lit(t.body)), no), seg(x["text"], loss(x)), seg(F.lit(t.close), no))))
    table = F.create_map(*(F.lit(v) for s, to in t.transitions.items() for r, n in to.items() for v in (f"{s}\n{r}", n)))
    step = lambda state, x: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), x["role"])), F.lit("refused"))
    state = F.aggregate("turns", F.lit(t.start), step)
    out = chats.select("conv_id", segments.alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*t.accept).alias("valid"))


def parse(formatted: Column, template: Template | None = None) -> Column:
    """array of (role, text): the turns of a formatted conversation, unescaped."""
    t = template or Template()
    quoted = "".join(f"\\u{ord(c):04x}" for c in t.close)
    pieces = F.filter(F.split(formatted, quoted, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.locate(t.body, p)
        return F.struct(unescape(F.substring(p, F.lit(len(t.open) + 1), at - 1 - len(t.open))).alias("role"), unescape(F.substring(p, at + len(t.body), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text that bears loss, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


PROBE = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = format_chats(rows.unionByName(more))
    read = chats.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars", "valid")


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>') AS e,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>') AS h,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(h) + length(e) + 20) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END AND (NOT last OR role = 'assistant')) AS valid
FROM escaped GROUP BY conv_id
"""
