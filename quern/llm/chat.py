"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template says how a turn is marked, which roles carry loss, which strings are control strings and which role may
follow which. Inside roles and texts the escape character is doubled and every control string is broken by an escape
after its first character, so no control string survives in user text and unescaping restores the text exactly.

Defined cases: a null text or role is the empty string; a null turn sorts first; rows of one turn are ordered by role,
then text; repeated rows are all kept; an empty table gives no rows; an unknown role or a wrong order leaves the
conversation formatted with valid = false; a very long text is one string like any other; columns other than the four named are ignored. A conversation is one string
and so one row: its turns are gathered on one task, as the format itself demands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESC = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """start role newline text end newline, for each turn; transitions: state -> role -> next state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict = field(default_factory=lambda: {"begin": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)


def escape(text: Column, template: ChatTemplate) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), f"({heads})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _accepts(roles: Column, template: ChatTemplate) -> Column:
    """Runs the machine over the roles; '' is the state of refusal."""
    table = F.create_map(*[F.lit(x) for s, row in template.transitions.items() for r, t in row.items() for x in (f"{s}\0{r}", t)])
    final = F.aggregate(roles, F.lit("begin"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\0"), role)), F.lit("")))
    return final.isin(*template.accepting)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted, loss_spans array<struct<start, length>>.

    Spans count code points of formatted from 0 and cover exactly the escaped texts of the loss roles.
    """
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    got = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        # A newline ends the role, so one inside a role is escaped as well.
        role = F.replace(escape(t["role"], template), F.lit("\n"), F.lit(ESC + "\n"))
        loss = t["role"].isin(*template.loss_roles)
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(part(F.concat(F.lit(template.start), role, F.lit("\n")), F.lit(False)), part(escape(t["text"], template), loss), part(F.lit(template.end + "\n"), F.lit(False)))

    got = got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _accepts(F.transform("turns", lambda t: t["role"]), template).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s["text"]).cast("long")
        span = F.struct(acc["at"].alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return got.select("*", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), F.aggregate("segments", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parse_chats(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """array<struct<role, text>> from a formatted string: the inverse of the template."""
    marks = F.split(formatted, re.escape(template.start))
    role_line = r"^([^\n\\]*+(?:\\[\s\S][^\n\\]*+)*+)\n"

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, role_line, 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(template.end) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(marks, F.lit(2), F.greatest(F.size(marks) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(probe).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(turns)
    back = out.withColumn("parsed", parse_chats(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.concat_ws("", F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op6_sql() -> str:
    t = ChatTemplate()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda x, c: f"(length({x}) - length(replace({x}, {quote(c)}, ''))) // {len(c)}"
    extra = lambda x: " + ".join(count(x, c) for c in (ESC, *t.controls))
    marks = len(t.start) + len(t.end) + 2
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  regexp_full_match(string_agg(role || ';', '' ORDER BY turn, role, text), '(system;)?(user;assistant;)+') AS valid,
  sum(length(role) + length(text) + {marks} + {extra('text')}) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, valid FROM g"""
