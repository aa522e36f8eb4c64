"""Operator 7 [native]: chat formatting by event-sourced reconstruction, in DataFrame operations only.

An event log has conv_id, seq, msg (the message it concerns), kind, role and text. Kinds: `delta` appends to
the message, `edit` and `regenerate` replace all that it had before, `delete` takes the message away until a
later edit or regeneration. The log is dealt by conversation, sorted by seq and folded into final messages,
which are rendered in the order of their first events.

Template: `### {role}: {text}</turn>` and a line end for each turn. Inside roles and texts `\\` becomes `\\b`,
`#` becomes `\\h`, `<` becomes `\\l` and, in roles, `:` becomes `\\c`, so control strings can't occur in them and
the output can be parsed again. The loss mask holds [start, end) code points of each assistant text.

Defined cases: a null text or role is empty; rows that share conv_id and turn stay separate turns, by role and
text; a null turn comes first; rows with a null conv_id form one conversation; an empty table gives none but
those added; other columns are not read. A conversation's output is one string, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def escape(text: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *(((":", "\\c"),) if role else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, msg, first_seq, role, text of the messages that are left at the end of the log."""
    own = Window.partitionBy("conv_id", "msg")
    reset = F.col("kind").isin("edit", "regenerate", "delete")
    dealt = events.select("conv_id", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    kept = dealt.withColumn("first_seq", F.min("seq").over(own)).withColumn("base", F.max(F.when(reset, F.col("seq"))).over(own))
    kept = kept.filter("base is null or seq >= base")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind") == "delete", "").otherwise(F.col("text")).alias("text")))), lambda e: e["text"]))
    folded = kept.groupBy("conv_id", "msg").agg(F.min("first_seq").alias("first_seq"), F.max_by("role", "seq").alias("role"), text.alias("text"), F.min_by("kind", "seq").alias("began"))
    return folded.filter("began <> 'delete'").drop("began")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the messages of each conversation in order, and the assistant's spans."""
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    body = escape(F.col("text"))
    turn = F.struct("first_seq", "msg", F.concat(head, body, F.lit("</turn>\n")).alias("s"), F.length(head).alias("a"), F.length(body).alias("n"), (F.col("role") == "assistant").alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ends = F.expr("aggregate(turns, struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as spans), (x, t) -> struct(x.at + length(t.s) as at, if(t.loss, concat(x.spans, array(struct(x.at + t.a as start, x.at + t.a + t.n as end))), x.spans) as spans), x -> x.spans)")
    return turns.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["s"])).alias("formatted"), ends.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and the texts under the loss mask, from the rendered strings alone."""
    raw = F.expr("slice(split(formatted, '</turn>\\n', -1), 1, greatest(size(split(formatted, '</turn>\\n', -1)) - 1, 0))")
    turns = F.transform(raw, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(5)), ": ", 1)).alias("role"), unescape(F.substr(t, F.instr(t, F.lit(": ")) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rendered.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log of stored turns: each row is one message, streamed as one delta."""
    order = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy(order))
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("seq", seq).select("conv_id", "seq", F.col("seq").alias("msg"), F.lit("delta").alias("kind"), "role", "text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(render(fold_events(log_of(rows.unionByName(extra)))))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *,
  replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') as et,
  replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') as er from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length(er) + length(et) + 14) as bigint) as formatted_chars
from e group by conv_id
"""
