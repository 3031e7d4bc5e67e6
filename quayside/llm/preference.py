"""Preference pairs of conversations: one prompt, two completions, and what of them is trained on.

The turns that chosen and rejected have in common at their start are rendered once, as the prompt; what follows on either
side is its completion. Masks cover all but the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<turn: bigint, role: string, text: string>>"


def as_arrays(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """id, turns: one row per conversation with its turns in order. A conversation is one training example and has to
    fit a row. Rows without an id take no part; equal or null turn numbers are ordered by role and text, nulls first; null
    roles count as user and null texts as empty."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), turn.alias("t"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("t"), lambda x, y: order(x, y)).alias("turns"))


def order(x: Column, y: Column) -> Column:
    """-1, 0 or 1 by turn, role, text; a null turn comes first."""
    def by(a, b):
        return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)

    turn, role = by(x["turn"], y["turn"]), by(x["role"], y["role"])
    return F.when(turn != 0, turn).when(role != 0, role).otherwise(by(x["text"], y["text"]))


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def trained_spans(turns: Column) -> Column:
    """(start, end) in characters of the rendered assistant texts with their end marks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(s, t):
        head = s["at"] + F.length(t["role"]) + 5
        end = head + F.length(t["text"]) + 7
        own = F.struct(head.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(t["role"] == "assistant", F.array_append(s["spans"], own)).otherwise(s["spans"])
        return F.struct((end + 1).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def pairs(df: DataFrame, id_col: str = "id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """One row per row of ``df``, which has two arrays of turns (role, text): id, prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans.

    The prompt is the longest common prefix of whole turns, equal in role and text. The spans say which characters of
    a completion are trained on; all others, and the prompt, are masked. A null array counts as empty; equal
    conversations give two empty completions. Other columns are left out.
    """
    none = F.array().cast(TURN)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(chosen_col), none).alias("c"), F.coalesce(F.col(rejected_col), none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce(
        x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False)))
    rows = rows.withColumn("first", F.array_position(same, False)).withColumn(
        "prompt_turns", F.when(F.col("first") == 0, F.size("c")).otherwise(F.col("first") - 1).cast("int"))

    def text(turns):
        return F.array_join(F.transform(turns, render), "")

    def rest(name):
        return F.slice(F.col(name), F.col("prompt_turns") + 1, F.greatest(F.size(name), F.lit(1)))

    return rows.select("id", "prompt_turns", text(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
                       text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"),
                       trained_spans(rest("c")).alias("chosen_spans"), trained_spans(rest("r")).alias("rejected_spans"))


def with_other_reply(conversations: DataFrame) -> DataFrame:
    """id, chosen, rejected: every conversation beside itself with another last reply, that of the conversation with the
    next id; where that has none, the reply is left out. A conversation without a reply of the assistant
    is left as it is. Ids are whole numbers."""
    rows = conversations.select("id", "turns", F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1)).alias("reply"))
    others = rows.select((F.col("id") - 1).alias("id"), F.col("reply.text").alias("other"))
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant") + 1
    both = rows.join(others, "id", "left").withColumn("at", F.when(F.col("reply").isNotNull(), at))
    kept = F.filter("turns", lambda t, i: F.coalesce(i + 1 != F.col("at"), F.lit(True)) | F.col("other").isNotNull())
    swapped = F.transform(kept, lambda t, i: F.when(F.coalesce(i + 1 == F.col("at"), F.lit(False)) & F.col("other").isNotNull(), F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return both.select("id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
