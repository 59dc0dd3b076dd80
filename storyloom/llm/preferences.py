"""Preference pairs for training: one prompt, two masked completions.

A pair is two conversations, chosen and rejected, as arrays of turns in order. The turns that both begin with are the
prompt, rendered once; what is left of each is its completion. A completion carries the spans of characters to train
on: the texts and end marks of assistant turns; everything else in it is masked, as is the whole prompt.

All is expressions over the two arrays; a pair is one row, and nothing is moved but the turns to their conversation.

Defined cases: a null role is `unknown`, a null text empty, null turn numbers come first; rows that share conversation
and turn are all kept, by role and text; equal conversations have empty completions; one that is the other's prefix has
one empty completion; keys that are null or on one side alone make no pair; empty tables give empty results; columns
with any other names are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a rendered turn.
OPEN, NEXT, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def turns_by_conversation(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per key: key, turns (array of role and text in order)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(ordered.alias("turns")).select("key", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(NEXT), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """Of a rendered completion: start and end of what is trained, in characters."""
    width = lambda t: F.length(F.concat(F.lit(OPEN), t["role"], F.lit(NEXT), t["text"], F.lit(CLOSE)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["role"]) + len(OPEN) + len(NEXT)
        span = F.array(F.struct(start.cast("int").alias("start"), (done["at"] + width(t)).cast("int").alias("end")))
        return F.struct((done["at"] + width(t)).alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda done: done["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Of key, chosen and rejected (arrays of turns): key, common_turns, prompt, and of each side text and spans."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    # where one array ends the other has a turn against null, which differs
    differs = F.array_position(same, F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    rest = lambda side: F.slice(side, F.col("common_turns") + 1, F.greatest(F.size(side) - F.col("common_turns"), F.lit(0)))
    out = pairs.select("key", "chosen", "rejected", common.alias("common_turns"))
    out = out.select("key", "common_turns", F.slice("chosen", F.lit(1), F.col("common_turns")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return out.select(
        "key",
        "common_turns",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _spans(F.col("c")).alias("chosen_spans"),
        _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """format_pairs() of two tables of turns that share a key."""
    a, b = turns_by_conversation(chosen, key), turns_by_conversation(rejected, key)
    return format_pairs(a.withColumnRenamed("turns", "chosen").join(b.withColumnRenamed("turns", "rejected"), "key"))


def with_stale_reply(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, rejected the same with one assistant turn repeating the
    assistant turn before it (or the first turn where there is none). A hash of the key says which turn. All turns
    stay on both sides; a conversation without an assistant is paired with itself."""
    rows = turns_by_conversation(conversations, key)
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED_ROLE)
    hashed = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("at", at).withColumn("k", F.when(F.size("at") > 0, hashed % F.size("at") + 1).cast("int"))
    before = F.when(F.col("k") > 1, F.element_at("at", F.col("k") - 1)).otherwise(F.lit(1))
    rows = rows.withColumn("stale", F.element_at("turns", before)["text"]).withColumn("gone", F.element_at("at", F.col("k")))
    text = lambda t, i: F.when(i + 1 == F.col("gone"), F.col("stale")).otherwise(t["text"])
    rejected = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), text(t, i).alias("text")))
    return rows.select("key", F.col("turns").alias("chosen"), rejected.alias("rejected"))
