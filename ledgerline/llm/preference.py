"""Preference formatting: pairs of conversations as one shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _turns(side: DataFrame, name: str, keys: tuple[str, str, str, str]) -> DataFrame:
    pair, turn, role, text = keys
    said = F.struct(
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return side.select(
        F.col(pair).alias("pair_id"), F.col(turn).alias("turn"), said.alias("said"), F.lit(name).alias("side")
    ).where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(said: Column) -> Column:
    return F.concat(head(said["role"]), said["text"], F.lit("<|end|>\n"))


def _completion(turns: Column, side: str) -> Column:
    """Text of a side's turns, and the stretches of it (start, end; code points) that are trained on."""
    own = F.transform(F.filter(turns, lambda t: t[side].isNotNull()), lambda t: t[side])
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("trained"))

    def add(done: Column, said: Column) -> Column:
        begin = F.length(done["text"]) + F.length(head(said["role"]))
        span = F.struct(
            begin.cast("int").alias("start"),
            (begin + F.length(said["text"]) + F.length(F.lit("<|end|>"))).cast("int").alias("end"),
        )
        more = F.when(said["role"] == TRAINED_ROLE, F.concat(done["trained"], F.array(span))).otherwise(done["trained"])
        return F.struct(F.concat(done["text"], rendered(said)).alias("text"), more.alias("trained"))

    return F.aggregate(own, start, add)


def preference_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per pair: ``pair_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    The prompt is the longest common prefix of turns (same number, role and text on both sides), rendered once;
    the completions hold what follows on either side, and the masks list the stretches (``start, end``) a loss
    applies to: the text and end mark of assistant turns. Null roles and texts count as empty; rows without pair
    or turn are left out; of several rows for one turn of a side the smallest (role, text) counts. A pair that
    one side lacks has no shared turn and an empty completion there; equal conversations have two empty
    completions. Empty tables give an empty one. Rows are first merged by (pair, turn), before any pair is put
    together, so a pair's row is as long as its conversations and no longer.
    """
    keys = (pair_col, turn_col, role_col, text_col)
    both = _turns(chosen, "chosen", keys).unionByName(_turns(rejected, "rejected", keys))
    merged = both.groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "chosen", F.col("said"))).alias("chosen"),
        F.min(F.when(F.col("side") == "rejected", F.col("said"))).alias("rejected"),
    )
    turn = F.struct("turn", "chosen", "rejected", F.expr("NOT chosen <=> rejected").alias("apart"))
    pairs = merged.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.min(F.when(F.expr("NOT chosen <=> rejected"), F.col("turn"))).alias("cut")
    )
    shared = F.filter("turns", lambda t: F.col("cut").isNull() | (t["turn"] < F.col("cut")))
    rest = F.filter("turns", lambda t: F.col("cut").isNotNull() & (t["turn"] >= F.col("cut")))
    parts = pairs.select(
        "pair_id",
        F.size(shared).alias("n_shared"),
        F.array_join(F.transform(shared, lambda t: rendered(t["chosen"])), "").alias("prompt"),
        _completion(rest, "chosen").alias("c"),
        _completion(rest, "rejected").alias("r"),
    )
    return parts.select(
        "pair_id",
        "n_shared",
        "prompt",
        F.col("c.text").alias("chosen"),
        F.col("r.text").alias("rejected"),
        F.col("c.trained").alias("chosen_mask"),
        F.col("r.trained").alias("rejected_mask"),
    )


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """A rejected version of every conversation (``conv_id, turn, role, text``).

    It runs up to the last assistant turn, which is replaced by the last assistant text of the conversation whose
    id differs in the lowest bit; where there is none, the turn is left out. Rows without a conversation or a turn are
    left out of the answers; of several last turns the one with the greatest text counts. Other columns go; an empty
    table gives an empty one.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    last = (
        conversations.where((F.col("role") == TRAINED_ROLE) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("text"))
    before = conversations.join(last, "conv_id", "left").where(F.col("last").isNull() | (F.col("turn") < F.col("last.turn")))
    answer = last.join(other, "conv_id").select("conv_id", "last.turn", F.lit(TRAINED_ROLE).alias("role"), other["text"])
    return before.select("conv_id", "turn", "role", "text").unionByName(answer)
