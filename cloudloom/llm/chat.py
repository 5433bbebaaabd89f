"""Preference formatting of chosen and rejected conversations.

For each pair the longest common prefix of turns (equal role and text) is rendered
once as the prompt; what follows in either conversation is rendered as its
completion, with a mask of the assistant's words, the characters a loss may count.

A turn is rendered as ``<|role|>\\n`` + text + ``<|end|>\\n``. Pairs come from
conversations that open with the same turn: ordered by id, the first is chosen over
the second, the third over the fourth, and so on; one that is left over stands alone
as chosen, with rejected null, and all its turns but the last assistant turn are its
prompt.

Edge cases: a null role or text is rendered as empty and equals only null; turns are
ordered by number, then role and text; a conversation that is a prefix of the other
has an empty completion; identical conversations have two empty ones. Rows with a null
conv_id form one conversation. An empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import grouped_rank, saved

END = "<|end|>\n"
TURN = "struct<role:string,text:string>"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row per conversation, written once for the steps that read it."""
    one = F.struct("turn", "role", "text")
    convs = turns.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    )
    return saved(convs, "conversations")


def _opening(turn: Column) -> Column:
    """A digest of role and text that no other pair of them has: each with its length, null apart."""

    def told(x: Column) -> Column:
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat_ws(":", F.length(x).cast("string"), x))

    return F.sha2(F.concat(told(turn["role"]), F.lit("|"), told(turn["text"])), 256)


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """start:end of each assistant text in the rendered turns, code points, comma-joined."""

    def step(state: Column, x: Column) -> Column:
        n = F.length(F.coalesce(x["text"], F.lit("")))
        start = state["at"] + F.length(F.coalesce(x["role"], F.lit(""))) + 5
        told = F.concat_ws(":", start.cast("string"), (start + n).cast("string"))
        spans = F.when(x["role"] == "assistant", F.concat(state["spans"], F.array(told))).otherwise(state["spans"])
        return F.struct((start + n + len(END)).cast("int").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def pair_up(convs: DataFrame, width: int = 4_096) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected: neighbours by id among those that open alike.

    Ranks are counted in ranges of ``width`` ids, so an opening that very many
    conversations share is spread over tasks.
    """
    ids = convs.select("conv_id", _opening(F.get("turns", F.lit(0))).alias("opening"))
    bucket = F.floor(F.coalesce("conv_id", F.lit(-1)) / width)
    ranks = saved(grouped_rank(ids, ["opening"], bucket, [F.col("conv_id").asc_nulls_first()]), "ranks")
    # only ids move until the pairs stand
    even = ranks.where("rank % 2 = 0").select("opening", F.col("rank").alias("at"), F.col("conv_id").alias("chosen_id"))
    odd = ranks.where("rank % 2 = 1").select("opening", (F.col("rank") - 1).alias("at"), F.col("conv_id").alias("rejected_id"), F.lit(True).alias("there"))
    pairs = even.join(odd, ["opening", "at"], "left").select("chosen_id", "rejected_id", "there")
    a = convs.select(F.col("conv_id").alias("a_id"), F.col("turns").alias("chosen"))
    b = convs.select(F.col("conv_id").alias("b_id"), F.col("turns").alias("rejected"))
    both = pairs.join(a, F.col("chosen_id").eqNullSafe(F.col("a_id"))).drop("a_id")
    # a null conv_id is the smallest of its opening and never rejected
    return both.join(b, F.col("there") & (F.col("rejected_id") == F.col("b_id")), "left").drop("b_id", "there")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of (chosen_id, chosen, rejected_id, rejected) rows."""
    alone = F.when(F.get("chosen", F.size("chosen") - 1)["role"] == "assistant", F.size("chosen") - 1).otherwise(F.size("chosen"))
    shared = F.when(F.col("rejected").isNull(), alone).otherwise(common_turns(F.col("chosen"), F.col("rejected")))
    cut = pairs.withColumn("prompt_turns", shared.cast("int"))

    def after(name: str) -> Column:
        return F.slice(name, F.col("prompt_turns") + 1, F.size(name) + 1)

    return cut.select(
        "chosen_id", "rejected_id", "prompt_turns",
        rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(after("chosen")).alias("chosen"), mask(after("chosen")).alias("chosen_mask"),
        F.when(F.col("rejected").isNotNull(), rendered(after("rejected"))).alias("rejected"),
        F.when(F.col("rejected").isNotNull(), mask(after("rejected"))).alias("rejected_mask"),
    )


def preferences(turns: DataFrame) -> DataFrame:
    """Formatted pairs of a table of turns (conv_id, turn, role, text)."""
    return format_pairs(pair_up(gathered(turns)))
