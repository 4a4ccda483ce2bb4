"""Preference formatting of conversations.

The turns that a chosen and a rejected conversation share from the start are rendered once, as the prompt; the
turns after that are the two completions. Masks are spans of a completion's characters that a loss should count:
what the assistant says and the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template of a turn; a text's own marks are broken up, so they cannot be taken for turns.
OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def unmarked(text: Column) -> Column:
    """``text`` without a mark of the template: neither a role nor a text can end its turn or open another."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def head_of(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(unmarked(turn["role"]), F.lit("|>"), F.lit("| >")), F.lit(HEAD))


def rendered(turn: Column) -> Column:
    return F.concat(head_of(turn), unmarked(turn["text"]), F.lit(CLOSE))


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns of each conversation in order; null roles and texts become empty, exact repeats one."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start, by role and text."""
    same = F.zip_with(a, b, lambda x, y: (x["role"].eqNullSafe(y["role"])) & (x["text"].eqNullSafe(y["text"])))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def mask(turns: Column) -> Column:
    """start:stop of each trained part of the rendered turns, comma-joined; code points, end exclusive."""

    def add(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(head_of(turn))
        stop = acc["at"] + F.length(rendered(turn))
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct(stop.alias("at"), F.when(turn["role"] == TRAINED, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(turns, first, add, lambda acc: F.array_join(acc["out"], ","))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """(key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask), one row for each key of both tables.

    Both are tables of turns (key, turn, role, text). Turns are ordered by number, then role and text, so ties and
    repeated rows have one outcome. A conversation equal to the other has an empty completion; an empty prefix an
    empty prompt. Null keys, and keys of one table only, give no row. Other columns are not read.
    """
    pair = conversations(chosen, key).withColumnRenamed("turns", "a").join(conversations(rejected, key).withColumnRenamed("turns", "b"), key)
    pair = pair.withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    pair = pair.select(key, "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("both"), rest("a").alias("a"), rest("b").alias("b"))
    text = lambda c: F.array_join(F.transform(F.col(c), rendered), "")
    return pair.select(
        key, F.col("n_common").cast("long").alias("n_common"), text("both").alias("prompt"), text("a").alias("chosen"), text("b").alias("rejected"),
        mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Turns of rejected conversations: each with its last answer exchanged for that of its partner.

    Partners are the ids 2k and 2k + 1. A conversation without an answer, or whose partner has none, stays as it is, as
    do rows with a null id, turn or role. Of several last answers with one number the greatest text is the partner's, and
    each repeated row is exchanged; an empty table gives no rows; other columns are not read, whatever their names.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    answers = turns.where((F.col("role") == TRAINED) & F.col("conv_id").isNotNull())
    last = answers.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    swaps = last.select(F.col("conv_id").alias("own"), F.col("last.turn").alias("last_turn")).join(
        last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("own"), F.col("last.text").alias("other")), "own"
    )
    swap = (F.col("role") == TRAINED) & (F.col("turn") == F.col("last_turn"))
    joined = turns.join(swaps, F.col("conv_id") == F.col("own"), "left")
    return joined.select("conv_id", "turn", "role", F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text"))
