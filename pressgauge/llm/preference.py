"""Preference pairs of conversations as one prompt and two masked completions.

Chosen and rejected conversations are compared turn by turn. Their longest common prefix of turns is
rendered once, as the prompt. The remaining turns of each are its completion; loss falls on the
content and end mark of assistant turns only, given as character ranges of the completion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the template -----------------------------------------------------------------
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
UNKNOWN_ROLE = "unknown"
TRAINED_ROLES = ("assistant",)
# -----------------------------------------------------------------------------------------------


def _turns(rows: DataFrame, key: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    """One row per conversation: its turns in order. A conversation is one training text, so it fits a row."""
    item = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN_ROLE)).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    parts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("pair_id"), item.alias("item"))
    return parts.groupBy("pair_id").agg(F.array_sort(F.collect_list("item")).alias(side))


def _common(chosen: Column, rejected: Column) -> Column:
    """How many turns agree in role and text from the start on."""
    same = lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    agree = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(same(a, b), F.lit(False)))
    first = F.array_position(agree, False)
    return F.when(first > 0, first - 1).otherwise(F.size(agree)).cast("int")


def _render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), ""
    )


def _mask(turns: Column, trained: Sequence[str]) -> Column:
    """Ranges, as struct(start, end) in characters of the rendered turns, that carry loss."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(MIDDLE)
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("ranges"))

    def step(state: Column, t: Column) -> Column:
        begin, after = state["at"] + head(t), state["at"] + head(t) + body(t)
        here = F.array(F.struct(begin.alias("start"), after.alias("end")))
        ranges = F.when(t["role"].isin(*trained), F.concat(state["ranges"], here)).otherwise(state["ranges"])
        return F.struct(after.alias("at"), ranges.alias("ranges"))

    return F.aggregate(turns, start, step)["ranges"]


def with_other_answer(
    rows: DataFrame, key: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", answers: str = "assistant"
) -> DataFrame:
    """The turns (key, turn, role, text) with the last answer of each conversation replaced by that of the next id.

    Rejected sides for conversations that have none. The last answer is the answer with the greatest
    turn number (of several texts with that number, all are replaced, and the greatest goes to the
    conversation before). Where the next id has no answer, the answer is empty. Conversations
    without an answer stay as they are, rows without id go, and an empty table gives an empty table.
    """
    plain = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.col(turn).alias(turn), F.col(role).alias(role), F.col(text).alias(text)
    )
    answer = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = plain.where((F.col(role) == answers) & F.col(turn).isNotNull()).groupBy(key).agg(F.max(answer).alias("_last"))
    own = last.select(F.col(key), F.col("_last.turn").alias("_turn"))
    other = last.select((F.col(key) - 1).alias(key), F.col("_last.text").alias("_text"))
    replaced = (F.col(role) == answers) & (F.col(turn) == F.col("_turn"))
    joined = plain.join(own, key, "left").join(other, key, "left")
    return joined.select(
        key, turn, role, F.when(replaced, F.coalesce("_text", F.lit(""))).otherwise(F.col(text)).alias(text)
    )


def format_pairs(
    chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained: Sequence[str] = TRAINED_ROLES,
) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask), one row per pair id.

    Turns are ordered by number, then role, then text; repeated turns stay. A pair id on one side
    only has no common turn and an empty completion on the other side; equal conversations have two
    empty completions. Null texts count as empty, a null role as "unknown", a null turn number comes
    first, rows without pair id take no part. Extra columns are ignored. Empty tables give an empty table.
    """
    both = _turns(chosen, key, turn, role, text, "a").join(_turns(rejected, key, turn, role, text, "b"), "pair_id", "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    n = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0)).otherwise(_common(F.col("a"), F.col("b")))
    split = both.select("pair_id", a.alias("a"), b.alias("b"), n.alias("n_common"))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    cut = split.select(
        "pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("prompt"),
        rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"),
    )
    return cut.select(
        "pair_id", "n_common", _render(F.col("prompt")).alias("prompt"),
        _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"),
        _mask(F.col("a"), trained).alias("chosen_mask"), _mask(F.col("b"), trained).alias("rejected_mask"),
    )
