"""Preference formatting of conversations.

Two conversations, chosen and rejected, are compared turn by turn. Their longest common prefix of turns is rendered once
as the prompt; what follows on either side is a completion, with the spans of its assistant turns as a mask: only those
characters are trained on. DataFrame operations only.

Texts are shuffled once, by pair; slots and conversations are put together on that partitioning. A pair is one row, as a
preference example is one prompt with two completions: rows of a pair meet in one task by the nature of the result, and
two conversations have to fit a row (2 GB).

Defined results: rows without a conversation id belong to none; a null turn counts as 0, a null role as `user`, a null
text as empty; repeated rows of a turn count once, different rows of one turn are one slot in order of role and text;
turns are compared by their place in order of turn number, so gaps in the numbers don't matter; a conversation without a
partner has an empty prompt and one empty completion; equal conversations are all prompt; texts of any length stay
whole; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MIDDLE, CLOSE, ANSWERS = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def neighbours(conversations: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side): an even id is chosen over the odd id that follows."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    return ids.select("conv_id", F.shiftright("conv_id", 1).alias("pair_id"), F.pmod("conv_id", F.lit(2)).cast("int").alias("side"))


def _slots(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, turn, body, answer): the rendered slot of each turn and whether it is an answer."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_pair = turns.join(pairs.select("conv_id", "pair_id", "side"), "conv_id").drop("conv_id").repartition("pair_id")
    rows = by_pair.groupBy("pair_id", "side", "turn").agg(F.sort_array(F.collect_set(F.struct("role", "text"))).alias("said"))
    shown = F.array_join(F.transform("said", lambda s: F.concat(F.lit(OPEN), s.role, F.lit(MIDDLE), s.text, F.lit(CLOSE))), "")
    return rows.select("pair_id", "side", "turn", shown.alias("body"), F.forall("said", lambda s: s.role == ANSWERS).alias("answer"))


def _joined(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: s.body), "")


def _mask(slots: Column) -> Column:
    """Spans of answers, as from-to in code points of the joined slots."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        end = acc.at + F.length(s.body)
        span = F.concat(F.when(acc.spans == "", "").otherwise(","), acc.at.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(s.answer, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(slots, start, add, lambda acc: acc.spans)


def preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask), a row for each pair.

    pairs: (conv_id, pair_id, side), side 0 chosen and 1 rejected."""
    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("turn", "body", "answer"))))
    both = _slots(conversations, pairs).groupBy("pair_id").agg(side(0).alias("c"), side(1).alias("r"))
    same = F.zip_with("c", "r", lambda c, r: c.body.eqNullSafe(r.body))
    differ = F.array_position(same, False)
    both = both.withColumn("shared", F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda name: F.slice(name, F.col("shared") + 1, F.size(name))
    both = both.withColumns({"prompt": F.slice("c", F.lit(1), F.col("shared")), "c": rest("c"), "r": rest("r")})
    return both.select(
        "pair_id",
        F.col("shared").cast("long").alias("prompt_turns"),
        _joined(F.col("prompt")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return preferences(conversations, neighbours(conversations))


OP9_SQL = rf"""
WITH m AS (SELECT DISTINCT floor(conv_id / 2)::BIGINT AS pair_id, CAST(((conv_id % 2) + 2) % 2 AS INTEGER) AS side, coalesce(turn, 0) AS turn,
                  coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, side, turn, string_agg('{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY role, text) AS body,
             bool_and(role = '{ANSWERS}') AS answer FROM m GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn) AS place FROM s),
c AS (SELECT pair_id, place, max(CASE WHEN side = 0 THEN body END) AS c, max(CASE WHEN side = 1 THEN body END) AS r FROM n GROUP BY ALL),
f AS (SELECT pair_id, min(CASE WHEN c IS DISTINCT FROM r THEN place END) AS first FROM c GROUP BY ALL),
p AS (SELECT n.*, first IS NULL OR place < first AS common FROM n JOIN f USING (pair_id)),
o AS (SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side, common ORDER BY place) AS till FROM p)
SELECT pair_id, CAST(count(*) FILTER (common AND side = 0) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (common AND side = 0), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (NOT common AND side = 0), '') AS chosen,
  coalesce(string_agg((till - length(body))::BIGINT || '-' || till::BIGINT, ',' ORDER BY place) FILTER (NOT common AND side = 0 AND answer), '') AS chosen_mask,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (NOT common AND side = 1), '') AS rejected,
  coalesce(string_agg((till - length(body))::BIGINT || '-' || till::BIGINT, ',' ORDER BY place) FILTER (NOT common AND side = 1 AND answer), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
