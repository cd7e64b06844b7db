"""Preference formatting: one prompt for the common turns, two masked completions for the rest.

Chosen and rejected conversations of a pair are put in order of turn, their longest common
prefix of (role, text) is rendered once as the prompt, and the rest of each side becomes a
completion. The mask of a completion lists the character ranges on which a loss may rest: the
texts of its assistant turns. The prompt carries no loss.

All is built in: one shuffle per side puts a conversation together (its rendered text is one
value of the result, so its turns must meet), offsets come from a running sum over the same
partitioning, and the two sides meet by their pair id.

Defined results: a null role renders as `unknown`, a null text as empty; null turns come last;
turns that share a number are ordered by role and text, repeated rows stay; a pair that has one
side only gets an empty other side and no prompt; a null pair id is a pair; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT = "assistant"
BLOCK = 64


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BETWEEN), text, F.lit(CLOSE))


def _side(turns: DataFrame, name: str) -> DataFrame:
    """pair_id and its turns in order; `end` is the offset behind the rendered turn."""
    rows = turns.select(
        "pair_id", F.col("turn").isNull().alias("late"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("pair_id").orderBy("late", "turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length(_rendered(F.col("role"), F.col("text")))).over(order))
    # The offset grows with every turn, so it orders them.
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("end", "role", "text"))).alias(name))


def _text(turns: Column, start: Column) -> Column:
    """The rendered turns from a place on, counted from 1."""
    return F.array_join(F.transform(F.slice(turns, start, F.size(turns) + 1), lambda t: _rendered(t["role"], t["text"])), "")


def _mask(turns: Column, common: Column, base: Column) -> Column:
    rest = F.filter(F.slice(turns, common + 1, F.size(turns) + 1), lambda t: t["role"] == LEARNT)
    return F.transform(
        rest,
        lambda t: F.struct(
            (t["end"] - len(CLOSE) - F.length(t["text"]) - base).cast("long").alias("start"),
            (t["end"] - len(CLOSE) - base).cast("long").alias("end"),
        ),
    )


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, common turns, prompt, and text and mask of both completions.

    Both sides hold pair_id, turn, role and text.
    """
    left, right = _side(chosen, "chosen_turns"), _side(rejected, "rejected_turns").withColumnRenamed("pair_id", "other_id")
    both = left.join(right, left["pair_id"].eqNullSafe(right["other_id"]), "full_outer")
    none = F.array().cast("array<struct<end:bigint,role:string,text:string>>")
    both = both.select(
        F.coalesce("pair_id", "other_id").alias("pair_id"),
        F.coalesce("chosen_turns", none).alias("a"), F.coalesce("rejected_turns", none).alias("b"),
    )
    same = F.zip_with("a", "b", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("common", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    base = F.when(F.col("common") > 0, F.get("a", F.col("common") - 1)["end"]).otherwise(F.lit(0)).cast("long")
    both = both.withColumn("base", base)
    return both.select(
        "pair_id", "common",
        F.array_join(F.transform(F.slice("a", F.lit(1), F.col("common")), lambda t: _rendered(t["role"], t["text"])), "").alias("prompt"),
        _text(F.col("a"), F.col("common") + 1).alias("chosen"), _mask(F.col("a"), F.col("common"), F.col("base")).alias("chosen_mask"),
        _text(F.col("b"), F.col("common") + 1).alias("rejected"), _mask(F.col("b"), F.col("common"), F.col("base")).alias("rejected_mask"),
    )


def borrowed(turns: DataFrame) -> DataFrame:
    """A rejected side for every conversation (conv_id, turn, role, text): its last answer is
    replaced by that of the next conversation among the `BLOCK` ids around it, the first following
    the last. A conversation without an answer stays as it is. The blocks bound the windows.
    """
    answers = turns.filter(F.col("role") == LEARNT)
    last = answers.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    order = Window.partitionBy(F.floor(F.col("conv_id") / BLOCK)).orderBy("conv_id")
    first = F.first("last.text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.lead("conv_id").over(order)
    donors = last.select(
        F.col("conv_id").alias("of"), "last", F.when(following.isNotNull(), F.lead("last.text").over(order)).otherwise(first).alias("other")
    )
    joined = turns.join(donors, turns["conv_id"].eqNullSafe(donors["of"]), "left")
    replaced = (F.col("role") == LEARNT) & F.col("turn").eqNullSafe(F.col("last.turn")) & F.col("text").eqNullSafe(F.col("last.text")) & F.col("last").isNotNull()
    return joined.select("conv_id", "turn", "role", F.when(replaced, F.col("other")).otherwise(F.col("text")).alias("text"))


# The same rows in DuckDB's SQL over `conversations`.
CHECK = f"""
WITH answers AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS n
  FROM conversations WHERE role = '{LEARNT}'
), donors AS (
  SELECT conv_id, turn, text, CASE WHEN lead(conv_id) OVER w IS NOT NULL THEN lead(text) OVER w
    ELSE first_value(text) OVER w END AS other
  FROM answers WHERE n = 1 WINDOW w AS (PARTITION BY floor(conv_id / {BLOCK}) ORDER BY conv_id)
), rejected AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = '{LEARNT}' AND c.turn IS NOT DISTINCT FROM d.turn
    AND c.text IS NOT DISTINCT FROM d.text AND d.conv_id IS NOT NULL THEN d.other ELSE c.text END AS text
  FROM conversations c LEFT JOIN donors d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
), both_sides AS (
  SELECT 'a' AS side, conv_id, turn, role, text FROM conversations UNION ALL SELECT 'b', conv_id, turn, role, text FROM rejected
), t AS (
  SELECT side, conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM both_sides
), r AS (
  SELECT *, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t
), o AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY side, conv_id ORDER BY i) AS stop FROM r
), p AS (
  SELECT conv_id, a.i, (a.role = b.role AND a.text = b.text) AS same
  FROM (SELECT * FROM r WHERE side = 'a') a JOIN (SELECT * FROM r WHERE side = 'b') b USING (conv_id, i)
), c AS (
  SELECT conv_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS common FROM p GROUP BY conv_id
), base AS (
  SELECT c.conv_id, common, coalesce(max(stop) FILTER (i <= common), 0) AS base FROM c JOIN o ON o.conv_id = c.conv_id AND side = 'a' GROUP BY ALL
)
SELECT o.conv_id, common::BIGINT AS common, count(*) FILTER (side = 'a')::BIGINT AS n_turns,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i <= common), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i > common), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'b' AND i > common), '')) AS rejected_sha256,
  coalesce(string_agg((stop - {len(CLOSE)} - length(text) - base)::BIGINT || ':' || (stop - {len(CLOSE)} - base)::BIGINT, ',' ORDER BY i)
    FILTER (side = 'a' AND i > common AND role = '{LEARNT}'), '') AS chosen_mask,
  coalesce(string_agg((stop - {len(CLOSE)} - length(text) - base)::BIGINT || ':' || (stop - {len(CLOSE)} - base)::BIGINT, ',' ORDER BY i)
    FILTER (side = 'b' AND i > common AND role = '{LEARNT}'), '') AS rejected_mask
FROM o JOIN base ON base.conv_id = o.conv_id GROUP BY o.conv_id, common, base
"""
