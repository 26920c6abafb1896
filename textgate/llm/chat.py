"""Chat and preference formatting, in DataFrame expressions only.

A preference pair is two conversations under one pair id.  Both are gathered into ordered turn
lists; the longest common prefix of (role, text) turns is rendered once as the prompt, and what
follows in each is its completion.  A completion's loss mask is the list of character ranges,
counted from the completion's start, that belong to assistant texts and their end marks.

Turns are gathered by pair id, which holds one conversation a side, so the rows of one task
grow with the length of a conversation and not with how many conversations look alike.

Defined cases: a null role or text counts as empty; turns are ordered by turn number (null
first), then role and text; a repeated turn row is one turn; rows with a null pair id are left
out; a pair with one side only has an empty other side and is returned with ``both`` false;
two equal sides have the whole conversation as prompt and empty completions; an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turns: Column) -> Column:
    """Turns as text: a head with the role, the text, an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """``start:end`` character ranges, comma-joined, of one role's texts in ``rendered(turns)``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        head = state["at"] + len(OPEN) + F.length(t["role"]) + len(MIDDLE)
        end = head + F.length(t["text"]) + len(CLOSE)
        own = F.array(F.concat_ws(":", head.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(state["out"], own)).otherwise(state["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["out"]), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both tables have ``pair_id``, ``turn``, ``role`` and ``text``."""
    sides = chosen.select("pair_id", "turn", "role", "text", F.lit(True).alias("good")).unionByName(rejected.select("pair_id", "turn", "role", "text", F.lit(False).alias("good")))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(good: bool) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("good") == good, turn)))

    df = sides.where("pair_id is not null").groupBy("pair_id").agg(side(True).alias("chosen_turns"), side(False).alias("rejected_turns"))
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(same, False)
    shared = F.when(at > 0, at - 1).otherwise(F.least(F.size("chosen_turns"), F.size("rejected_turns"))).cast("int")
    df = df.withColumn("n", shared)
    df = df.withColumn("prompt_turns", F.slice("chosen_turns", F.lit(1), F.col("n")))
    for c in ("chosen", "rejected"):
        df = df.withColumn(f"{c}_rest", F.slice(f"{c}_turns", F.col("n") + 1, F.greatest(F.size(f"{c}_turns") - F.col("n"), F.lit(0))))
    return df.select(
        "pair_id",
        F.size("prompt_turns").cast("long").alias("n_prompt_turns"),
        F.size("chosen_rest").cast("long").alias("n_chosen_turns"),
        F.size("rejected_rest").cast("long").alias("n_rejected_turns"),
        rendered(F.col("prompt_turns")).alias("prompt"),
        rendered(F.col("chosen_rest")).alias("chosen"),
        rendered(F.col("rejected_rest")).alias("rejected"),
        loss_mask(F.col("chosen_rest")).alias("chosen_mask"),
        loss_mask(F.col("rejected_rest")).alias("rejected_mask"),
        ((F.size("chosen_turns") > 0) & (F.size("rejected_turns") > 0)).alias("both"),
    )


def with_swapped_reply(conversations: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn, whose text is that of the assistant turn before.

    A conversation with a single assistant turn gets the text of the turn before the reply
    instead.  Those without an assistant turn, or with nothing before it, give no rows.
    """
    valid = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    answer = F.when(F.col("role") == "assistant", F.struct(F.coalesce("text", F.lit("")).alias("text")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = valid.withColumn("place", F.row_number().over(order)).withColumn("earlier", F.last(answer, True).over(before)).withColumn("previous", F.lag(F.coalesce("text", F.lit("")), 1).over(order))
    df = df.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(Window.partitionBy("conv_id")))
    df = df.where((F.col("place") <= F.col("last")) & (F.col("last") > 1))
    text = F.when(F.col("place") == F.col("last"), F.coalesce(F.col("earlier.text"), F.col("previous"))).otherwise(F.col("text"))
    return df.select(F.col("conv_id").alias("pair_id"), "turn", "role", text.alias("text"))


def preferences(conversations: DataFrame) -> DataFrame:
    """Preference pairs of each conversation against itself with a reply from elsewhere in it."""
    rejected = with_swapped_reply(conversations)
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return preference_pairs(chosen, rejected)


ORACLE = """
WITH v AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM v),
l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN place END) OVER (PARTITION BY conv_id) AS last,
  lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY place) AS previous,
  last_value(CASE WHEN role = 'assistant' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM o),
r AS (SELECT conv_id, place, turn, coalesce(role, '') AS role, coalesce(CASE WHEN place = last THEN coalesce(earlier, previous) ELSE text END, '') AS text FROM l WHERE place <= last AND last > 1),
c AS (SELECT conv_id, place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM o),
d AS (SELECT c.conv_id, min(c.place) AS p FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.place = c.place WHERE r.place IS NULL OR r.text <> c.text OR r.role <> c.role GROUP BY c.conv_id),
n AS (SELECT c.conv_id, coalesce(any_value(d.p), count(*) + 1) - 1 AS n FROM c LEFT JOIN d USING (conv_id) GROUP BY c.conv_id),
t AS (SELECT 'c' AS side, c.* FROM c UNION ALL SELECT 'r', conv_id, place, role, text FROM r),
e AS (SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body, length(role) + 5 AS head FROM t JOIN n USING (conv_id)),
f AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id, side, place <= n ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
g AS (SELECT *, CASE WHEN role = 'assistant' THEN CAST(pos + head AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT) END AS span FROM f)
SELECT conv_id AS pair_id,
  count(*) FILTER (side = 'c' AND place <= n) AS n_prompt_turns,
  count(*) FILTER (side = 'c' AND place > n) AS n_chosen_turns,
  count(*) FILTER (side = 'r' AND place > n) AS n_rejected_turns,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 'c' AND place <= n), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 'c' AND place > n), '') AS chosen,
  coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 'r' AND place > n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (side = 'c' AND place > n AND span IS NOT NULL), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (side = 'r' AND place > n AND span IS NOT NULL), '') AS rejected_mask,
  count(*) FILTER (side = 'r') > 0 AS both
FROM g GROUP BY conv_id
"""
