"""Preference formatting. DataFrame operations only.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns is rendered once as the prompt;
the turns after it are rendered as two completions, each with the character spans that a loss counts: the
assistant's turns. Conversations are handled in blocks of BLOCK_TURNS turns, one row a block, so a conversation of
any length never gathers in one task; nearly all have one block. The common prefix of the blocks is the least first
difference over all of a pair's blocks.

pair_conversations() pairs conversations with the same first turn, each with the next by id, however many there are. Ids are cut into
ranges of about RANGE_ROWS conversations; neighbours are found inside a range of an opening, and the last of a range is linked to
the first of the opening's next range by a small table of a row a range. So an opening that a third of all conversations share is
spread over many tasks, and the pairs are the same as if it were not.

Cases: a null role or text is an empty string; exactly repeated rows count once; several different rows with one turn
number form one unit, in order of role and text, and are held together in one row; rows with a null conv_id or turn are not part of a conversation and
are left out; a conversation without a partner gets a null rejected_id, its turns are the prompt and its completions
are empty; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BLOCK_TURNS = 256
#: Conversations in a range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 1024
TRAINED_ROLE = "assistant"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; without nulls and exact repeats."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).distinct()


def id_ranges(ids: DataFrame, rows: int, most: int = MOST_RANGES) -> list[int]:
    """Rising bounds of ranges of conv_id with about so many rows each; their number, not the input's, reaches the driver."""
    k = min(most, ids.count() // rows)
    if k < 2:
        return []
    found = ids.agg(F.percentile_approx("conv_id", [i / k for i in range(1, k)], 10 * most).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def pair_conversations(turns: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """chosen_id, rejected_id: conversations that open alike, each with the next by id; null for one that is alone."""
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("f"))
    first = first.select("conv_id", F.sha2(F.concat_ws("\x1f", F.col("f.role"), F.col("f.text")), 256).alias("opening"))
    first = common.stored(first, "openings")
    cuts = id_ranges(first, rows)
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("conv_id"))) if cuts else F.lit(0)
    first = first.withColumn("range", at)
    inside = first.select(F.col("conv_id").alias("chosen_id"), F.lead("conv_id").over(W.partitionBy("opening", "range").orderBy("conv_id")).alias("rejected_id"))
    ends = first.groupBy("opening", "range").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    w = W.partitionBy("opening").orderBy("range")
    ends = ends.select("low", "high", F.lead("low").over(w).alias("next"), F.lag("high").over(w).alias("prev"))
    alone = F.col("prev").isNull() & (F.col("low") == F.col("high"))
    across = ends.where(F.col("next").isNotNull() | alone).select(F.col("high").alias("chosen_id"), F.col("next").alias("rejected_id"))
    return inside.where("rejected_id IS NOT NULL").unionAll(across)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def _joined(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: rendered(u["role"], u["text"])), "")


def _spans(units: Column) -> Column:
    """[start, end) of the trained turns in the rendered string: the text and its end mark, without the head."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(a: Column, u: Column) -> Column:
        head = a["at"] + F.length(u["role"]) + 5
        end = head + F.length(u["text"]) + 9
        span = F.array(F.struct(head.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(u["role"] == TRAINED_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(units, zero, step)["spans"]


def format_pairs(turns: DataFrame, pairs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """chosen_id, rejected_id, block, prompt, chosen, rejected, chosen_spans, rejected_spans, common_turns."""
    pairs = common.stored(pairs, "pairs")
    sides = pairs.select("chosen_id", "rejected_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")),
        F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x"))
    rows = sides.select("chosen_id", "rejected_id", "x.side", "x.conv_id").join(turns, "conv_id")
    rows = rows.withColumn("block", F.floor(F.col("turn") / block_turns))
    unit = F.struct("turn", "role", "text")
    blocks = rows.groupBy("chosen_id", "rejected_id", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, unit))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, unit))).alias("b"))
    # units of one turn number are compared as a whole
    turn = lambda units, n: F.filter(units, lambda u: u["turn"] == n)
    numbers = F.array_distinct(F.concat(F.transform("a", lambda u: u["turn"]), F.transform("b", lambda u: u["turn"])))
    differ = F.array_min(F.filter(numbers, lambda n: turn(F.col("a"), n) != turn(F.col("b"), n)))
    blocks = common.stored(blocks.withColumn("differs_at", F.when(F.col("rejected_id").isNotNull(), differ)), "pair-blocks")
    least = blocks.groupBy("chosen_id").agg(F.min("differs_at").alias("first"))
    out = blocks.join(least, "chosen_id")
    before = lambda u: F.col("first").isNull() | (u["turn"] < F.col("first"))
    out = out.select(
        "chosen_id", "rejected_id", "block", F.filter("a", before).alias("p"),
        F.filter("a", lambda u: ~before(u)).alias("a"), F.filter("b", lambda u: ~before(u)).alias("b"))
    return out.select(
        "chosen_id", "rejected_id", "block", _joined(F.col("p")).alias("prompt"), _joined(F.col("a")).alias("chosen"), _joined(F.col("b")).alias("rejected"),
        _spans(F.col("a")).alias("chosen_spans"), _spans(F.col("b")).alias("rejected_spans"), F.size("p").cast("long").alias("common_turns"))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in pairs of equal openings, formatted; spans as text."""
    turns = common.stored(turns_of(common.table(spark, sf_dir, "conversations")), "turns")
    out = format_pairs(turns, pair_conversations(turns))
    return out.withColumns({"chosen_spans": _span_text("chosen_spans"), "rejected_spans": _span_text("rejected_spans")})


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, arg_min(role || chr(31) || text, turn) AS opening FROM t GROUP BY conv_id),
l AS (SELECT conv_id, lead(conv_id) OVER w AS nx, lag(conv_id) OVER w AS pv FROM f WINDOW w AS (PARTITION BY opening ORDER BY conv_id)),
p AS (SELECT conv_id AS chosen_id, nx AS rejected_id FROM l WHERE nx IS NOT NULL OR pv IS NULL),
s AS (SELECT chosen_id, rejected_id, 0 AS side, chosen_id AS conv_id FROM p UNION ALL SELECT chosen_id, rejected_id, 1, rejected_id FROM p WHERE rejected_id IS NOT NULL),
r AS (SELECT s.*, turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM s JOIN t USING (conv_id)),
m AS (SELECT coalesce(a.chosen_id, b.chosen_id) AS chosen_id, min(coalesce(a.turn, b.turn)) AS first
      FROM (SELECT * FROM r WHERE side = 0 AND rejected_id IS NOT NULL) a
      FULL JOIN (SELECT * FROM r WHERE side = 1) b ON a.chosen_id = b.chosen_id AND a.turn = b.turn
      WHERE a.line IS DISTINCT FROM b.line GROUP BY 1),
k AS (SELECT r.*, turn // 256 AS block, CASE WHEN m.first IS NULL OR turn < m.first THEN 'p' WHEN side = 0 THEN 'c' ELSE 'r' END AS part FROM r LEFT JOIN m USING (chosen_id)),
o AS (SELECT *, coalesce(sum(len(line)) OVER (PARTITION BY chosen_id, block, side, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(role) + 5 AS head FROM k),
z AS (SELECT *, CAST(CAST(head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(head + len(text) + 9 AS BIGINT) AS VARCHAR) AS span FROM o)
SELECT chosen_id, rejected_id, CAST(block AS BIGINT) AS block,
  coalesce(string_agg(line, '' ORDER BY turn, role, text) FILTER (WHERE part = 'p' AND side = 0), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY turn, role, text) FILTER (WHERE part = 'c'), '') AS chosen,
  coalesce(string_agg(line, '' ORDER BY turn, role, text) FILTER (WHERE part = 'r'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (WHERE part = 'c' AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (WHERE part = 'r' AND role = 'assistant'), '') AS rejected_spans,
  CAST(count(*) FILTER (WHERE part = 'p' AND side = 0) AS BIGINT) AS common_turns
FROM z GROUP BY chosen_id, rejected_id, block
"""
