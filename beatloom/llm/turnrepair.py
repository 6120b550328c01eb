"""Conversation structure repair by cost-to-go.

A conversation's rows, in order, are brought to the grammar `(s?(ua)+)?` of role initials by the cheapest edits: Keep, Rerole,
Delete, Insert. Costs to go are found backward, over places and the grammar's four states; a walk forward then takes, at each
place, the ASCII-least edit among those that keep to the cost to go. As each edit leads from a state to one state only, that walk
is the ASCII-least audit of all cheapest ones, and it says which turns to rebuild.

Spread: rows are dealt out in ranges of (conversation, turn), so a conversation of a third of all rows lies in many
pieces of about PIECE_ROWS rows. A piece's costs are a table of 4 by 4 (from its first state to its last), these are composed
from the last piece to the first, a row a piece, and each piece is then walked alone, from each of the states it may start in; the states are
followed from piece to piece. A conversation in one piece takes none of these steps. What no plan can cut is the hash of a
conversation's text: pieces are joined to blocks of BLOCK_BYTES first, and one task reads a conversation's blocks one at a time.
Copies of a row are found by digest, aggregated before the shuffle, so a text repeated very often is a row a task.

Cases: in a null role or text there is one space; rows with a null conversation are one conversation; null turns come first; rows of equal turn
are in order of role, text and place in the input (copies are equal, so results do not depend on it); a conversation
without rows has no row in the report; an empty table gives empty results; other columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PIECE_ROWS, BLOCK_BYTES = 100_000, 1 << 20

#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, DONE = range(4)
#: Classes of role initials, and faults.
ROLES = "sua"
OTHER = len(ROLES)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
_NEVER = 1 << 40
_AFTER = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): DONE, (DONE, 1): USER}
#: Where an empty or renamed turn leads, and whose it is.
_WANTED = (USER, USER, DONE, USER)
_SPEAKER = ("user", "user", "assistant", "user")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def symbol(role: int, fault: int) -> str:
    """A letter for a class of role and a fault."""
    return chr(65 + 4 * role + fault)


def _edits(role: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state, the edits that use up a row: letter, cost, next state; in ASCII order."""
    out = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if fault in (FINE, TRUNCATED):
            extra = UNFINISHED if fault == TRUNCATED else 0
            if (state, role) in _AFTER:
                own.append(("K", KEEP + extra, _AFTER[state, role]))
            own.append(("R", REROLE + extra, _WANTED[state]))
        out.append(own)
    return out


_EDITS = {symbol(r, f): _edits(r, f) for r in range(OTHER + 1) for f in range(4)}


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to go when turns may be put in first; two in a row are the most that can help."""
    out = [*costs]
    out[USER] = min(costs[USER], INSERT + costs[DONE])
    out[DONE] = min(costs[DONE], INSERT + costs[USER])
    for state in (START, SYSTEM):
        out[state] = min(costs[state], INSERT + out[USER])
    return out


END = _with_inserts([0, _NEVER, _NEVER, 0])


def costs_to_go(symbols: str, after: list[int]) -> list[list[int]]:
    """At each place, the last one behind all rows, the least cost from each state; after: the costs behind the rows."""
    out = [after]
    for s in reversed(symbols):
        after = _with_inserts([min(cost + after[to] for _, cost, to in own) for own in _EDITS[s]])
        out.append(after)
    return out[::-1]


def walk(symbols: str, costs: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits that keep to the costs to go, from a state, and the state they end in. Turns behind all rows are put in by the last piece."""
    audit = []
    for i, s in enumerate(symbols):
        while True:
            here, there = costs[i], costs[i + 1]
            delete, *others = _EDITS[s][state]
            tight = next((e for e in [delete] if e[1] + there[e[2]] == here[state]), None)
            if tight is None and INSERT + here[_WANTED[state]] == here[state]:
                audit.append("I")
                state = _WANTED[state]
                continue
            letter, _, state = tight or next(e for e in others if e[1] + there[e[2]] == here[state])
            audit.append(letter)
            break
    while last and state not in (START, DONE):
        audit.append("I")
        state = _WANTED[state]
    return "".join(audit), state


def illegal(symbols: str) -> int:
    """Neighbours whose roles may not follow one another."""
    roles = [(ord(s) - 65) // 4 for s in symbols]
    return sum(pair not in _LEGAL for pair in zip(roles, roles[1:], strict=False))


@dataclass(frozen=True)
class Repair:
    """report: a row a conversation, with its key conv. turns: the repaired turns, in conv, piece and place; each partition sorted by these."""

    report: DataFrame
    turns: DataFrame


def conversation_key(conv_id: Column) -> Column:
    """A text that names a conversation, null too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered_rows(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Stored rows in ranges: conv, turn, role, text, place (ascending through all pieces), piece, role class, fault but for duplicates, digest."""
    spark = turns.sparkSession
    rows = turns.select(
        conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    rows = rows.withColumn("input_place", F.monotonically_increasing_id())
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // piece_rows))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "input_place"]
    rows = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    rows = rows.withColumns({
        "piece": F.shiftright("place", 33).cast("int"),
        "role_class": F.coalesce(*[F.when(initial == r, F.lit(k)) for k, r in enumerate(ROLES)], F.lit(OTHER)),
        "fault": F.when(last == "", F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(TRUNCATED)),
    })
    return common.stored(rows.drop("input_place"), "ordered-turns")


def pieces_of(rows: DataFrame) -> DataFrame:
    """Stored pieces of conversations: conv, piece, symbols, pieces (of the conversation), before (the symbol before, if any), blank, duplicate, truncated.

    The first row of each role and text of a conversation is no duplicate; it is known by its place.
    """
    first = rows.groupBy("conv", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    own = rows.select("conv", "piece", "place", "role_class", "fault").join(first, "place", "left")
    fault = F.when(F.col("first").isNull() & (F.col("fault") != BLANK), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    own = own.withColumn("fault", fault)
    letter = F.char(65 + 4 * F.col("role_class") + F.col("fault"))
    counts = [F.sum((F.col("fault") == k).cast("long")).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    out = own.groupBy("conv", "piece").agg(F.sort_array(F.collect_list(F.struct("place", letter.alias("s")))).alias("rows"), *counts)
    out = out.withColumn("symbols", F.array_join(F.transform("rows", lambda r: r["s"]), "")).drop("rows")
    w = W.partitionBy("conv")
    before = F.lag(F.right("symbols", F.lit(1)), 1, "").over(w.orderBy("piece"))
    return common.stored(out.withColumns({"pieces": F.count("*").over(w), "before": before}), "turn-pieces")


SOLVED = "conv string, piece int, audit string, state int, cost long, illegal long"


def _solved_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations of one piece."""
    for batch in batches:
        rows = []
        for conv, piece, symbols in zip(batch["conv"], batch["piece"], batch["symbols"], strict=True):
            costs = costs_to_go(symbols, END)
            rows.append((conv, piece, walk(symbols, costs, START, True)[0], START, costs[0][START], illegal(symbols)))
        yield pd.DataFrame(rows, columns=["conv", "piece", "audit", "state", "cost", "illegal"])


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces' costs from each state (rows) to each state (columns)."""
    unit = [[0 if a == b else _NEVER for b in range(4)] for a in range(4)]
    for batch in batches:
        out = batch[["conv", "piece"]].copy()
        out["table"] = [[c for end in unit for c in costs_to_go(s, end)[0]] for s in batch["symbols"]]
        yield out


def _behind(pieces: pd.DataFrame) -> pd.DataFrame:
    """The costs to go behind each piece of a conversation, and before it from the start; a row a piece."""
    pieces = pieces.sort_values("piece", ascending=False)
    after, rows = END, []
    for conv, piece, table in zip(pieces["conv"], pieces["piece"], pieces["table"], strict=True):
        before = [min(table[4 * end + state] + after[end] for end in range(4)) for state in range(4)]
        rows.append((conv, piece, after, not rows, before[START]))
        after = before
    return pd.DataFrame(rows, columns=["conv", "piece", "after", "last", "cost"])


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces walked from each state."""
    for batch in batches:
        rows = []
        for conv, piece, symbols, before, after, last, cost in zip(*[batch[c] for c in ("conv", "piece", "symbols", "before", "after", "last", "cost")], strict=True):
            costs = costs_to_go(symbols, [int(x) for x in after])
            ways = [walk(symbols, costs, state, last) for state in range(4)]
            rows.append((conv, piece, [a for a, _ in ways], [s for _, s in ways], cost, illegal(before + symbols)))
        yield pd.DataFrame(rows, columns=["conv", "piece", "audits", "ends", "cost", "illegal"])


def _followed(pieces: pd.DataFrame) -> pd.DataFrame:
    """The way through a conversation's pieces that is really taken."""
    pieces = pieces.sort_values("piece")
    state, rows = START, []
    for conv, piece, audits, ends, cost, bad in zip(*[pieces[c] for c in ("conv", "piece", "audits", "ends", "cost", "illegal")], strict=True):
        rows.append((conv, piece, audits[state], state, cost if not rows else 0, bad))
        state = int(ends[state])
    return pd.DataFrame(rows, columns=["conv", "piece", "audit", "state", "cost", "illegal"])


def solved(pieces: DataFrame) -> DataFrame:
    """Stored: conv, piece, audit, state (at the piece's start), cost (of the conversation, at its first piece), illegal."""
    whole = pieces.where("pieces = 1").mapInPandas(common.in_task(_solved_whole), SOLVED)
    cut = pieces.where("pieces > 1")
    behind = cut.mapInPandas(common.in_task(_tables), "conv string, piece int, table array<long>")
    behind = behind.groupBy("conv").applyInPandas(_behind, "conv string, piece int, after array<long>, last boolean, cost long")
    ways = cut.select("conv", "piece", "symbols", "before").join(behind, ["conv", "piece"])
    ways = ways.mapInPandas(common.in_task(_walks), "conv string, piece int, audits array<string>, ends array<int>, cost long, illegal long")
    return common.stored(whole.unionAll(ways.groupBy("conv").applyInPandas(_followed, SOLVED)), "turn-audits")


TURNS = "conv string, piece int, place long, edit string, role string, text string"


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired turns; of each piece the first row holds the audit, and the others come in order."""
    audit, at, state = "", 0, START
    for batch in batches:
        out = []
        for conv, piece, place, role, text, start in zip(*[batch[c] for c in ("conv", "piece", "place", "role", "text", "state")], strict=True):
            if place < 0:
                audit, at, state = text, 0, int(start)
            else:
                edit = audit[at]
                if edit != "D":
                    state, role = (_AFTER[state, ROLES.index(role[0])], role) if edit == "K" else (_WANTED[state], _SPEAKER[state])
                    out.append((conv, piece, place, edit, role, text))
                at += 1
            while audit[at : at + 1] == "I":
                out.append((conv, piece, place, "I", _SPEAKER[state], ""))
                state = _WANTED[state]
                at += 1
        yield pd.DataFrame(out, columns=["conv", "piece", "place", "edit", "role", "text"])


def rebuilt(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Turns after the repair: conv, piece, place (of the row that a turn is or follows), edit, role, text."""
    first = audits.select("conv", "piece", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"), "state")
    own = rows.select("conv", "piece", "place", "role", "text", F.lit(None).cast("int").alias("state"))
    both = own.unionByName(first).repartition("conv", "piece").sortWithinPartitions("conv", "piece", "place")
    return both.mapInPandas(common.in_task(_rebuilt), TURNS)


def repair(turns: DataFrame) -> Repair:
    """Repairs conversations of conv_id, turn, role, text."""
    rows = ordered_rows(turns)
    pieces = pieces_of(rows)
    audits = solved(pieces)
    n_turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(n_turns, F.lit(0)).alias("gaps"))
    counts = pieces.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    parts = F.sort_array(F.collect_list(F.struct("piece", "audit")))
    found = audits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    return Repair(gaps.join(counts, "conv").join(found, "conv"), rebuilt(rows, audits))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns as lines, joined to blocks within a piece; each line has its newline in front."""
    own, block, data, size = None, 0, [], 0
    for batch in batches:
        out = []
        for conv, piece, role, text in zip(batch["conv"], batch["piece"], batch["role"], batch["text"], strict=True):
            if data and ((conv, piece) != own or size >= BLOCK_BYTES):
                out.append((*own, block, b"".join(data)))
                data, size, block = [], 0, block + 1
            if (conv, piece) != own:
                own, block = (conv, piece), 0
            line = f"\n{role}:{text}".encode()
            data.append(line)
            size += len(line)
        yield pd.DataFrame(out, columns=["conv", "piece", "block", "data"])
    if data:
        yield pd.DataFrame([(*own, block, b"".join(data))], columns=["conv", "piece", "block", "data"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own, digest = None, None
    for batch in batches:
        out = []
        for conv, data in zip(batch["conv"], batch["data"], strict=True):
            if conv != own:
                if own is not None:
                    out.append((own, digest.hexdigest()))
                own, digest, data = conv, hashlib.sha256(), data[1:]
            digest.update(data)
        yield pd.DataFrame(out, columns=["conv", "sha256"])
    if own is not None:
        yield pd.DataFrame([(own, digest.hexdigest())], columns=["conv", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of the lines `role:text` of every conversation that has turns left. turns: as repair() gives them."""
    blocks = turns.mapInPandas(common.in_task(_blocks), "conv string, piece int, block int, data binary")
    return blocks.repartition("conv").sortWithinPartitions("conv", "piece", "block").mapInPandas(common.in_task(_hashed), "conv string, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the query plants, by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, F.lit("")).when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("f") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired, a row a conversation."""
    conversations = common.table(spark, sf_dir, "conversations")
    done = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    out = every.join(done.report, "conv", "left").join(digests(done.turns), "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


#: Forward over places and states, keeping the least cost and audit of each: another way to the same repairs.
OP11_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS f FROM k),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE f <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, lag(role[1:1]) OVER w AS pr,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS fin, regexp_matches(text, '[^\x20\x09-\x0D]') AS full_text FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, role[1:1] AS c, CASE WHEN NOT full_text THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
n(a, ins, cost, b, said) AS (VALUES (0, '', 0, 0, ''), (1, '', 0, 1, ''), (2, '', 0, 2, ''), (3, '', 0, 3, ''), (0, 'I', 2, 2, chr(10) || 'user:'), (1, 'I', 2, 2, chr(10) || 'user:'), (2, 'I', 2, 3, chr(10) || 'assistant:'),
        (3, 'I', 2, 2, chr(10) || 'user:'), (0, 'II', 4, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 4, 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
e(a, c, ed, cost, b) AS (VALUES (0, '*', 'D', 3, 0), (1, '*', 'D', 3, 1), (2, '*', 'D', 3, 2), (3, '*', 'D', 3, 3), (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2),
        (0, '*', 'R', 2, 2), (1, '*', 'R', 2, 2), (2, '*', 'R', 2, 3), (3, '*', 'R', 2, 2)),
z AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '000000000' AS v, '' AS said FROM z
  UNION ALL
  SELECT conv_id, i, q, min(v) AS v, arg_min(said, v) AS said FROM (
    SELECT w.conv_id, r.i, e.b AS q, lpad(CAST(CAST(w.v[1:9] AS INT) + n.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.ed <> 'D' THEN 1 ELSE 0 END AS VARCHAR), 9, '0') || w.v[10:] || n.ins || e.ed AS v,
      w.said || n.said || CASE e.ed WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE WHEN n.b = 2 THEN 'assistant' ELSE 'user' END || ':' || r.text END AS said
    FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN n ON n.a = w.q
    JOIN e ON e.a = n.b AND (e.c = '*' OR e.c = r.c) AND (e.ed = 'D' OR r.fault NOT IN ('blank', 'duplicate'))) s GROUP BY conv_id, i, q),
b AS (SELECT w.conv_id, min(lpad(CAST(CAST(w.v[1:9] AS INT) + n.cost AS VARCHAR), 9, '0') || w.v[10:] || n.ins) AS v,
        arg_min(w.said || n.said, lpad(CAST(CAST(w.v[1:9] AS INT) + n.cost AS VARCHAR), 9, '0') || w.v[10:] || n.ins) AS said
      FROM w JOIN z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.i = z.n JOIN n ON n.a = w.q WHERE n.b IN (0, 3) GROUP BY w.conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pr IS NOT NULL AND pr || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(v[1:9] AS BIGINT), 0) AS cost, coalesce(v[10:], '') AS audit, sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
"""
