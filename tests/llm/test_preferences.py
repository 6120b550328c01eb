"""Preference pairs against a plain version, with hot openings, odd rows and long conversations."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, preferences


def line(role, text):
    return f"<|{role}|>\n{text}\n<|end|>\n"


def plain(rows):
    """(chosen, rejected, prompt, chosen text, rejected text, trained texts of both) of (conv_id, turn, role, text) rows."""
    conv = defaultdict(set)
    for c, t, role, text in rows:
        if c is not None and t is not None:
            conv[c].add((t, role or "", text or ""))
    conv = {c: sorted(x) for c, x in conv.items()}
    openings = defaultdict(list)
    for c in sorted(conv):
        openings[conv[c][0][1:]].append(c)
    out = []
    for ids in openings.values():
        for a, b in zip(ids, ids[1:] or [None], strict=False):
            x, y = conv[a], conv.get(b, [])
            turns = lambda z: {n: [u for u in z if u[0] == n] for n in {u[0] for u in z}}
            p, q = turns(x), turns(y)
            first = min((n for n in p.keys() | q.keys() if p.get(n) != q.get(n)), default=None) if b is not None else None
            before = lambda u: first is None or u[0] < first  # noqa: B023, E731
            text = lambda z: "".join(line(r, t) for _, r, t in z)
            xa, ya = [u for u in x if not before(u)], [u for u in y if not before(u)]
            out.append((a, b, text([u for u in x if before(u)]), text(xa), text(ya), [t for _, r, t in xa if r == "assistant"], [t for _, r, t in ya if r == "assistant"]))
    return sorted(out, key=str)


def formatted(spark, rows, range_rows=preferences.RANGE_ROWS, block=preferences.BLOCK_TURNS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("side", "block", "range", "opening")})
    turns = common.stored(preferences.turns_of(df), "turns")
    got = preferences.format_pairs(turns, preferences.pair_conversations(turns, range_rows), block).orderBy("chosen_id", "block").collect()
    pairs = defaultdict(list)
    for r in got:
        pairs[r.chosen_id, r.rejected_id].append(r)
    trained = lambda r, c: [r[c][s.start : s.end].removesuffix("\n<|end|>\n") for s in r[f"{c}_spans"]]
    return sorted(((a, b, *["".join(r[c] for r in x) for c in ("prompt", "chosen", "rejected")], *[[t for r in x for t in trained(r, c)] for c in ("chosen", "rejected")]) for (a, b), x in pairs.items()), key=str)


def talk(i, opening, n=4):
    return [(i, k, "user" if k % 2 == 0 else "assistant", opening if k == 0 else f"turn {k} of {i if k > 1 else 'all'}") for k in range(n)]


ODD = [*talk(1, "hi"), *talk(2, "hi", 6), *talk(3, "other"), *talk(4, "hi"), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (6, 0, None, None), (6, 1, "assistant", None), (7, 0, None, None),
       (None, 0, "user", "hi"), (8, None, "user", "hi"), (9, 0, "user", "hi"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), *talk(4, "hi")]


@pytest.mark.parametrize("block", [2, 256])
def test_odd_rows(spark, block):
    assert formatted(spark, ODD, block=block) == plain(ODD)


def test_long_conversations(spark):
    rows = talk(1, "hi", 700) + [(i, t, r, "changed" if t == 650 else x.replace(" of 1", " of 1")) for i, t, r, x in [(2, *u[1:]) for u in talk(1, "hi", 700)]]
    assert formatted(spark, rows) == plain(rows)


@pytest.mark.parametrize("step", [1, 64])
def test_hot_opening_is_spread_and_whole(spark, step):
    rows = [(i * step, 0, "user", "hot" if i % 8 else f"rare {i % 16}") for i in range(1200)]
    turns = common.stored(preferences.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "turns")
    openings = defaultdict(list)
    for c, _, _, text in rows:
        openings[text].append(c)
    want = Counter((a, b) for ids in openings.values() for a, b in zip(sorted(ids), sorted(ids)[1:] or [None], strict=False))
    for n in (7, 100, 100_000):
        assert Counter(tuple(r) for r in preferences.pair_conversations(turns, n).collect()) == want
    cuts = preferences.id_ranges(turns, 100)
    assert len(cuts) >= 10
    sizes = Counter(sum(c <= i * step for c in cuts) for i in range(1200))
    assert max(sizes.values()) < 300


def test_empty(spark):
    assert formatted(spark, []) == []
