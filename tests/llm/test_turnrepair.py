"""Conversation repair against every way of editing, and in one piece against many."""

import functools
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import turnrepair as tr

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """What the contract says of rows (turn, role, text) of one conversation, from its definition."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], tr_order(r)))
    faults, seen = [], set()
    for _, r, x in rows:
        s = x.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    legal = lambda done: re.fullmatch("(s?(ua)+)?", done) is not None
    prefix = lambda done: re.fullmatch("s?(ua)*u?", done) is not None

    @functools.cache
    def best(i, done, inserted):
        out = []
        if i == len(rows) and legal(done):
            out.append((0, "", ()))
        if inserted < 2:
            for who in ("user", "assistant"):
                if prefix(done + who[0]):
                    c, a, t = best(i, done + who[0], inserted + 1)
                    out.append((c + 2, "I" + a, ((who, ""), *t)))
        if i < len(rows):
            _, r, x = rows[i]
            c, a, t = best(i + 1, done, 0)
            out.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 1 if faults[i] == "truncated" else 0
                for letter, who, cost in (("K", r, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if prefix(done + who[:1]) and who[:1]:
                        c, a, t = best(i + 1, done + who[0], 0)
                        out.append((c + cost + extra, letter + a, ((who, x), *t)))
        return min(out, default=(1 << 40, "", ()))

    cost, audit, turns = best(0, "", 0)
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    )


def tr_order(row):
    return hashlib.sha256(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()


def got(spark, rows):
    done = tr.repair(spark.createDataFrame(rows, SCHEMA).withColumn("piece", F.lit("clash")).withColumn("conv", F.lit(3)))
    out = done.report.join(tr.digests(done.turns), "conv", "left").collect()
    empty = hashlib.sha256().hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or empty) for r in out}


def random_rows(seed, conversations, most):
    rng = np.random.default_rng(seed)
    texts = ["Well.", "Yes!", "no end", "", " \t", "One? ", None, "x\n", "Well. ."]
    rows = []
    for c in range(conversations):
        turns = rng.choice([0, 1, 2, 3, 4, 5, 9], size=rng.integers(1, most + 1))
        rows += [(c, None if rng.random() < 0.1 else int(t), rng.choice(["system", "user", "assistant", "tool", "", "ua", None], p=[0.1, 0.33, 0.33, 0.1, 0.04, 0.05, 0.05]), texts[rng.integers(0, len(texts))]) for t in turns]
    return rows


def wanted(rows):
    by = {}
    for c, *row in rows:
        by.setdefault("" if c is None else f"={c}", []).append(tuple(row))
    return {c: plain(r) for c, r in by.items()}


def test_every_way_of_editing(spark):
    rows = random_rows(1, 120, 8) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]
    rows = [(c, t, None if r is None else str(r), x) for c, t, r, x in rows]
    assert got(spark, rows) == wanted(rows)


@pytest.mark.parametrize("piece_rows", [1, 3, 17])
def test_many_pieces(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(tr.ordered_rows, "__defaults__", (piece_rows,))
    monkeypatch.setattr(tr, "BLOCK_BYTES", 8)
    rng = np.random.default_rng(piece_rows)
    rows = [(7, i, str(rng.choice(["system", "user", "assistant"], p=[0.1, 0.45, 0.45])), f"Turn {i % 40}" + str(rng.choice([".", "", "!"]))) for i in range(60)]
    rows += [(7, 3, "user", "Turn 3.")] * 9 + [(8, 0, "user", "Alone.")]
    have = got(spark, rows)
    assert have == wanted(rows)


def test_damage_and_nothing_left(spark):
    rows = [(i, t, r, x) for i in range(40) for t, r, x in [(0, "user", "Hello there. Sir!"), (1, "assistant", "Hm.")]] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    import zlib

    want = []
    for i, t, r, x in rows:
        key = f"{' ' if i is None else i}:{' ' if t is None else t}"
        f = zlib.crc32(key.encode()) % 20
        r, x = r or " ", x or " "
        row = (i, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)
        want += [] if f == 0 else [row, row] if f == 3 else [row]
    assert sorted(map(str, map(tuple, tr.damaged(df).collect()))) == sorted(map(str, want))
    empty = tr.repair(df.limit(0))
    assert empty.report.count() == 0 and tr.digests(empty.turns).count() == 0


def test_only_faults_leaves_nothing(spark):
    rows = [(1, 0, "user", " "), (1, 1, "assistant", "")]
    assert got(spark, rows) == {"=1": (0, 2, 0, 0, 0, 6, "DD", hashlib.sha256().hexdigest())}


def test_turns_of_the_repair(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "")]
    done = tr.repair(spark.createDataFrame(rows, SCHEMA))
    assert [(r.edit, r.role, r.text) for r in done.turns.orderBy("piece", "place").collect()] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello.")]
