"""Fingerprints against a plain LZ78 parse, over several ranges of ids."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, lzprint


def phrases(text):
    seen, now, ends = set(), "", []
    for i, c in enumerate(text, 1):
        now += c
        if now not in seen:
            seen.add(now)
            ends.append(i)
            now = ""
    return seen, ends


def printed(text):
    return lzprint.signature(lzprint.code_points(text), phrases(text)[1])


def plain(rows):
    """Results by (doc_id, text) in the falling order that the docstring names."""
    import zlib

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())), reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = (printed(x) for x in (t, e, after))
        like = lambda x, y: float(((x == y) & (x != 0)).sum() / ((x != 0) | (y != 0)).sum()) if ((x != 0) | (y != 0)).any() else 1.0
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in lzprint.fingerprints(df).collect()), key=str)


def texts(n):
    rng = np.random.default_rng(n)
    return ["".join(rng.choice(list("abc déⅣ𝄞"), size=rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("rows_a_range", "most"), [(1000, 20_000), (300, 20_000), (30, 20_000), (30, 7)])
def test_ranges(spark, monkeypatch, rows_a_range, most):
    monkeypatch.setattr(lzprint, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(lzprint, "MOST_RANGES", most)
    t = texts(3000)
    ids = [None if i % 5 == 0 else 77 if i % 5 == 1 else i * 3 - 4000 for i in range(3000)]  # a fifth without an id, a fifth with one and the same
    rows = list(zip(ids, t, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(df) == plain(rows)
    bounds = lzprint.ranges(df.select("doc_id"), rows_a_range, most)
    assert len(bounds) == max(0, min(most, 3000 // rows_a_range) - 1)
    d = lzprint.with_following(df).where("extra = 0").groupBy("range").count().collect()
    if rows_a_range == 30 and most > 7:
        assert len(d) > 64 and max(r["count"] for r in d) < 150


def test_ids_without_ties(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "RANGE_ROWS", 20)
    rows = [(i, t) for i, t in enumerate(texts(400))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_odd_rows(spark):
    for rows in ([(1, "only one")], [(1, None), (2, "")], [(3, "x" * 20_001), (3, "ab" * 9), (None, "end"), (2, "日本語"), (2, "日本語")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("range", "key", "extra", "top", "h")})
        assert result(df) == plain(rows)
        assert lzprint.fingerprints(df.limit(0)).count() == 0


def test_parse_by_halves():
    for t in texts(200) + ["", "a", "ab" * 300]:
        points = lzprint.code_points(t).tolist()
        at = len(points) // 3
        p = lzprint.Phrases().read(points[:at])
        assert p.copy().read(points[at:]).ends == p.read(points[at:]).ends == phrases(t)[1]


def test_likeness_follows_compression():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), size=5)) for _ in range(400)]
    a, b = " ".join(words), " ".join([*words[:360], *["zzzz"] * 40])
    other = " ".join("".join(rng.choice(list("stuvwxyz"), size=5)) for _ in range(400))
    like = lambda x, y: lzprint.likeness(printed(x), printed(y))
    assert like(a, a) == 1.0 and like(a, b) > 0.5 > like(a, other)
    assert common.mixed(np.arange(3, dtype=np.uint64)).shape == (3,)
