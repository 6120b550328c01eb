"""Near-duplicates against a brute-force version."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, neardup
from beatloom.llm.components import components, contracted
from tests.conftest import SF


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_corner_cases(spark):
    words = [f"w{i}" for i in range(60)]
    near = words.copy()
    near[30] = "other"
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, " ".join(words)), (7, " ".join(near)), (8, " ".join(words).upper()), (9, "a b c d e f g h"), (10, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash")).withColumn("family", F.lit(1))
    assert result(df) == brute(rows)


def test_null_id_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, neardup.near_duplicates(df).select("component_id", "kept").collect())) == sorted(["Row(component_id=None, kept=True)", "Row(component_id=1, kept=True)"])
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_large_family_is_whole(spark):
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(700):
        w = base.copy()
        w[(i * 37) % 300] = f"v{i}"
        rows.append((i, " ".join(w)))
    out = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {c for _, c, _ in out.values()} == {0}


def varied(n, families, rng):
    """Texts of families in which each is an edit of another, so that some chains of links are long."""
    rows = []
    for f in range(families):
        texts = [[f"f{f}w{k}" for k in range(60)]]
        while len(texts) < n:
            w = texts[rng.integers(0, len(texts))].copy()
            for _ in range(rng.integers(1, 3)):
                w[rng.integers(0, 60)] = f"e{rng.integers(0, 1 << 30)}"
            texts.append(w)
        rows += [" ".join(t) for t in texts]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("docs", "small"), [(128, 16), (4, 2), (1, 1)])
def test_chains_of_links(spark, monkeypatch, docs, small):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", docs)
    monkeypatch.setattr(neardup, "MOST_SMALL_BLOCKS", small)
    monkeypatch.setattr(neardup, "LEADER_ROWS", docs)
    rows = varied(40, 6, np.random.default_rng(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert result(df) == want and len({c for _, c, _ in want.values()}) > 12


def test_repeated_ids_with_other_texts(spark):
    w = " ".join(f"w{i}" for i in range(50))
    rows = [(1, w), (1, None), (2, w + " x"), (2, ""), (3, w), (3, "quite another text of some words here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and all(r.component_id is not None for r in got)


def test_leaders_share_most_keys():
    keys = np.array([1, 1, 2, 2, 3, 3, 4, 4, 5])
    ids = np.array([9, 4, 9, 7, 9, 7, 4, 2, 8])
    first, edges, leaders = neardup._stars(keys, ids)
    assert sorted(ids[first].tolist()) == [2, 4, 7, 7, 8] and edges.tolist() == [[4, 2], [7, 2], [9, 2]] and leaders.tolist() == [[4, 2], [9, 7]]
    assert [len(x) for x in neardup._stars(np.array([1, 2]), np.array([5, 6]))] == [2, 0, 0]


@pytest.mark.parametrize("n", [1, 7, 40])
def test_roots(n):
    rng = np.random.default_rng(n)
    pairs = rng.integers(0, n, size=(n, 2))
    got = neardup._roots(n, pairs)
    want = np.arange(n)
    for _ in range(n):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
        want = want[want]
    assert (got == want).all()


@pytest.mark.parametrize("n", [1, 30, 400])
def test_components(spark, n):
    rng = np.random.default_rng(n)
    pairs = np.concatenate([rng.integers(0, n, size=(n // 2 + 1, 2)), [[0, 0]], np.array([[0, i] for i in range(n - n // 4, n)], dtype=int).reshape(-1, 2)])
    df = common.stored(spark.createDataFrame(pairs.tolist(), "a long, b long").withColumn("extra", F.lit(1)), "edges")
    root = neardup._roots(n, pairs)
    touched = {int(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r.id: r.component for r in components(df).collect()} == {i: int(root[i]) for i in touched}
    assert contracted(df).count() <= df.where("a <> b").count()


def test_sketch_estimate():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 64, size=4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 1 << 64, size=400, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None])[0, 0] - true) < 0.12
