"""The set join against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import groupjoin as gj
from tests.conftest import SF
from tests.llm.test_near import varied


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                a_root, b_root = sorted((find(i), find(j)))
                root[b_root] = a_root
    return sorted((i, len(s), find(i)) for i, s in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in gj.linked_classes(df).collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_corner_cases(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (6, " ".join(words)), (7, " ".join(near)), (8, " ".join(words).upper()), (9, "a b c d e f g h"), (10, "x " * 100_000)]
    rows += [(11, "a b c d e f g h i"), (12, "a b c"), (13, "1 2 3 4 5 6 7 8 9"), (14, "1 2 3 4 5 6 7 8 9 10")]
    df = frame(spark, rows).withColumn("sig", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("n", F.lit("x"))
    assert result(df) == brute(rows)


def test_null_and_repeated_ids(spark):
    w = " ".join(f"w{i}" for i in range(50))
    rows = [(None, w), (1, w), (1, None), (2, w + " x"), (2, ""), (3, w), (3, "quite another text of some words here"), (9, "quite another text of some words here")]
    got = gj.linked_classes(frame(spark, rows)).collect()
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["None"] and len(got) == len(rows)
    assert all(r.component_id in (1, 3, 9, 2) for r in got if r.doc_id is not None)
    assert gj.linked_classes(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("docs", "shingles", "queries"), [(64, 400_000, 256), (3, 150, 2), (1, 1, 1)])
def test_chains_of_links(spark, monkeypatch, docs, shingles, queries):
    monkeypatch.setattr(gj, "GROUP_DOCS", docs)
    monkeypatch.setattr(gj, "GROUP_SHINGLES", shingles)
    monkeypatch.setattr(gj, "SLAB_SHINGLES", 2 * shingles)
    monkeypatch.setattr(gj, "QUERY_ROWS", queries)
    rows = varied(40, 5, np.random.default_rng(docs + 7))
    want = brute(rows)
    assert result(frame(spark, rows)) == want and len({c for *_, c in want}) > 12


def test_shared_passages_and_lines(spark):
    """Documents that share most of their lines, with links of all sizes about the threshold."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"l{k}x{j}" for j in range(rng.integers(2, 9))) for k in range(40)]
    runs = [(int(rng.integers(0, 40)), int(rng.integers(3, 40))) for _ in range(300)]
    rows = [(i, "\n".join(lines[(start + k) % 40] for k in range(n))) for i, (start, n) in enumerate(runs)]
    want = brute(rows)
    assert result(frame(spark, rows)) == want and 20 < len({c for *_, c in want}) < 290


def test_first_shingles_find_every_link():
    """Of two sets that link, the larger's first shingles meet the smaller's."""
    rng = np.random.default_rng(5)
    classes = rng.integers(0, 5, size=1 << gj.HISTOGRAM_BITS).astype(np.uint8)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 1 << 64, size=n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 64, size=int(rng.integers(0, 4)), dtype=np.uint64)]))
        a, b = sorted((a, b), key=len)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            met += 1
            k = len(a) - -(-170 * len(a) // 185) + 1
            assert set(gj.first_shingles(a, classes)[:k]) & set(gj.first_shingles(b, classes))
            assert both >= gj.least_overlap(len(b))
    assert met > 500


def test_index_length(spark):
    rows = spark.range(1, 5000).select("id", gj.index_length(F.col("id")).alias("k")).collect()
    assert all(r.k == r.id - -(-170 * r.id // 185) + 1 for r in rows)


def test_bitmaps_bound_the_overlap():
    """Never below the overlap, whatever the widths of two bitmaps, and well below a link's for sets that have little in common."""
    rng = np.random.default_rng(6)
    excluded = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 64, size=int(rng.integers(1, 600)), dtype=np.uint64))
        others = [np.unique(np.concatenate([a[rng.random(len(a)) < p], rng.integers(0, 1 << 64, size=int(rng.integers(0, 300)), dtype=np.uint64)])) for p in (0.2, 0.6, 0.95, 1)]
        others = [b for b in others if len(b)]
        most = gj.Bitmaps([len(b) for b in others], [gj.bitmap(b) for b in others]).most_overlap(len(a), gj.bitmap(a))
        both = np.array([len(np.intersect1d(a, b)) for b in others])
        sizes = np.array([len(b) for b in others])
        assert (most >= both).all()
        may, link = gj.may_link(len(a), sizes, most), gj.may_link(len(a), sizes, both)
        assert not (link & ~may).any()
        excluded += int((~may[:2]).sum())
    assert excluded > 700


def test_unlike_documents_stay_closed(spark, monkeypatch):
    """Texts of documents that share rare shingles, but too few for a link, are not moved."""
    rng = np.random.default_rng(8)
    lines = [" ".join(f"l{k}x{j}" for j in range(40)) for k in range(30)]
    rows = [(i, "\n".join([*(lines[k] for k in rng.permutation(30)[:5]), " ".join(f"p{i // 2}x{j}" for j in range(10))])) for i in range(60)]
    opened, links = [], gj.links
    monkeypatch.setattr(gj, "links", lambda queries, members, texts: opened.append(queries.count()) or links(queries, members, texts))
    assert result(frame(spark, rows)) == brute(rows) and sum(opened) == 0
    near = [(100 + i, t.replace("l3x7 ", "other ")) for i, t in rows]
    assert result(frame(spark, rows + near)) == brute(rows + near)
