"""Virtual slots: sizes and places by a plain version, versions of the map, skew and odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, sharding
from tests.conftest import SF


def check(rows, texts, balance):
    """rows of (doc_id, size, text_crc32, shard, slot) against the ids and texts they came from."""
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(data(t)) + 1, zlib.crc32(data(t))) for i, t in texts)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(load) <= set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(load.values()) / 8
    assert not rows or max(load.values()) <= balance * mean


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = sharding.op1_virtual_slots(spark, SF).collect()
    check(rows, [tuple(r) for r in docs], 1.05)
    assert {r.map_version for r in rows} == {2} and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.virtual_slot].add(r.shard)
    assert all(len(s) == 1 for s in by_slot.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.pareto(1.1) * 20)) for i in range(3000)] + [(None, "same")] * 2000 + [(7, "again")] * 50 + [(8, None), (9, "日本語"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("place", "part", "shard", "slot", "n", "version")}).repartition(5)
    slotted = common.stored(sharding.with_slots(df), "slotted")
    sizes, counts = sharding.slot_histogram(slotted)
    path = common.new_path(spark, "map")
    check(sharding.shard_documents(df, 8, path).collect(), rows, 1.01)
    for part_rows in (1, 10_000):
        out = sharding.assign(slotted, sharding.load_map(spark, path).drop("spread"), sum(counts) * 4096 * 3, part_rows).collect()
        assert len(out) == len(rows)
        assert Counter((r.shard, r.slot) for r in out).most_common(1)[0][1] == 1
    assert sharding.shard_documents(df.limit(0), 8, common.new_path(spark, "map")).count() == 0


def test_calls_on_a_kept_map(spark):
    """New data and shard counts edit the map; no row is lost, slots keep their number, and only moved slots move."""
    docs = [(i, f"document {i} " * (i % 7 + 1)) for i in range(4000)]
    hot = [(7, f"copy {i} of a hot id") for i in range(1500)] + [(7, "the same again")] * 1500
    path = common.new_path(spark, "map")
    frame = lambda rows, parts: spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    slots, maps = {}, []
    for rows, n, versions, parts in ((docs[:1000], 8, 2, 3), (docs[:1000], 8, 2, 5), (docs, 8, 3, 2), (docs, 9, 4, 7), (docs + hot, 9, 5, 4), (docs, 5, 6, 3)):
        out = sharding.shard_documents(frame(rows, parts), n, path).collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
        stored = spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"), F.countDistinct("virtual_slot").alias("d")).collect()
        assert {r.version: (r.n, r.d) for r in stored} == {v: (sharding.N_SLOTS, sharding.N_SLOTS) for v in range(1, versions + 1)}
        now = sharding.read_map(spark, path)
        maps.append(now)
        load = Counter()
        for r in out:
            load[r.shard] += r["size"]
            assert now.shard_of[r.virtual_slot] == r.shard
            if r.doc_id != 7 and not now.spread:
                assert slots.setdefault(r.doc_id, r.virtual_slot) == r.virtual_slot
        if len(rows) > 1000:
            assert set(load) == set(range(n)) and max(load.values()) <= 1.001 * sum(load.values()) / n
    assert not maps[3].spread and len(maps[4].spread) == 1 and maps[5].spread == maps[4].spread
    assert sum(a != b for a, b in zip(maps[2].shard_of, maps[3].shard_of, strict=True)) < 1200


def test_spread_and_broken_maps(spark):
    assert sharding.too_full([5, 5, 900, 5], [1, 1, 1, 1], 1) == frozenset() and sharding.too_full([10] * 20, [10] * 20, 1) == frozenset()
    assert sharding.too_full([0, 640, 0], [0, 100, 0], 2) == {1} and sharding.too_full([0, 640, 0], [0, 100, 0], 2, frozenset([1])) == frozenset()
    path = common.new_path(spark, "map")
    sharding.store_map(spark, sharding.dealt(12, 3), path)
    with pytest.raises(ValueError, match="one row"):
        sharding.shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 3, path)


def test_versions(spark):
    rng = np.random.default_rng(1)
    sizes = (rng.pareto(1.5, size=sharding.N_SLOTS) * 1000).astype(int).tolist()
    path = common.new_path(spark, "map")
    first = sharding.dealt(sharding.N_SLOTS, 8)
    sharding.store_map(spark, first, path)
    assert sharding.read_map(spark, path) == first
    second = sharding.rebalanced(first, sizes)
    sharding.store_map(spark, second, path)
    third = sharding.rebalanced(sharding.read_map(spark, path), sizes, 9)
    sharding.store_map(spark, third, path)
    assert [sharding.read_map(spark, path, v).shard_of for v in (1, 2, 3)] == [x.shard_of for x in (first, second, third)]
    assert sharding.read_map(spark, path).version == 3
    for old, new, n in ((first, second, 8), (second, third, 9)):
        assert new.moved and set(new.moved) == {s for s in range(len(sizes)) if old.shard_of[s] != new.shard_of[s]}
        load = [sum(z for z, k in zip(sizes, new.shard_of, strict=True) if k == j) for j in range(n)]
        assert max(load) <= 1.002 * sum(sizes) / n
    assert len(second.moved) < 100 and len(third.moved) < 100 and any(third.shard_of[s] == 8 for s in third.moved)
    fewer = sharding.rebalanced(third, sizes, 5)
    assert set(fewer.shard_of) == set(range(5)) and fewer.version == 4


@pytest.mark.parametrize("sizes", [[], [0] * 16, [5], [100, 1, 1, 1], [3] * 17])
def test_small_maps(sizes):
    old = sharding.dealt(len(sizes), 4)
    new = sharding.rebalanced(old, sizes)
    load = lambda m: max([sum(z for z, k in zip(sizes, m.shard_of, strict=True) if k == j) for j in range(4)])
    assert load(new) <= load(old)
