"""Lempel-Ziv phrase fingerprints.

A text is parsed as LZ78 does: each phrase is the shortest run of code points that is no phrase yet. The set of
phrase hashes is condensed to a one-permutation minimum-hash signature of BINS bins; the likeness of two
fingerprints is the share of equal bins among those that either has filled, an estimate of the phrase sets' Jaccard
similarity, which grows as one text helps to compress the other.

Neighbours by id are found without a global sort in one task: ids are cut into ranges at quantiles, a bounded number of them. An
id that fills several ranges (null counts as one) is cut further by its texts' checksums. Each range is sorted in one partition
of as many as there are ranges, and the first row of each range is also sent, marked, to the end of the range before it. Texts
are shuffled once and streamed; a task holds two texts. Counts and quantiles read ids alone, unless an id fills several ranges.

Cases: null text is empty; an empty text has an empty fingerprint (all bins unfilled), and two empty fingerprints have
likeness 1; ids that tie or repeat are ordered by the text's checksum, falling; null ids come last; a single document is its own
neighbour; an empty table gives an empty result; extra columns are ignored. Whole texts are parsed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS = 128
#: Rows of a range, and the largest number of ranges.
RANGE_ROWS, MOST_RANGES = 1000, 20_000
_SPANS = common.SpanHashes()
_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


class Phrases:
    """The dictionary of a parse: a phrase's number plus a code point gives the longer phrase's number."""

    def __init__(self) -> None:
        self.longer: dict[int, int] = {}
        self.ends: list[int] = []
        self.at, self.node = 0, 0

    def copy(self) -> Phrases:
        other = Phrases()
        other.longer, other.ends, other.at, other.node = self.longer.copy(), self.ends.copy(), self.at, self.node
        return other

    def read(self, points: list[int]) -> Phrases:
        """Parses on with the next code points."""
        longer, node, end_of = self.longer, self.node, self.ends.append
        get = longer.get
        new = (len(longer) + 1) << 21
        for i, c in enumerate(points, self.at + 1):
            key = node + c
            node = get(key)
            if node is None:
                longer[key] = new
                new += 1 << 21
                end_of(i)
                node = 0
        self.node = node
        self.at += len(points)
        return self


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def signature(points: np.ndarray, ends: list[int]) -> np.ndarray:
    """Per bin, 16 bits of the least hash of the phrases that fall into it, 0 if there are none."""
    out = np.zeros(BINS, dtype=np.uint16)
    if ends:
        stop = np.array(ends)
        x = _SPANS(common.mixed(points.astype(np.uint64)), np.concatenate([[0], stop[:-1]]), stop)
        x.sort()
        at = np.searchsorted(x, _BIN_STARTS)
        at = at[(at < len(x)) & (np.append(at[1:], len(x)) > at)]
        out[(x[at] >> np.uint64(57)).astype(np.int64)] = ((x[at] & np.uint64(0xFFFF)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = int(((a != 0) | (b != 0)).sum())
    return 1.0 if not filled else float(((a == b) & (a != 0)).sum()) / filled


def fingerprint(text: str | None) -> str:
    points = code_points(text or "")
    return signature(points, Phrases().read(points.tolist()).ends).astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> tuple[str, str]:
    """The part of a text that stays, and what replaces its last floor(n / 2) code points."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: What a null id is sorted as, below all others.
LEAST = -(1 << 63)


def ranges(ids: DataFrame, rows: int, most: int) -> list[tuple[int, int]]:
    """Rising lower bounds (id, checksum) of all ranges but the lowest; `most` ranges at most, about `rows` rows each."""
    k = min(most, ids.count() // rows)
    if k < 2:
        return []
    quantiles = F.percentile_approx(F.coalesce("doc_id", F.lit(LEAST)), [i / k for i in range(1, k)], max(10_000, 10 * k))
    times = Counter(ids.agg(quantiles.alias("q")).first()["q"] or [])
    return sorted((v, (j << 32) // n) for v, n in times.items() for j in range(n))


def _rank(bounds: list[int], kind: str, key: Column) -> Column:
    """How many of the rising bounds are at most the key, by binary search in a constant array."""
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>")

    def step(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        mid = F.floor((low + high) / 2).cast("int")
        below = (low < high) & (F.get(array, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(low).alias("low"), F.when((low < high) & ~below, mid).otherwise(high).alias("high"))

    zero = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), zero, step)["low"]


def with_following(docs: DataFrame) -> DataFrame:
    """doc_id, text, range and extra, partitioned and sorted so that each row's successor by falling id is the next row.

    Rows with `extra` are copies of the first row of the next range, which end each range.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = ranges(d.select("doc_id"), RANGE_ROWS, MOST_RANGES)
    heavy = len({v for v, _ in bounds}) < len(bounds)
    key, check = F.coalesce("doc_id", F.lit(LEAST)), F.crc32(F.col("text").cast("binary"))
    kind = "decimal(38,0)" if heavy else "bigint"
    if heavy:  # the checksum is part of the key only where an id fills more than one range
        key = (key.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + check.cast("decimal(11,0)")).cast(kind)
    values = [(v << 32) + c if heavy else v for v, c in bounds]
    # range 0 has the largest ids
    at = (F.lit(len(values)) - _rank(values, kind, key)).cast("int") if values else F.lit(0)
    d = d.withColumn("key", key).withColumn("range", at)
    tops = sorted((r["range"], str(r["top"])) for r in d.groupBy("range").agg(F.max("key").alias("top")).collect())  # a row a range
    if not tops:
        return d.withColumn("extra", F.lit(0)).drop("key")
    # the first row of each range goes to the end of the one before; the first of all to the end of the last
    goes = [(*tops[(i + 1) % len(tops)], own) for i, (own, _) in enumerate(tops)]
    goes = spark.createDataFrame(goes, "range int, top string, to_range int").withColumn("top", F.col("top").cast(kind))
    heads = d.join(F.broadcast(goes), (d["range"] == goes["range"]) & (F.col("key") == F.col("top")))
    heads = heads.groupBy("to_range").agg(F.max_by(F.struct("doc_id", "text"), check).alias("h"))
    heads = heads.select("h.doc_id", "h.text", F.col("to_range").alias("range"), F.lit(1).alias("extra"))
    rows = d.drop("key").withColumn("extra", F.lit(0)).unionByName(heads)
    rows = rows.repartition(len(tops), "range")
    return rows.sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), check.desc())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses."""
    rows = with_following(docs)

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its successor
        for batch in batches:
            out = []
            for doc_id, text, at, extra in zip(batch["doc_id"], batch["text"], batch["range"], batch["extra"], strict=True):
                points = code_points(text)
                codes = points.tolist()
                keep = len(codes) - len(codes) // 2
                phrases = Phrases().read(codes[:keep])
                half = None if extra else phrases.copy()
                sig = signature(points, phrases.read(codes[keep:]).ends)
                if held is not None and held[4] == at:
                    h_id, h_text, h_sig, h_half, _ = held
                    e_text = "".join(edited(h_text, text))
                    e_points = code_points(e_text)
                    e_sig = signature(e_points, h_half.read(e_points[h_half.at :].tolist()).ends)
                    out.append((h_id, len(h_text), hashlib.sha256(e_text.encode()).hexdigest(), h_sig.astype(">u2").tobytes().hex(), e_sig.astype(">u2").tobytes().hex(), likeness(h_sig, e_sig), likeness(h_sig, sig)))
                held = None if extra else (doc_id, text, sig, half, at)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, OUT)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
