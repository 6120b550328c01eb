"""Media columns: texts as lossless WebP images, decoded to pixel arrays and features.

Work is done in Arrow batches, by a few rows together; there is no shuffle. Equal texts give equal values.

Cases: a null text is an empty payload, padded to one row of zeros like an empty one; texts of any length are stored
whole, over 8 KiB in several images; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored. A file that is cut short or is no lossless WebP raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, webp

MEDIA = "doc_id long, n_bytes long, media binary"
PIXELS = "doc_id long, height int, width int, pixels binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: UTF-8 bytes of texts, or of media, that are held in a task at once; a longer value is held alone.
HELD_BYTES = 4 << 20


def _by_rows(df: DataFrame, schema: str, size: Callable[[object], int], some: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """Rows of the schema from a few rows at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def frame(held: list) -> pd.DataFrame:
        out = pd.DataFrame(list(some(held)), columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, n = [], 0
            for row in batch.itertuples(index=False):
                held.append(row)
                n += size(row)
                if n >= HELD_BYTES:
                    yield frame(held)
                    held, n = [], 0
            if held:
                yield frame(held)

    return df.mapInPandas(run, schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as WebP."""

    def some(rows: list) -> Iterator[tuple]:
        data = [(row.text or "").encode() for row in rows]
        for row, d, stored in zip(rows, data, webp.store_many([webp.padded(d) for d in data]), strict=True):
            yield row.doc_id, len(d), stored

    return _by_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), MEDIA, lambda row: len(row.text or ""), some)


def to_pixels(media: DataFrame) -> DataFrame:
    """A pixel array, as bytes in the order red, green, blue, alpha, for every image of every media value."""

    def some(rows: list) -> Iterator[tuple]:
        for row, found in zip(rows, webp.images_many([bytes(row.media) for row in rows]), strict=True):
            for x in found:
                yield row.doc_id, *x.shape[:2], x.tobytes()

    return _by_rows(media.select("doc_id", "media"), PIXELS, lambda row: len(row.media), some)


def feature_of(px: np.ndarray) -> str:
    """Size, mean and spread of the samples, and the count of distinct ones."""
    counts = np.bincount(px.reshape(-1), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    mean = float(counts @ values) / n
    spread = float(counts @ (values * values)) / n - mean * mean
    return f"{px.shape[1]}x{px.shape[0]}:{mean:.4f}:{max(0.0, spread) ** 0.5:.4f}:{int((counts > 0).sum())}"


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, from the decoded pixels."""

    def some(rows: list) -> Iterator[tuple]:
        stored = [bytes(row.media) for row in rows]
        for row, media_bytes, found in zip(rows, stored, webp.images_many(stored), strict=True):
            px = np.concatenate(found)
            payload = px.tobytes()
            yield (
                row.doc_id, row.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), feature_of(px),
            )

    return _by_rows(media.select("doc_id", "n_bytes", "media"), DIGEST, lambda row: len(row.media), some)


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as WebP and read back."""
    return digests(to_media(common.table(spark, sf_dir, "documents")))
