"""Array columns as signals: decimation (W6), padding (W9), z-score (G14), trapezoid area (A16), means of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of a batch of rows that a task sends to Python: rows of long arrays are many bytes.
BATCH_BYTES = 8 << 20


def decimate(x: Column, step: int = 5) -> Column:
    """Every step-th element from the first, unless the array is no longer than step."""
    return F.when(F.size(x) > step, F.filter(x, lambda v, i: i % step == 0)).otherwise(x)


def pad(x: Column, n: int = 10) -> Column:
    """The first n elements, zeros after the last."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0).cast("double"), n)), 1, n)


def trapezoid(x: Column, fs: float = 1.0) -> Column:
    """Area under the samples; 0 for fewer than two."""
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: (a + b) / 2)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / fs


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Elementwise, or x as it is where there are no statistics."""
    scaled = F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), std, lambda v, s: v / s)
    return F.when(mean.isNull(), x).otherwise(scaled)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of the parts' numbers."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def _partial(keys: list[str]):
    """Counts, means and squared deviations by position of each key's arrays of a batch: a row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x")
            ends = x.offsets.to_numpy()
            flat = x.values.slice(ends[0], ends[-1] - ends[0])
            sizes = np.diff(ends)
            width = int(sizes.max(initial=0))
            if not width:
                continue
            inside = np.arange(width) < sizes[:, None]
            values, given = np.zeros(inside.shape), np.zeros(inside.shape, dtype=bool)
            given[inside] = flat.is_valid().to_numpy(zero_copy_only=False)
            values[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            code = batch.column("__key").dictionary_encode().indices.to_numpy()
            order = np.argsort(code, kind="stable")
            values, given, code = values[order], given[order], code[order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            n = np.add.reduceat(given, starts, axis=0, dtype=np.int64)
            mean = np.add.reduceat(values, starts, axis=0) / np.maximum(n, 1)
            off = np.where(given, values - mean[code], 0.0)
            off *= off
            m2 = np.add.reduceat(off, starts, axis=0)
            of_key = [np.flatnonzero(row)[-1] + 1 if row.any() else 0 for row in n > 0]  # without what is padded
            picked = batch.select([*keys, "__key"]).take(pa.array(order[starts]))
            cut = lambda m, to=of_key: lists([row[:k] for row, k in zip(m, to, strict=True)])
            yield pa.RecordBatch.from_arrays([*picked.columns, cut(n), cut(mean), cut(m2)], names=[*picked.schema.names, "__n", "__mean", "__m2"])

    return run


def _added(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    width = max(len(a[0]), len(b[0]))
    (n, mean, m2), (n_b, mean_b, m2_b) = ([np.concatenate([v, np.zeros(width - len(v), dtype=v.dtype)]) for v in s] for s in (a, b))
    total, apart = n + n_b, mean_b - mean
    share = n_b / np.maximum(total, 1)
    return total, mean + apart * share, m2 + m2_b + apart * apart * share * n


def _merged(keys: list[str], epsilon: float):
    """Rows of _partial in order of their keys to one row a key; only the sums of one key are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, held = None, None, None

        def result(picked: list[pa.RecordBatch], done: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            columns = [pa.concat_arrays([p.column(k) for p in picked]) for k in keys]
            std = [np.sqrt(m2[n > 0] / n[n > 0]) + epsilon for n, _, m2 in done]
            out = pa.RecordBatch.from_arrays([*columns, lists([mean[n > 0] for n, mean, _ in done]), lists(std)], names=[*keys, "mean", "std"])
            yield out.filter(pa.array([bool((n > 0).any()) for n, _, _ in done]))

        for batch in batches:
            at, rows, picked, done = batch.column("__n").offsets.to_numpy(), [], [], []
            parts = [batch.column(c).values.to_numpy() for c in ("__n", "__mean", "__m2")]
            for i, key in enumerate(batch.column("__key").to_pylist()):
                part = tuple(p[at[i] : at[i + 1]] for p in parts)
                if key == own:
                    sums = _added(sums, part)
                    continue
                if own is not None:
                    done.append(sums)
                    rows.append(i - 1)
                own, sums = key, part
            if rows and rows[0] < 0:
                picked, rows = [held], rows[1:]
            if done:
                yield from result([*picked, batch.take(pa.array(rows, pa.int64()))], done)
            if batch.num_rows:
                held = batch.slice(batch.num_rows - 1, 1)
        if own is not None:
            yield from result([held], [sums])

    return run


def array_stats(df: DataFrame, keys: list[str], col: str, epsilon: float = 1e-8) -> DataFrame:
    """Elementwise mean and population deviation plus epsilon (one row gives epsilon alone, Q14), over the elements that are not null.

    Whole arrays are added up: in each batch before the shuffle, then the batches' sums of a key one after another. Nothing collects a group's rows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.to_json(F.struct(*keys)).alias("__key"), F.col(col).cast("array<double>").alias("__x"))
    own = [rows.schema[k] for k in keys]
    numbers = lambda *names: [T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]
    sums = T.StructType([*own, rows.schema["__key"], T.StructField("__n", T.ArrayType(T.LongType())), *numbers("__mean", "__m2")])
    parts = rows.mapInArrow(_partial(keys), sums).repartition("__key").sortWithinPartitions("__key")
    return parts.mapInArrow(_merged(keys, epsilon), T.StructType([*own, *numbers("mean", "std")]))


def array_mean(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Elementwise mean over the rows of a key, as in array_stats."""
    return array_stats(df, keys, col).drop("std")
