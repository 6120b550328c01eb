"""G1, G2 on recordings in chunks: a zero-phase recursive filter whose state passes from chunk to chunk.

A chunk maps the filter's state at its start to the one at its end: a power of the filter's matrix, by the chunk's length, and a vector
that its samples give. Such maps are composed in order, first inside runs of chunks, then over a recording's runs, so that every chunk
gets the state that a filter of the whole recording has there. The backward pass needs no second look at the samples:
its maps follow from the same chunk and the forward state. Chunks are written to the shared folder first, as the ends, the maps and the output
read them: what they come from is worked out once. Tasks filter chunks of equal length together, TOGETHER samples at a time. What is
shuffled for the scans is a row a chunk of two short vectors, sorted and streamed, so no task holds more than a batch of chunks.
The composed maps are written to the shared folder, as they are read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import kernels
from ..sources import brainvision

#: Chunks of which one task composes the maps.
RUN = 4096
#: Samples of chunks that are filtered together.
TOGETHER = 1 << 16


def _alike(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of chunks of equal length, and the places of their samples in all chunks' samples, a row a chunk."""
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        places, step = np.flatnonzero(sizes == size), max(TOGETHER // max(size, 1), 1)
        for own in (places[k : k + step] for k in range(0, len(places), step)):
            yield own, starts[own, None] + np.arange(size)


def _numbers(lists: pa.ListArray) -> np.ndarray:
    """All numbers of lists, one list after another; nulls are NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def _doubles(x: np.ndarray) -> pa.Array:
    """NaN, which a null makes of what follows it, is null again."""
    return pa.array(x, pa.float64(), from_pandas=True)


def _lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _doubles(flat))


def _rows(x: np.ndarray) -> pa.ListArray:
    return _lists(np.full(len(x), x.shape[1]), x.ravel())


def _moved(coefficients: bytes, n: pa.Array, z: np.ndarray) -> np.ndarray:
    """The states z, a row each, after n steps each without input."""
    steps, of = np.unique(n.to_numpy(), return_inverse=True)
    powers = np.array([kernels.state_power(coefficients, k) for k in steps.tolist()]).reshape(-1, z.shape[1], z.shape[1])
    return np.einsum("kij,kj->ki", powers[of], z)


def _edges(chunks: DataFrame, keys: list[str], chunk: int, pad: int) -> DataFrame:
    """keys, chunk_idx, samples: the odd extension of each recording of more than `pad` samples, as a chunk before its first and one after its last."""
    total = chunks.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n")).where(F.col("n") > pad)
    ends = total.withColumn("chunk_idx", F.explode(F.array_union(
        F.sequence(F.lit(0), F.floor(F.lit(pad) / chunk)), F.sequence(F.floor((F.col("n") - pad - 1) / chunk), F.floor((F.col("n") - 1) / chunk)))))
    near = ends.join(chunks.select(*keys, "chunk_idx", "samples"), [*keys, "chunk_idx"])
    # of each chunk, what lies among the recording's first and last pad + 1 places
    first, last = F.lit(pad + 1) - F.col("chunk_idx") * chunk, F.col("n") - pad - 1 - F.col("chunk_idx") * chunk
    head = F.slice("samples", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    tail = F.slice("samples", (F.greatest(last, F.lit(0)) + 1).cast("int"), F.size("samples"))
    whole = lambda x: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", x.alias("v")))), lambda p: p["v"]))
    g = near.groupBy(*keys, "n").agg(whole(head).alias("h"), whole(tail).alias("t"))
    left = F.transform(F.reverse(F.slice("h", 2, pad)), lambda x: 2 * F.col("h")[0] - x)
    right = F.transform(F.reverse(F.slice("t", 1, pad)), lambda x: 2 * F.col("t")[pad] - x)
    both = F.array(F.struct(F.lit(-1).cast("long").alias("chunk_idx"), left.alias("samples")), F.struct(F.ceil(F.col("n") / chunk).alias("chunk_idx"), right.alias("samples")))
    return g.select(*keys, F.explode(both).alias("e")).select(*keys, "e.chunk_idx", "e.samples")


def scan(maps: DataFrame, keys: list[str], coefficients: bytes, steady: np.ndarray, keep: dict[str, str], whole: bool = False) -> DataFrame:
    """keys, at, the columns of `keep` and state: the state before each map, in order of `at`.

    maps: keys, at long, n long, s array<double>, first double and those of `keep` (name to type). A map takes z to n steps of the filter without input, plus s;
    a key starts from steady * first, of its first map. With `whole`, only keys that have a map before 0 are scanned.
    """
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema if f.name in keys}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    more = "".join(f", `{k}` {v}" for k, v in keep.items())
    inner = f"{head}run long, at long{more}, first double, done long, moved array<double>"
    zero, dim = np.zeros(len(steady)), len(steady)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a run's maps in order: what the run did before each, and, in a row without `at`, what it does as a whole
        own, first, n, z, key_types, kept_types = None, None, 0, zero, [], []

        def wholes(ended: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([e[i] for e in ended], t) for i, t in enumerate(key_types)]
            nothing = [pa.nulls(len(ended), t) for t in kept_types]
            first, done = pa.array([e[-3] for e in ended], pa.float64()), pa.array([e[-2] for e in ended], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, *nothing, first, done, _rows(np.array([e[-1] for e in ended]).reshape(-1, dim))], names=names)

        names = [*keys, "run", "at", *keep, "first", "done", "moved"]
        for g in batches:
            key_columns, kept = [g.column(k) for k in [*keys, "run"]], [g.column(k) for k in ["at", *keep]]
            key_types, kept_types, ended = [c.type for c in key_columns], [c.type for c in kept], []
            done, moved, s = np.zeros(g.num_rows, dtype=np.int64), np.zeros((g.num_rows, dim)), _numbers(g.column("s")).reshape(-1, dim)
            starts, sizes = g.column("first").to_pylist(), g.column("n_own").to_pylist()
            for i, key in enumerate(zip(*[c.to_pylist() for c in key_columns], strict=True)):
                if key != own:
                    if own is not None:
                        ended.append((*own, first, n, z))
                    own, first, n, z = key, starts[i], 0, zero
                done[i], moved[i] = n, z
                n, z = n + sizes[i], kernels.state_power(coefficients, sizes[i]) @ z + s[i]
            yield pa.RecordBatch.from_arrays([*key_columns, *kept, pa.nulls(g.num_rows, pa.float64()), pa.array(done), _rows(moved)], names=names)
            yield wholes(ended)
        if own is not None:
            yield wholes([(*own, first, n, z)])

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, z, scanned = None, zero, True
        for g in batches:
            rows = []
            for key, run, first, n, s in zip(zip(*[g[k] for k in keys], strict=True), g["run"], g["first"], g["done"], g["moved"], strict=True):
                if key != own:
                    own, z, scanned = key, steady * first, run < 0 or not whole
                if scanned:
                    rows.append((*key, run, z))
                z = kernels.state_power(coefficients, n) @ z + np.asarray(s)
            yield pd.DataFrame(rows, columns=[*keys, "run", "z"])

    @arrow_udf("array<double>")
    def at_start(n: pa.Array, s: pa.Array, z: pa.Array) -> pa.Array:
        return _rows(_moved(coefficients, n, _numbers(z).reshape(-1, dim)) + _numbers(s).reshape(-1, dim))

    runs = maps.select(*keys, F.floor(F.col("at") / RUN).alias("run"), "at", *keep, "first", F.col("n").alias("n_own"), "s")
    runs = brainvision.stored(runs.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "at").mapInArrow(inside, inner))
    starts = runs.where("at IS NULL").select(*keys, "run", "first", "done", "moved").repartition(*keys).sortWithinPartitions(*keys, "run").mapInPandas(over, f"{head}run long, z array<double>")
    states = runs.where("at IS NOT NULL").select(*keys, "run", "at", *keep, "done", "moved").join(starts, [*keys, "run"])
    return states.select(*keys, "at", *keep, at_start("done", "moved", "z").alias("state"))


def zero_phase(chunks: DataFrame, keys: list[str], chunk: int, b: np.ndarray, a: np.ndarray, pad: int | None = None) -> DataFrame:
    """keys, chunk_idx, samples: each recording filtered forward and backward, with odd extension and steady starts, as of one piece.

    chunks: keys (not null), chunk_idx from 0 without gaps, samples of `chunk` doubles (the last chunk has the rest). Recordings no longer than the
    padding, which cannot be filtered, get null samples; a null sample makes all samples of its recording null, as the filter has no end.
    Other columns are left out; an empty table gives none.
    """
    pad = 3 * max(len(a), len(b)) if pad is None else pad
    coefficients, steady = np.stack([b, a]).tobytes(), kernels.steady_state(b, a)
    dim = len(steady)
    x = brainvision.stored(chunks.select(*keys, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("samples").cast("array<double>").alias("samples")))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            n, flat = g.column("samples").value_lengths().to_numpy().astype(np.int64), _numbers(g.column("samples"))
            (s, r), (first, last) = np.zeros((2, len(n), dim)), np.zeros((2, len(n)))
            for own, at in _alike(n):
                v, zero = flat[at], np.zeros((len(own), dim))
                y, s[own] = kernels.run_filter(b, a, v, zero)
                r[own] = kernels.run_filter(b, a, y[:, ::-1], zero)[1]
                first[own], last[own] = v[:, 0], y[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*[g.column(k) for k in [*keys, "chunk_idx"]], pa.array(n), _rows(s), _doubles(first), _rows(r), _doubles(last)], names=[*keys, "at", "n", "s", "first", "r", "last"])

    @arrow_udf(T.StructType([T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("first", T.DoubleType())]))
    def backward(n: pa.Array, r: pa.Array, last: pa.Array, z: pa.Array) -> pa.Array:
        sizes, of = np.unique(n.to_numpy(), return_inverse=True)
        s, first, z = _numbers(r).reshape(-1, dim).copy(), last.to_numpy(zero_copy_only=False).copy(), _numbers(z).reshape(-1, dim)
        for k, size in enumerate(sizes.tolist()):
            m, o = kernels.passed_back(coefficients, size)
            s[of == k] += z[of == k] @ m.T
            first[of == k] += z[of == k] @ o
        return pa.StructArray.from_arrays([_rows(s), _doubles(first)], names=["s", "first"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a map of batches, not a function of columns: what is asked of its samples later would call that once more
        for g in batches:
            given = pc.and_(g.column("ahead").is_valid(), g.column("back").is_valid())
            none, g = g.filter(pc.invert(given)), g.filter(given)
            n, flat = g.column("samples").value_lengths().to_numpy().astype(np.int64), _numbers(g.column("samples"))
            ahead, back, out = _numbers(g.column("ahead")).reshape(-1, dim), _numbers(g.column("back")).reshape(-1, dim), np.zeros(len(flat))
            for own, at in _alike(n):
                y, _ = kernels.run_filter(b, a, flat[at], ahead[own])
                y, _ = kernels.run_filter(b, a, y[:, ::-1], back[own])
                out[at] = y[:, ::-1]
            for rows, samples in ((none, pa.nulls(none.num_rows, pa.list_(pa.float64()))), (g, _lists(n, out))):
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in [*keys, "chunk_idx"]], samples], names=[*keys, "chunk_idx", "samples"])

    head = "".join(f"`{k}` {x.schema[k].dataType.simpleString()}, " for k in keys)
    m = x.unionByName(_edges(x, keys, chunk, pad)).where(F.size("samples") > 0)
    m = m.mapInArrow(maps, f"{head}at long, n long, s array<double>, first double, r array<double>, last double")
    f = scan(m, keys, coefficients, steady, {"n": "long", "r": "array<double>", "last": "double"}, whole=True)
    f = f.select(*keys, (-F.col("at")).alias("at"), "n", F.col("state").alias("ahead"), backward("n", "r", "last", "state").alias("m")).select("*", "m.*").drop("m")
    w = scan(f, keys, coefficients, steady, {"ahead": "array<double>"}).select(*keys, (-F.col("at")).alias("chunk_idx"), "ahead", F.col("state").alias("back"))
    return x.join(w, [*keys, "chunk_idx"], "left").mapInArrow(both, f"{head}chunk_idx long, samples array<double>")
