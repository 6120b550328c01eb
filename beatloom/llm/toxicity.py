"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, order ORDER, with word boundaries: one of words of toxic documents, one of words of ordinary
ones. Their highest order counts each class on its own. Both back off to one shared Kneser-Ney model of all lower orders, down
to single characters, whose counts are continuations (before how many different characters of either class's words an ending
occurs), so a rare expression is smoothed alike in both. Every order is discounted and passes what it discounts to the next,
so each model sums to one after every context. A word's evidence is the difference of its two log-likelihoods; the
lower orders cancel out of it except for n-grams that a class has, so a scorer needs one table of n-grams and one of contexts.

Counts cover all labelled rows but the held-out quarter and a calibration part. Every n-gram and context of them is kept, in
stored tables that grow with the input. The tables are sent to the tasks only while they have at most SENT_ROWS rows together;
beyond that the distinct pieces of the documents are joined with them. Both ways give the same evidence.

Words are looked at in pieces: a word of at most LONGEST characters is one, a longer one is split into parts that overlap by
ORDER - 1 characters, so each of its n-grams is in exactly one part. A document's features are its length-normalised
log-likelihood difference, its strongest three pieces, and the number and share of strong ones; a logistic curve, fitted on the
calibration part (about CALIBRATION_ROWS rows of it at most, chosen by a hash of the id), makes a score of them.

Labels, language, source and id are never inputs of a score.

Cases: null and wordless texts have no evidence and get the score of a text without any; whole texts and whole words, of any length, are
learned and scored; repeated rows get equal scores; labels that are null are ignored; without labels of both classes every score is 0; a
calibration part without labels of both classes is replaced by all labelled rows that may be learned from; a document with
several labels counts once for each; empty tables give an empty result; extra columns are ignored by score_table() and kept
by with_scores(), which adds columns of its own names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common

ORDER, DISCOUNT, THRESHOLD = 6, 0.75, 0.3
CALIBRATION_PART, CALIBRATION_ROWS = 4, 50_000
LONGEST, STRONG, TOP = 40, 3.0, 3
#: Rows of n-grams and contexts, 16 bytes each, that may be sent to the tasks.
SENT_ROWS = 6_000_000
#: Characters that are looked at together.
CHUNK_CHARS = 600_000
FEATURES = ("mean", "first", "second", "third", "strong", "share")
_START, _END = ord("^"), ord("$")
_SPANS = common.SpanHashes()


@dataclass(frozen=True)
class Model:
    """grams (gram, r) and contexts (ctx, r): stored log ratios, None without labels of both classes; their rows; both as sent to the tasks, if
    they are few; weights: of the logistic curve, the constant last."""

    grams: DataFrame | None = None
    contexts: DataFrame | None = None
    rows: int = 0
    tables: Broadcast | None = None
    weights: tuple[float, ...] = ()


# ---- pieces of texts, as spans of one array of code points ----
@dataclass
class Pieces:
    """Marked words of some texts: code points, spans of their pieces, the text each is of, and which begin a word."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    begins: np.ndarray


def pieces_of(texts: list[str]) -> Pieces:
    lower = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lower), dtype=np.int64, count=len(lower))
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = np.diff(common.letters()[codes].astype(np.int8))
    first, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    owner = np.searchsorted(np.cumsum(sizes), first - 1, side="right")
    n = stop - first + 2
    at = np.concatenate([[0], np.cumsum(n)])
    marked = np.empty(at[-1], dtype=np.uint32)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    letter = np.zeros(len(codes), dtype=bool)
    letter[:-1] = common.letters()[codes[:-1]]
    marked[inside] = codes[letter]
    marked[at[:-1]], marked[at[1:] - 1] = _START, _END
    step = LONGEST - ORDER + 1
    parts = np.where(n <= LONGEST, 1, -(-(n - ORDER + 1) // step))
    word = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = at[word] + k * step
    return Pieces(marked, start, np.minimum(start + LONGEST, at[word + 1]), owner[word], k == 0)


def distinct(p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed code points; the index of one piece of each kind; the kind of each piece."""
    mixed = common.mixed(p.codes.astype(np.uint64))
    _, index, kind = np.unique(_SPANS(mixed, p.start, p.end), return_index=True, return_inverse=True)
    return mixed, index, kind


def windows(p: Pieces, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece (a position in index) of every n-gram: the last ORDER characters at most, fewer only at a word's start."""
    start, end = p.start[index], p.end[index]
    first = np.where(p.begins[index], start + 2, start + ORDER)
    n = end - first + 1
    piece = np.repeat(np.arange(len(index)), n)
    stop = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[piece]
    return np.maximum(start[piece], stop - ORDER), stop, piece


def strings(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def hashes(texts: list[str]) -> np.ndarray:
    """The hashes that _SPANS gives spans of these characters."""
    end = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _SPANS(common.mixed(codes.astype(np.uint64)), np.concatenate([[0], end[:-1]]), end)


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts, CHUNK_CHARS characters or so at a time; longer texts are parted at blanks."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        text, lo = text or "", 0
        while lo < len(text):
            hi = len(text)
            if hi - lo > CHUNK_CHARS:
                cut = text.find(" ", lo + CHUNK_CHARS)
                hi = hi if cut < 0 else cut
            at.append(i)
            held.append(text[lo:hi])
            size += hi - lo
            lo = hi
            if size >= CHUNK_CHARS:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


# ---- training ----
def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, part of the rows that a model may learn from; part CALIBRATION_PART - 1 is for calibration.

    Labels grow with the documents, so they are never broadcast: the plan is the same at every size.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL")
    y = y.where(~common.held_out(F.col("doc_id")))
    return d.withColumn("part", F.floor(crc / 4) % CALIBRATION_PART).join(y.hint("merge"), "doc_id").select("doc_id", "text", "toxic", "part")


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram, c0, c1: uses in ordinary and toxic texts, from text and toxic; added up inside tasks before the shuffle."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy() > 0
            for at, texts in chunks(batch["text"].tolist()):
                p = pieces_of(texts)
                if not len(p.start):
                    continue
                mixed, index, kind = distinct(p)
                bad = toxic[np.array(at)][p.owner]
                start, end, piece = windows(p, index)
                _, first, gram = np.unique(_SPANS(mixed, start, end), return_index=True, return_inverse=True)
                n = [np.bincount(gram, weights=np.bincount(kind[own], minlength=len(index))[piece], minlength=len(first)).astype(np.int64) for own in (~bad, bad)]
                yield pd.DataFrame({"gram": strings(p.codes, start[first], end[first]), "c0": n[0], "c1": n[1]})

    parts = rows.select("text", "toxic").mapInPandas(run, "gram string, c0 long, c1 long")
    return parts.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _without_first(c: str) -> Column:
    return F.substr(F.col(c), F.lit(2), F.length(c))


def _without_last(c: str) -> Column:
    return F.substr(F.col(c), F.lit(1), F.length(c) - 1)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """end, p: the shared model's chance of the last character of every ending of at most ORDER - 1 characters after the others.

    An ending's count is the number of different characters that occur before it. With c the others, m the counts of all endings
    after c, and k their number, p(end) = (count - D) / m + (D * k / m) * p(end without its first character), down to
    single characters, whose p is their share of all counts. So an ending is joined with all its own endings once, and its p is
    summed up from the shortest.
    """
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.substr(F.col("gram"), i, F.length("gram")))
    tails = grams.select(F.explode(ends).alias("tail")).distinct().where(F.length("tail") > 1)
    counts = tails.groupBy(_without_first("tail").alias("end")).agg(F.count("*").alias("n")).withColumn("ctx", _without_last("end"))
    sums = counts.groupBy("ctx").agg(F.sum("n").alias("m"), F.count("*").alias("k"))
    single = F.length("end") == 1
    parts = counts.join(sums, "ctx").select(
        "end", F.when(single, F.col("n") / F.col("m")).otherwise((F.col("n") - DISCOUNT) / F.col("m")).alias("own"), F.when(single, 0.0).otherwise(DISCOUNT * F.col("k") / F.col("m")).alias("rest"))
    parts = common.stored(parts, "toxic-endings")
    part = F.explode(F.transform(F.sequence(F.lit(1), F.length("end")), lambda i: F.substr(F.col("end"), i, F.length("end"))))
    chains = parts.select("end", part.alias("part")).join(parts.select(F.col("end").alias("part"), "own", "rest"), "part")
    chains = chains.groupBy("end").agg(F.sort_array(F.collect_list(F.struct(F.length("part").alias("size"), "own", "rest"))).alias("chain"))  # ORDER - 1 at most
    return chains.select("end", F.aggregate("chain", F.lit(0.0), lambda p, x: x["own"] + x["rest"] * p).alias("p"))


def sent(grams: DataFrame, contexts: DataFrame) -> Broadcast:
    """Sorted hashes and evidence of both tables, 16 bytes a row."""
    return grams.sparkSession.sparkContext.broadcast((_sorted_hashes(grams, "gram"), _sorted_hashes(contexts, "ctx")))


def train(rows: DataFrame) -> Model:
    """The models' tables from text and toxic."""
    grams = common.stored(gram_counts(rows), "toxic-grams")
    total = grams.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count("*").alias("n")).first()
    if not total["c0"] or not total["c1"]:
        return Model()
    keyed = grams.withColumn("ctx", _without_last("gram"))
    ctx = common.stored(keyed.groupBy("ctx").agg(*[f(c).alias(f"{n}{k}") for k in (0, 1) for n, f, c in (("t", F.sum, f"c{k}"), ("d", F.count_if, F.col(f"c{k}") > 0))]), "toxic-contexts")
    kept = keyed.join(ctx, "ctx").withColumn("end", _without_first("gram")).join(shared_backoff(grams), "end")

    def p(k: int) -> Column:
        own = (F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"d{k}") * F.col("p")) / F.col(f"t{k}")
        return F.when(F.col(f"t{k}") > 0, own).otherwise(F.col("p"))

    def backoff(k: int) -> Column:
        return F.when(F.col(f"t{k}") > 0, DISCOUNT * F.col(f"d{k}") / F.col(f"t{k}")).otherwise(1.0)

    g = common.stored(kept.select("gram", F.ln(p(1)).alias("l1"), F.ln(p(0)).alias("l0")).select("gram", (F.col("l1") - F.col("l0")).alias("r")), "toxic-gram-ratios")
    c = common.stored(ctx.select("ctx", F.ln(backoff(1) / backoff(0)).alias("r")), "toxic-context-ratios")
    common.drop_stored(grams)
    common.drop_stored(ctx)
    rows = total["n"] + c.count()
    return Model(g, c, rows, sent(g, c) if rows <= SENT_ROWS else None)


# ---- evidence, the model's tables at hand ----
class Table:
    """Evidence of distinct pieces from sorted hashes of the n-grams and contexts."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]):
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, r = table
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, r[at]

    def __call__(self, p: Pieces, mixed: np.ndarray, index: np.ndarray) -> np.ndarray:
        """A new n-gram has the evidence of its context."""
        start, end, piece = windows(p, index)
        h, at = np.unique(_SPANS(mixed, start, end), return_inverse=True)
        first = np.zeros(len(h), dtype=np.int64)
        first[at] = np.arange(len(at))
        known, r = self._find(self.grams, h)
        other = first[~known]
        seen, back = self._find(self.contexts, _SPANS(mixed, start[other], end[other] - 1))
        r[~known] = np.where(seen, back, 0.0)
        return np.bincount(piece, weights=r[at], minlength=len(index))


def _sorted_hashes(table: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": hashes(b[name].tolist()).view(np.int64), "r": b["r"]})

    rows = table.mapInPandas(run, "h long, r double").toPandas()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["r"].to_numpy()[order]


def features_of(texts: list[str | None], table: Table) -> np.ndarray:
    """(texts, FEATURES)."""
    n = len(texts)
    total, count, strong, top = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, TOP))
    for at, part in chunks(texts):
        p = pieces_of(part)
        if not len(p.start):
            continue
        mixed, index, kind = distinct(p)
        r, owner = table(p, mixed, index)[kind], np.array(at)[p.owner]
        total += np.bincount(owner, weights=r, minlength=n)
        count += np.bincount(owner, minlength=n)
        strong += np.bincount(owner[r > STRONG], minlength=n)
        up = np.flatnonzero(r > 0)
        up = up[np.lexsort((-r[up], owner[up]))]
        own = owner[up]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        up, own, rank = up[rank < TOP], own[rank < TOP], rank[rank < TOP]
        new = np.zeros((n, TOP))
        new[own, rank] = r[up]
        top = -np.sort(-np.hstack([top, new]), axis=1)[:, :TOP]
    size = np.maximum(1, [len(t or "") for t in texts])
    return np.column_stack([total / size, np.minimum(top, 10.0), np.log1p(strong), strong / np.maximum(count, 1)])


# ---- evidence by joins ----
def evidence(used: DataFrame, model: Model) -> DataFrame:
    """piece, r: the evidence of every distinct piece of `used`."""
    counted = used.select("piece").distinct()
    first = F.when(F.col("piece").startswith("^"), 2).otherwise(ORDER)
    at = counted.select("piece", F.explode(F.sequence(first, F.length("piece"))).alias("end"))
    start = F.greatest(F.lit(1), F.col("end") - (ORDER - 1))
    at = at.select("piece", F.substr("piece", start, F.col("end") - start + 1).alias("gram")).withColumn("ctx", _without_last("gram"))
    at = at.join(model.grams, "gram", "left").join(model.contexts.withColumnRenamed("r", "back"), "ctx", "left")
    return at.groupBy("piece").agg(F.sum(F.coalesce("r", "back", F.lit(0.0))).alias("r"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def pieces_used(texts: DataFrame) -> DataFrame:
    """key, piece, n: how often each text, of key and text, has each of its pieces."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy(dtype=object)
            for at, texts in chunks(batch["text"].tolist()):
                p = pieces_of(texts)
                if len(p.start):
                    _, index, kind = distinct(p)
                    both, n = np.unique(p.owner * len(index) + kind, return_counts=True)
                    piece = np.array(strings(p.codes, p.start[index], p.end[index]), dtype=object)
                    yield pd.DataFrame({"key": keys[np.array(at)[both // len(index)]], "piece": piece[both % len(index)], "n": n})

    return texts.select("key", "text").mapInPandas(run, "key string, piece string, n long")


def joined_features(texts: DataFrame, model: Model) -> DataFrame:
    """key and FEATURES of texts (key, text), by joins of their pieces with the model's tables."""
    used = common.stored(pieces_used(texts), "toxic-pieces")
    values = common.stored(evidence(used, model), "toxic-evidence")
    by = used.join(values, "piece").groupBy("key").agg(
        F.sum(F.col("n") * F.col("r")).alias("total"), F.sum("n").alias("count"), F.sum(F.when(F.col("r") > STRONG, F.col("n")).otherwise(0)).alias("uses"),
        F.flatten(F.collect_list(F.when(F.col("r") > 0, F.array_repeat("r", F.least(F.col("n"), F.lit(TOP)).cast("int"))))).alias("up"))
    by = by.withColumn("up", F.sort_array("up", False))
    out = texts.select("key", F.length("text").alias("chars")).join(by, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    nth = lambda k: F.least(zero(F.try_element_at("up", F.lit(k))), F.lit(10.0))
    f = (zero(F.col("total") / F.col("chars")), nth(1), nth(2), nth(3), zero(F.log1p("uses")), zero(F.col("uses") / F.col("count")))
    return out.select("key", *[x.alias(name) for name, x in zip(FEATURES, f, strict=True)])


def with_features(rows: DataFrame, model: Model, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Adds a struct __features of each text's FEATURES."""
    if model.rows <= sent_rows:
        shared = model.tables or sent(model.grams, model.contexts)

        @pandas_udf(", ".join(f"{name} double" for name in FEATURES))
        @common.in_task
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            table = Table(*shared.value)
            for batch in batches:
                yield pd.DataFrame(features_of(batch.tolist(), table), columns=list(FEATURES))

        return rows.withColumn("__features", run(F.col("text")))
    texts = rows.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = common.stored(texts.groupBy("key").agg(F.max("text").alias("text")), "toxic-texts")
    found = joined_features(texts, model).select(F.col("key").alias("__key"), F.struct(*FEATURES).alias("__features"))
    return rows.withColumn("__own_key", text_key(F.col("text"))).join(found, F.col("__own_key") == F.col("__key"), "left").drop("__own_key", "__key")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton's method; features are scaled inside."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def chosen(rows: DataFrame, limit: int) -> DataFrame:
    """About `limit` rows at most, chosen by a hash of doc_id, so that reruns choose the same ones."""
    n = rows.count()
    share = min(1.0, limit / max(1, n))
    return rows if share == 1.0 else rows.where(common.hex_key(F.col("doc_id"), 8) < int(share * 16**8))


def fit(docs: DataFrame, labels: DataFrame, limit: int = CALIBRATION_ROWS) -> Model:
    """A model from all labelled rows that may be learned from."""
    own = F.col("part") == CALIBRATION_PART - 1
    rows = labelled(docs, labels)
    model = train(rows.where(~own))
    if model.grams is None:
        return model

    def known(part: DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        found = with_features(chosen(part, limit).select("text", "toxic"), model).select("toxic", "__features.*").toPandas()
        found = found.sort_values(list(found.columns))  # sums, and so weights, do not depend on the order of tasks
        return found, (found["toxic"].to_numpy() > 0).astype(float)

    found, y = known(rows.where(own))
    if len(set(y)) < 2:
        found, y = known(rows)
    return replace(model, weights=tuple(_logistic(found[list(FEATURES)].to_numpy(), y).tolist()))


def with_scores(docs: DataFrame, model: Model, score_col: str = "score", sent_rows: int = SENT_ROWS) -> DataFrame:
    """Adds the score of each text."""
    if not model.weights:
        return docs.withColumn(score_col, F.lit(0.0))
    z = F.lit(model.weights[-1])
    for name, w in zip(FEATURES, model.weights, strict=False):
        z = z + w * F.col(f"__features.{name}")
    return with_features(docs, model, sent_rows).withColumn(score_col, 1 / (1 + F.exp(-z))).drop("__features")


def score_table(docs: DataFrame, model: Model, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, sent_rows=sent_rows)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, common.table(spark, sf_dir, "labels")))
