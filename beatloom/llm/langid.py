"""Language identification by multilingual mixture inference.

Each learned language has a distribution over character trigrams of words, hashed to BUCKETS. A document's trigrams
are taken as drawn from a mixture of languages; expectation-maximisation estimates the proportions, until none moves by more than
SETTLED in a round. The set of languages is chosen by penalised likelihood: from all languages down, the one with the least
proportion is dropped and the rest estimated again, and the set with the best log-likelihood less half a log of the length for each
language is kept. Languages that explain less than TRACE trigrams of the document together leave in one step.

The predicted language is the one with the largest proportion in the chosen set, and that proportion is the score.

Counts cover all rows that may be learned from, summed inside tasks first; the model has BUCKETS numbers for each
language and is broadcast; languages are a dimension, of MOST_LANGUAGES at most, which is checked. Documents are inferred in vectorised batches of rows; nothing is shuffled.

Cases: null texts and texts without a letter are `und` with score 0; whole texts are read; repeated rows get equal results;
with no language to learn from, every text is `und`; empty tables give an empty result; extra columns are kept by
with_languages(), which adds columns of its own names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common

BITS, SMOOTHING = 15, 0.1
#: Of the estimation: the most rounds, the move that ends it, the trigrams below which languages leave together.
ROUNDS, SETTLED, TRACE = 200, 1e-3, 0.5
BUCKETS = 1 << BITS
UNKNOWN = "und"
MOST_LANGUAGES = 1000
#: Documents are inferred together up to so many trigrams' buckets.
BATCH_BUCKETS = 60_000

def buckets(text: str | None) -> np.ndarray:
    """The hashed trigrams of a text's words, with a blank before and after each word; empty without letters."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), dtype=np.uint32)
    letter = common.letters()[c]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    c = np.where(letter, c, np.uint32(32))
    blank = ~letter
    keep = ~(blank[1:] & blank[:-1])  # one blank for a run of others
    c = np.concatenate([c[:1], c[1:][keep]]).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(64 - BITS)).astype(np.int64))[c[1:-1] != 32]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # (languages, BUCKETS)


def trigram_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n over text and lang; summed inside tasks before the shuffle."""

    @common.in_task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if len(b := buckets(text)):
                    own = sums.get(lang)
                    if own is None:
                        own = sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    own += np.bincount(b, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    parts = rows.select("text", "lang").mapInPandas(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """A model from the text and language of all rows that may be learned from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    counts = trigram_counts(rows).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages are more than a model may have")
    n = np.full((len(languages), BUCKETS), SMOOTHING)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        n[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    # a bucket that no language has seen says nothing of the language
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)) if len(languages) else n)


def _em(p: np.ndarray, counts: np.ndarray, sizes: np.ndarray, pi: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages, documents) from pi on, and log-likelihoods; p: (languages, buckets), documents' buckets in a row.

    Documents whose proportions have settled are set aside every few rounds.
    """

    def mixed(p: np.ndarray, pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.maximum(sum(p[k] * pi[k][owner] for k in np.flatnonzero(pi.any(axis=1))), 1e-300)

    out, live = pi.copy(), np.arange(len(sizes))
    q, c, n, t = p, counts, sizes, total
    for r in range(1, ROUNDS + 1):
        first = np.cumsum(n) - n
        weight = c / mixed(q, pi, n)
        new = np.zeros_like(pi)
        for k in np.flatnonzero(pi.any(axis=1)):
            new[k] = pi[k] * np.add.reduceat(q[k] * weight, first) / t
        if r % 4 == 0 or r == ROUNDS:
            out[:, live] = new
            more = np.abs(new - pi).max(axis=0) > SETTLED
            if not more.any():
                break
            if not more.all():
                inside = np.repeat(more, n)
                q, c, n, t, live, new = q[:, inside], c[inside], n[more], t[more], live[more], new[:, more]
        pi = new
    return out, np.add.reduceat(counts * np.log(mixed(p, out, sizes)), np.cumsum(sizes) - sizes)


def infer(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (documents, languages), 0 for languages out of the set, and per-trigram log-likelihoods.

    Each smaller set starts from the proportions of the one before.
    """
    found = [np.unique(d, return_counts=True) for d in docs]
    sizes = np.array([len(f[0]) for f in found])
    at, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(float)
    log_p = model.log_p[:, at]
    top = log_p.max(axis=0)  # scaled likelihoods, so that none vanishes
    p = np.exp(log_p - top)
    starts = np.cumsum(sizes) - sizes
    total, base = np.add.reduceat(counts, starts), np.add.reduceat(counts * top, starts)
    n_lang, n_docs = len(model.languages), len(docs)
    best, best_pi, best_ll = np.full(n_docs, -np.inf), np.zeros((n_docs, n_lang)), np.zeros(n_docs)
    pi, live = np.full((n_lang, n_docs), 1.0 / n_lang), np.arange(n_docs)
    while len(live):
        inside = np.repeat(np.isin(np.arange(n_docs), live), sizes) if len(live) < n_docs else slice(None)
        before = (pi > 0).sum(axis=0)
        pi, ll = _em(p[:, inside], counts[inside], sizes[live], pi, total[live])
        penalised = ll - 0.5 * (before - 1) * np.log(np.maximum(total[live], 2))
        better = penalised >= best[live]
        won = live[better]
        best[won], best_pi[won], best_ll[won] = penalised[better], pi[:, better].T, ((ll + base[live]) / total[live])[better]
        more = before > 1
        live, pi, before = live[more], pi[:, more], before[more]
        if len(live):
            least = np.where(pi > 0, pi, np.inf).argmin(axis=0)
            faint = pi * total[live] < TRACE
            faint[pi.argmax(axis=0), np.arange(len(live))] = False
            pi = np.where(faint, 0.0, pi)
            alone = (pi > 0).sum(axis=0) == before
            pi[least[alone], np.flatnonzero(alone)] = 0
            pi /= pi.sum(axis=0)
    return best_pi, best_ll


LANGUAGE = "lang string, score double, likelihood double, languages array<string>"


def language(text: Column, model: Model, spark: SparkSession) -> Column:
    """A struct of LANGUAGE of a text column: prediction, proportion, log-likelihood per trigram, chosen set."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(LANGUAGE)
    @common.in_task
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows: list[tuple] = [(UNKNOWN, 0.0, None, [])] * len(batch)
            held: list[tuple[int, np.ndarray]] = []

            def infer_held() -> None:
                pi, ll = infer(m, [b for _, b in held])
                for (i, _), own, l in zip(held, pi, ll.tolist(), strict=True):
                    k = int(own.argmax())
                    rows[i] = (m.languages[k], float(min(1.0, own[k])), l, [m.languages[j] for j in np.argsort(-own, kind="stable") if own[j] > 0])
                held.clear()

            size = 0
            for i, text in enumerate(batch):
                b = buckets(text)
                if len(b) and m.languages:
                    held.append((i, b))
                    size += min(len(b), BUCKETS)
                    if size > BATCH_BUCKETS:
                        infer_held()
                        size = 0
            if held:
                infer_held()
            yield pd.DataFrame(rows, columns=["lang", "score", "likelihood", "languages"])

    return run(text)


def with_languages(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """Adds a struct column of the prediction."""
    return docs.withColumn(name, language(F.col("text"), model, docs.sparkSession))


def op9_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    out = with_languages(docs.select("doc_id", "text"), fit(docs))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.array_join("language.languages", ",").alias("languages"),
    )
