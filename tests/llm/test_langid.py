"""Language mixtures against plain expectation-maximisation with a plain search of the set, and accuracy on rows not learned from."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, langid


def plain_em(p, counts, pi):
    """p: a list of likelihoods by language for each trigram."""
    total = sum(counts)
    for r in range(1, langid.ROUNDS + 1):
        new = [0.0] * len(pi)
        for row, n in zip(p, counts, strict=True):
            mixed = sum(a * b for a, b in zip(row, pi, strict=True))
            for k in range(len(pi)):
                new[k] += n * row[k] * pi[k] / mixed / total
        moved = max(abs(a - b) for a, b in zip(new, pi, strict=True))
        pi = new
        if r % 4 == 0 and moved <= langid.SETTLED:
            break
    return pi, sum(n * math.log(sum(a * b for a, b in zip(row, pi, strict=True))) for row, n in zip(p, counts, strict=True))


def plain(model, doc):
    found, counts = np.unique(doc, return_counts=True)
    p, total = np.exp(model.log_p[:, found]).T.tolist(), len(doc)
    n = len(model.languages)
    pi, best = [1.0 / n] * n, (-math.inf, None)
    size = n
    while size:
        pi, ll = plain_em(p, counts.tolist(), pi)
        score = ll - 0.5 * (size - 1) * math.log(max(total, 2))
        if score >= best[0] - 1e-9:
            best = (score, pi)
        if size == 1:
            break
        top = max(pi)
        kept = [x if x * total >= langid.TRACE or x == top else 0.0 for x in pi]
        if sum(x > 0 for x in kept) == size:
            kept[min((k for k in range(n) if pi[k] > 0), key=lambda k: pi[k])] = 0.0
        pi = [x / sum(kept) for x in kept]
        size = sum(x > 0 for x in pi)
    return best[1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_counts(docs):
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").limit(40)
    want = {}
    for r in rows.collect():
        for b in langid.buckets(r.text).tolist():
            want[r.lang, b] = want.get((r.lang, b), 0) + 1
    assert {(r.lang, r.bucket): r.n for r in langid.trigram_counts(rows).collect()} == want


def test_against_plain(docs, model):
    texts = [r.text for r in docs.where("text IS NOT NULL AND n_chars < 3000").orderBy("doc_id").limit(40).collect()]
    texts += [a[: 40 * k] + " " + b[: 300 - 30 * k] for k, (a, b) in enumerate(zip(texts[:9], texts[9:18], strict=True))]
    own = [b for b in map(langid.buckets, texts) if len(b)]
    pi, _ = langid.infer(model, own)
    for got, doc in zip(pi, own, strict=True):
        want = plain(model, doc)
        assert np.allclose(got, want, atol=1e-6), (got, want)


def test_mixture_is_found(docs, model):
    by = {}
    for r in docs.where("lang IS NOT NULL AND n_chars > 1500").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text[:1500])
    a, b = sorted(by)[:2]
    pi, _ = langid.infer(model, [langid.buckets(by[a] + " " + by[b]), langid.buckets(by[a])])
    assert {model.languages[k] for k in np.flatnonzero(pi[0])} == {a, b} and np.allclose(pi[0].sum(), 1) and (pi[0] > 0.3).sum() == 2
    assert model.languages[int(pi[1].argmax())] == a and pi[1].max() > 0.95


def test_accuracy_on_rows_not_learned_from(docs, model):
    out = langid.with_languages(docs, model).where(common.held_out(F.col("doc_id"))).where("lang IS NOT NULL AND language.lang <> 'und'")
    r = out.agg(F.avg((F.col("lang") == F.col("language.lang")).cast("double")).alias("hit"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.hit > 0.97


def test_edge_cases(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "a"), (5, "le " * 60_000), (5, "le " * 60_000), (None, "der die das und")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1))
    got = langid.with_languages(df, model).collect()
    assert len(got) == 7 and [r.doc_id for r in got if r.language.lang == "und"] == [1, 2, 3]
    assert all(0 <= r.language.score <= 1 for r in got) and len({(r.language.lang, r.language.score) for r in got if r.doc_id == 5}) == 1
    assert langid.with_languages(df.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r.language.lang for r in langid.with_languages(df, none).collect()} == {"und"}
