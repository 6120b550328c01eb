"""Toxicity against plain Kneser-Ney models with all n-grams in memory."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, toxicity
from tests.conftest import SF

ORDER, D, LONGEST = toxicity.ORDER, toxicity.DISCOUNT, toxicity.LONGEST


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def ngrams(text):
    for w in words(text):
        m = f"^{w}$"
        for end in range(2, len(m) + 1):
            yield m[max(0, end - ORDER) : end]


class Plain:
    """Both classes' models and the shared one, straight from the definition."""

    def __init__(self, rows):
        self.counts = (Counter(), Counter())
        for text, toxic in rows:
            self.counts[toxic > 0].update(ngrams(text))
        self.grams = self.counts[0].keys() | self.counts[1].keys()
        # all strings of each length that end a gram, whatever stands before
        self.tails = {g[i:] for g in self.grams for i in range(len(g))}
        self.lefts = Counter(t[1:] for t in self.tails if len(t) > 1)
        self.after, self.kinds = Counter(), Counter()
        for s, n in self.lefts.items():
            self.after[s[:-1]] += n
            self.kinds[s[:-1]] += 1
        self.sums = (Counter(), Counter())
        self.seen = (Counter(), Counter())
        for k in (0, 1):
            for g, n in self.counts[k].items():
                self.sums[k][g[:-1]] += n
                self.seen[k][g[:-1]] += 1

    def shared(self, s):
        c = s[:-1]
        if not c:
            return self.lefts[s] / self.after[""]
        if not self.after[c]:
            return self.shared(s[1:])
        return (max(self.lefts[s] - D, 0.0) + D * self.kinds[c] * self.shared(s[1:])) / self.after[c]

    def p(self, g, k):
        t = self.sums[k][g[:-1]]
        return (max(self.counts[k][g] - D, 0.0) + D * self.seen[k][g[:-1]] * self.shared(g[1:])) / t if t else self.shared(g[1:])

    def evidence(self, g):
        if g not in self.grams and not (self.sums[0][g[:-1]] or self.sums[1][g[:-1]]):
            return 0.0
        if not self.shared(g[1:]):  # a character no text had: what both back off to cancels
            back = [D * self.seen[k][g[:-1]] / self.sums[k][g[:-1]] if self.sums[k][g[:-1]] else 1.0 for k in (0, 1)]
            return math.log(back[1] / back[0])
        return math.log(self.p(g, 1) / self.p(g, 0))


def parts(word):
    m = f"^{word}$"
    if len(m) <= LONGEST:
        return [list(ngrams(word))]
    out, step = [], LONGEST - ORDER + 1
    for i in range(0, len(m) - ORDER + 1, step):
        cut = m[i : i + LONGEST]
        out.append([cut[max(0, e - ORDER) : e] for e in range(2 if i == 0 else ORDER, len(cut) + 1)])
    assert Counter(g for p in out for g in p) == Counter(ngrams(word))
    return out


def features(model, text):
    e = sorted((sum(map(model.evidence, p)) for w in words(text) for p in parts(w)), reverse=True)
    if not e:
        return [0.0] * 6
    strong = sum(x > toxicity.STRONG for x in e)
    return [sum(e) / len(text), *[max(0.0, min(10.0, x)) for x in (e + [0.0] * 3)[:3]], math.log1p(strong), strong / len(e)]


def same(spark, rows, texts, sent):
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: list(r["__features"]) for r in toxicity.with_features(df, model, sent).collect()}
    plain = Plain(rows)
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(got[i], features(plain, t), atol=1e-9), t
    return model, plain


def some_rows(spark, n):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("text IS NOT NULL AND toxic IS NOT NULL")
    return [(r.text[:3000], r.toxic) for r in rows.orderBy("doc_id").select("text", "toxic").limit(n).collect()] + [("seen grumblewort", 1), ("one quietword", 0)]


@pytest.mark.parametrize("sent", [0, toxicity.SENT_ROWS])
def test_every_gram_counts(spark, sent):
    rows = some_rows(spark, 60)
    texts = [rows[0][0], rows[0][0], rows[5][0], None, "", " ", "12 34", "a grumblewort", "quietword quietword QUIETWORD, quietword", "don't-stop|grumblewort's 日本語。x", "İstanbul ΟΔΟΣ ²x", "grumble$ ^wort"]
    same(spark, rows, texts, sent)


@pytest.mark.parametrize("sent", [0, toxicity.SENT_ROWS])
def test_long_words(spark, sent):
    a, b = "日本語文章" * 30, "".join(chr(0x4E00 + i * 7) for i in range(200))
    rows = [(a + "悪口雑言", 1), (a + "良い天気", 0), (b, 1), ("x" * 41 + "badend", 1), ("plain words", 0)]
    texts = [b[:150] + "悪口雑言", a, a + "悪口雑言", a + "良い天気", *["abcdefghij" * 9 + "x" * k + "badend" for k in range(45)], *[b[:k] for k in range(34, 84)]]
    same(spark, rows, texts, sent)


def test_models_sum_to_one(spark):
    rows = some_rows(spark, 20)
    model, plain = same(spark, rows, ["word"], toxicity.SENT_ROWS)
    stored = {r.end: r.p for r in toxicity.shared_backoff(common.stored(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int")), "grams")).collect()}
    assert stored.keys() == plain.lefts.keys()
    sums = defaultdict(float)
    for s, p in stored.items():
        assert math.isclose(p, plain.shared(s), rel_tol=1e-9)
    letters = {g[-1] for g in plain.grams}
    for c in list(plain.after)[:50]:
        sums[c] = sum(plain.shared(c + x) for x in letters)
    for c in list(plain.sums[1])[:50]:
        sums[f"1{c}"] = sum(plain.p(c + x, 1) for x in letters)
    assert all(math.isclose(x, 1.0, rel_tol=1e-9) for x in sums.values())


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    rows = some_rows(spark, 10)
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    table = toxicity.Table(toxicity._sorted_hashes(model.grams, "gram"), toxicity._sorted_hashes(model.contexts, "ctx"))
    texts = [" ".join(t for t, _ in rows), None, "grumblewort " * 500, "x" * 9000]
    whole = toxicity.features_of(texts, table)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 700)
    assert np.allclose(whole, toxicity.features_of(texts, table), atol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score_table(docs, toxicity.fit(docs, labels))
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    hits = out.where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = defaultdict(int, {(r.toxic, r.predicted): r["count"] for r in hits})
    assert n[1, 1] >= 0.6 * (n[1, 1] + n[1, 0]) and n[1, 1] >= 0.6 * (n[1, 1] + n[0, 1]) and n[0, 1] <= 0.1 * (n[0, 0] + n[0, 1])


def test_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, ("grim nastiness" if i % 2 else "kind meadow") + f" word{'abcdefgh'[i % 8]}") for i in range(40)] + [(None, "grim"), (7, "grim nastiness"), (41, None), (42, "")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("own")).withColumn("toxic", F.lit(5)).withColumn("key", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("__x", F.lit(3))
    model = toxicity.fit(docs, labels)
    for sent in (0, toxicity.SENT_ROWS):
        got = toxicity.with_scores(docs, model, "found", sent)
        assert got.columns == [*docs.columns, "found"] and got.count() == 44
        by = {r.text: round(r.found, 9) for r in got.collect()}
        assert by["grim nastiness wordb"] > by[""] and by[""] == by[None] and by["kind meadow worda"] < by["grim nastiness wordb"]
    assert toxicity.score_table(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score_table(docs, one).collect()} == {0.0}
    assert toxicity.chosen(docs.where("doc_id IS NOT NULL"), 10).count() < 25
