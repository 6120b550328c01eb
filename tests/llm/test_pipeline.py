"""The pipeline's stages, each against a plain version of it on the rows that the stage before kept."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beatloom.llm import common, mixing, neardup, toxicity
from tests.llm.test_near import shingle_set
from tests.llm.test_toxicity import Plain, features

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "key", "size", "k1", "__copy", "score"]


def plain_mix(rows):
    """Copies of every (doc_id, source, text), from the definition: fill by weight up to three times, then take by the key."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    keys = [hashlib.md5(("~" if i is None else str(i)).encode()).hexdigest()[:9] for i, _, _ in rows]
    by = defaultdict(int)
    for (_, s, _), n in zip(rows, sizes, strict=True):
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(by.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * by[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * by[s]
            left -= target[s]
        open_ -= full
    copies = [0] * len(rows)
    for s in order:
        own = [k for k in range(len(rows)) if rows[k][1] == s]
        if not by[s]:
            continue
        base = math.floor(target[s] / by[s])
        rest, upto = target[s] - base * by[s], 0
        groups = defaultdict(list)
        for k in own:
            copies[k] = base
            groups[keys[k]].append(k)
        for key in sorted(groups):
            n = sum(sizes[k] for k in groups[key])
            if upto + n <= rest or (upto <= rest and upto + n - rest < rest - upto):
                for k in groups[key]:
                    copies[k] = min(3, base + 1)
            upto += n
            if upto > rest:
                break
    return copies, target, by


def documents(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), size=6))
    rows = []
    for i in range(60):
        bad = i % 4 == 1
        text = " ".join([word() for _ in range(30)] + ["grimblex", "vilezork", "nastywugh"] * (3 if bad else 0))
        rows.append((i, text, ["en", "fr", None][i % 3], ["web", "books", None, "code"][i % 4 if i < 56 else 0]))
    base = [word() for _ in range(150)]
    edited = [*base[:75], "other", *base[76:]]
    rows += [(70, " ".join(base), "en", "web"), (71, " ".join(edited), "en", "web"), (72, rows[4][1], "fr", "books"), (73, rows[4][1].upper(), "fr", None)]
    rows += [(80, None, "en", "web"), (81, "", "en", None), (82, "12 34 !?", None, "web"), (83, "日本語の文章です", "ja", "web"), (5, rows[5][1], rows[5][2], rows[5][3]), (6, rows[6][1], rows[6][2], rows[6][3])]
    rows += [(None, rows[8][1], "en", "web"), (None, rows[8][1], "en", "web"), (None, "short null id", None, None), (None, None, None, None)]
    rows += [(90, "word " * 5000, "en", "books")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "k", 7, 8, 9, "s") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, size int, k1 int, __copy int, score string")
    assert df.columns == COLUMNS
    return df


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 == 1)) for i in range(60)] + [(1, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
    return d


def ids(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "mix", "pack"]
    docs = common.table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        kept[name] = (before, docs.collect())
        assert name == "pack" or docs.columns == COLUMNS

    before, after = kept["language"]
    assert ids(after) == ids([r for r in before if any(c.isalpha() for c in r.text or "")])

    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL AND doc_id IS NOT NULL").collect()
    crc = lambda i: zlib.crc32(str(i).encode())
    rows = [(r.text, y.toxic, crc(r.doc_id) // 4 % 4 == 3) for r in before for y in labels if r.doc_id == y.doc_id and crc(r.doc_id) % 4 != 2]
    plain = Plain([(t, y) for t, y, own in rows if not own])
    w = toxicity._logistic(np.array([features(plain, t) for t, _, own in rows if own]), np.array([float(y) for _, y, own in rows if own]))
    score = lambda t: 1 / (1 + math.exp(-(np.dot(w[:-1], features(plain, t)) + w[-1])))
    assert ids(after) == ids([r for r in before if score(r.text) < toxicity.THRESHOLD])
    assert len(after) < len(before) and not any("grimblex" in r.text for r in after)

    before, after = kept["near_dedup"]
    sets = {r.doc_id: shingle_set(r.text) for r in before if r.doc_id is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = {r.doc_id: r for r in before if r.doc_id is not None and root[r.doc_id] == r.doc_id}
    assert ids(after) == ids([*want.values(), *[r for r in before if r.doc_id is None]]) and {71, 72, 73}.isdisjoint(want) and 70 in want

    before, after = kept["mix"]
    copies, _, _ = plain_mix([(r.doc_id, r.source, r.text) for r in before])
    want = Counter()
    for r, n in zip(before, copies, strict=True):
        want[r.doc_id, r.text] += n
    assert ids(after) == +want and any(r.doc_id is None for r in after) and max(copies) > 1

    before, after = kept["pack"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        own = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r.doc_id, k, s, len(own[s : s + 2048]), zlib.crc32(own[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(own), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    fill = defaultdict(list)
    for r in after:
        fill[r.sequence_id].append((r.offset, r.length))
    for x in fill.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(fill) <= math.ceil(sum(r.length for r in after) / 2048) + 1

    again = corpus_pipeline.run(spark, sf)
    assert again.count() == len(after)


def test_empty_tables(spark, sf, tmp_path):
    docs, labels = common.table(spark, sf, "documents").limit(0), common.table(spark, sf, "labels").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_are_not_multiplied(spark):
    rows = [(None, f"word{i} " * 9, "web") for i in range(20)] + [(i, f"other{i} " * 9, "books") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies, target, by = plain_mix([(r[0], r[2], r[1]) for r in rows])
    assert corpus_pipeline.mix_stage(spark, docs, "").count() == sum(copies) <= 60


@pytest.mark.parametrize("case", ["capped", "empty_source", "no_words", "ties"])
def test_mix_against_plain(spark, case):
    rng = np.random.default_rng(len(case))
    rows = {
        "capped": [(i, "abc"[i % 3] if i < 9 else "c", "w " * int(rng.integers(1, 40))) for i in range(200)],
        "empty_source": [(i, [None, "a", "b", "zero"][i % 4], None if i % 4 == 3 else "w " * (i % 7)) for i in range(120)],
        "no_words": [(i, "a", None) for i in range(5)] + [(None, None, "")],
        "ties": [(i // 5, "é" if i % 2 else "z", "w w w") for i in range(100)],
    }[case]
    df = common.stored(mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit(1))), "words")
    copies, target, by = plain_mix(rows)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in got) == Counter((i, s, len((t or "").split()), n) for (i, s, t), n in zip(rows, copies, strict=True))
    assert all(math.isclose(r.target, target.get(r.source, 0.0), rel_tol=1e-9, abs_tol=1e-9) and r.source_size == by[r.source] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_near_dedup_takes_light_edits(spark):
    words = [f"w{i}" for i in range(105)]
    two, many = words.copy(), words.copy()
    two[30] = two[60] = "other"  # 91 of 111 shingles are shared, 0.82
    many[20] = many[45] = many[70] = "changed"  # 86 of 116, 0.74
    rows = [(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(many)), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "3", "None"]
    assert {r.doc_id for r in neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").collect()} == {1, 2, 3}


def test_repeated_ids_give_the_same_row(spark):
    rows = [(1, f"text {i} of one id", "s") for i in range(8)]
    once = [neardup.kept_documents(spark.createDataFrame(x, "doc_id long, text string, source string").repartition(n)).collect() for x, n in ((rows, 1), (rows[::-1], 5))]
    assert once[0] == once[1] and len(once[0]) == 1


def test_bands_miss_few():
    for percent in (80, 85):
        same = percent / 100 + (1 - percent / 100) * neardup.collision_rate()
        assert (1 - same**neardup.ROWS) ** neardup.bands_for(percent) < 1e-5
