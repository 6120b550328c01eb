"""ARC to WARC: line forms, faults, revisits by a plain version, odd rows and real files."""

import gzip
import hashlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from beatloom.llm import common, warc


def archive(version, *records):
    return warc.arc_head("x.arc", version) + b"".join(warc.arc_record(version, *r) for r in records)


def converted(spark, df):
    return warc.read_warc(warc.convert(warc.write_arc(df)))


@pytest.mark.parametrize("version", [1, 2])
def test_lines(version):
    data = archive(version, ("http://a/", b"one\n\ntwo"), ("http://a b/c d", b""), ("http://c/", b"x" * 5000))
    for form in (data, gzip.compress(data), data.replace(b"text/html", b"text/html; charset=utf-8")):
        got = list(warc.parse_arc(form))
        assert [(r["url"], r["block"]) for r in got] == [("http://a/", b"one\n\ntwo"), ("http://a b/c d", b""), ("http://c/", b"x" * 5000)]
        assert all(r["date"] == "20000101000000" and r["mime"].startswith("text/html") for r in got)
        assert version == 1 or {r["status"] for r in got} == {"200"}


FAULTS = {"cut": archive(1, ("http://a/", b"whole"), ("http://b/", b"long enough"))[:-8], "line": archive(1, ("http://a/", b"whole")) + b"no record line\n", "head": b"http://a 0.0.0.0 20000101000000 text/html 1\nx\n", "end": archive(2, ("http://a/", b"whole")) + b"http://b"}


@pytest.mark.parametrize("fault", FAULTS)
def test_faults(spark, fault):
    with pytest.raises(ValueError):
        list(warc.parse_arc(FAULTS[fault]))
    df = spark.createDataFrame([("bad", bytearray(FAULTS[fault])), ("good", bytearray(archive(2, ("http://g/", b"g"))))], "name string, content binary")
    with pytest.raises(Exception, match="ARC"):
        warc.read_arc(df).collect()
    kept = {(r.rec, bytes(r.payload)) for r in warc.read_arc(df, strict=False).collect()}
    n = 0 if fault == "head" else 1
    assert kept == {("good#000000000", b"g")} | ({("bad#000000000", b"whole")} if n else set())
    (e,) = warc.arc_errors(df).collect()
    assert (e["name"], e.records) == ("bad", n) and "ARC" in e.error


def test_revisits_and_odd_rows(spark):
    big, other = "<p>" + "é" * 900, "z" * 1000
    rows = [(1, "http://a b/", big), (2, None, big), (9, "http://x/\t", big), (3, "http://c/", None), (4, "http://d/", "x"), (5, "http://d/", "x"), (None, "http://n/", other), (7, "http://o/", other), (8, "é", "日本語" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("name", "content", "rec", "key", "original")})
    got = {r.page_id: r for r in converted(spark, df).collect()}
    assert len(got) == len(rows)
    top = defaultdict(lambda: -1)
    for i, _, h in rows:
        top[h] = max(top[h], -1 if i is None else i)
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != top[h]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h] if again else None)
    assert got[1].url == "http://a%20b/" and got[2].url == "about:blank" and got[9].url == "http://x/%09"


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "y" * 2000)] * 5 + [(None, "u", "y" * 2000)] * 3, "page_id long, url string, html string")
    got = converted(spark, df).collect()
    assert sorted(r.record_type for r in got) == ["response"] + ["revisit"] * 7
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1} and next(r.page_id for r in got if r.record_type == "response") == 1
    assert converted(spark, df.limit(0)).count() == 0


def test_synthesised_fields(spark):
    df = spark.createDataFrame([(1, "http://a/", "p" * 1500), (2, "http://b/", "p" * 1500)], "page_id long, url string, html string")
    (content,) = [bytes(r.content) for r in warc.convert(warc.write_arc(df.coalesce(1))).collect()]
    records = {f["warc-target-uri"]: (f, b) for f, b in warc.parse_warc(content) if f["warc-type"] != "warcinfo"}
    (f1, b1), (f2, b2) = records["http://a/"], records["http://b/"]
    assert f1["warc-type"] == "revisit" and f1["warc-refers-to"] == f2["warc-record-id"] and f1["warc-refers-to-date"] == f2["warc-date"] == "2000-01-01T00:00:00Z"
    assert f1["warc-payload-digest"] == f2["warc-payload-digest"] == warc.digest32(b"p" * 1500) and f2["warc-block-digest"] == warc.digest32(b2) and b"p" * 9 not in b1
    assert warc.iso_date("1996") == "1996-01-01T00:00:00Z" and warc.iso_date("199612312359") == "1996-12-31T23:59:00Z"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(archive(1, ("http://a/", b"a")))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(archive(2, ("http://b/", b"b"))))
    files = warc.read_files(spark, f"{tmp_path}/in")
    assert {(r.url, bytes(r.payload)) for r in warc.read_arc(files).collect()} == {("http://a/", b"a"), ("http://b/", b"b")}
    out = warc.export_archives(warc.convert(files.repartition(2)), f"{tmp_path}/out").collect()
    for r in out:
        data = (tmp_path / "out" / r["name"]).read_bytes()
        assert len(data) == r.bytes and list(warc.parse_warc(data))[0][0]["warc-type"] == "warcinfo"


def test_foreign_page_ids(spark):
    """A header that is no number, or too large a one, gives null and ends no job."""
    for value, want in ((b"7", 7), (b" -3 ", -3), (b"abc", None), (b"1_000", None), (b"", None), (b"9" * 19, None), (b"1.5", None)):
        assert warc.page_key(b"HTTP/1.1 200 OK\r\nX-Page-Id:" + value + b"\r\nA: b") == want
    block = lambda key, body: b"HTTP/1.1 200 OK\r\nX-Page-Id: " + key + b"\r\n\r\n" + body
    content = archive(1, ("http://a/", block(b"abc", b"a")), ("http://b/", block(b"5", b"b")))
    df = spark.createDataFrame([("x.arc", bytearray(content))], "name string, content binary")
    for strict in (True, False):
        assert [(r.url, r.key) for r in warc.read_arc(df, strict).orderBy("url").collect()] == [("http://a/", None), ("http://b/", 5)]


def test_archives_one_at_a_time(spark, tmp_path, monkeypatch):
    """Of the archives of a task, whatever their number, a writer or reader holds one; tables that no step reads any more are gone."""
    rows = [(i, f"http://{i}/", chr(97 + i % 20) * (1 << 20)) for i in range(26)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    groups = {}

    def look(name):
        for f in tmp_path.glob(f"beatloom/{name}-[0-9a-f]*/*.parquet"):
            m = pq.ParquetFile(f).metadata
            groups[name] = groups.get(name, []) + [m.row_group(i).num_rows for i in range(m.num_row_groups)]
            assert not m.row_group(0).column(0).is_stats_set, groups

    drop = common.drop_stored
    monkeypatch.setattr(common, "drop_stored", lambda df: (look("arc"), drop(df)))
    got = {r.page_id: r for r in warc.op4_arc_to_warc(spark, str(tmp_path)).collect()}
    look("warc")
    assert set(groups["warc"]) == {1} and len(groups["warc"]) >= 5
    assert groups["arc"] == [1] * 7
    assert {d.name.rsplit("-", 1)[0] for d in (tmp_path / "beatloom").iterdir()} == {"warc", "warc-originals"}
    assert len(got) == 26 and {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {i: i + 20 for i in range(6)}
    assert all(r.payload_bytes == 1 << 20 and r.payload_digest == hashlib.sha1(rows[i][2].encode()).hexdigest() for i, r in got.items())
