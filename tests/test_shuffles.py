"""Epochs, their signals and references: what their plans deal out, and odd rows against plain versions."""

import pytest

from beatloom.functions.labels import map_labels
from beatloom.plans import preprocess

EPOCH = "subject string, kind string, epoch_idx int, start long, stop long"
SAMPLE = "subject string, channel string, pos long, value double"


def plan(spark, df):
    """The plan's lines as first made, before sizes are known."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def dealt(lines):
    return [line for line in lines if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]


def test_events_are_not_dealt_out_by_label(spark):
    events = spark.createDataFrame([(1, " View"), (2, "view"), (3, "other "), (4, None), (5, ""), (2, "view")], "id int, label string")
    m = spark.createDataFrame([("view", "rest"), ("VIEW ", "rest"), (None, "never"), ("none", None)], "label string, condition string")
    out = map_labels(events, m)
    assert sorted(map(tuple, out.select("id", "mapped").collect()), key=str) == sorted([(1, "rest"), (2, "rest"), (2, "rest"), (3, "other"), (4, None), (5, "")], key=str)
    lines = plan(spark, out)
    assert any("BroadcastHashJoin" in line for line in lines) and not any("__key" in line for line in dealt(lines))
    assert map_labels(events, m.limit(0)).where("mapped = 'view'").count() == 3 and map_labels(events.limit(0), m).count() == 0


@pytest.mark.parametrize("chunk", [1, 4, 5, 64])
def test_pieces_of_epochs(spark, chunk):
    """Windows on borders of chunks, over many of them, into a short last chunk, behind the recording; null and repeated rows."""
    signals = {("s", c): [k * f + 0.1 for k in range(18)] for c, f in (("ECG", 1.0), ("Fz", -1.0), ("Pulse", 2.0))} | {("t", "ECG"): [float(k) for k in range(9)]}
    signals["s", "Fz"][6] = None
    samples = [(s, c, k, v) for (s, c), x in signals.items() for k, v in enumerate(x)] + [(None, "ECG", 0, 1.0), ("s", None, 3, 1.0), ("s", "ECG", None, 1.0)]
    windows = [(0, 1), (0, 4), (4, 8), (3, 9), (5, 18), (17, 18), (16, 20), (2, 2)]
    rows = [(s, "task", k, a, b) for s in ("s", "t", "none") for k, (a, b) in enumerate(windows)] + [(None, "task", 0, 0, 4), ("t", "rest", 0, 0, 4), ("t", "rest", 1, None, 4)]
    epochs = spark.createDataFrame(rows, EPOCH)
    got = preprocess.epoch_signals(epochs, preprocess.chunks_of(spark.createDataFrame(samples, SAMPLE), chunk), chunk)
    assert dict(got.dtypes)["samples"] == "array<float>"
    got = {(r.subject, r.kind, r.epoch_idx, r.channel): r.samples for r in got.where("channel IS NOT NULL").collect()}
    f = lambda x: None if x is None else pytest.approx(x, rel=1e-6)
    for s, kind, k, a, b in rows:
        for c in ("ECG", "Fz", "Pulse"):
            x = signals.get((s, c))
            if x is None or a is None or a // chunk * chunk >= len(x) or a == b and a % chunk == 0 and a == 0:
                assert (s, kind, k, c) not in got
            else:
                assert got[s, kind, k, c] == [f(v) for v in x[a:b]]
    aux = spark.createDataFrame([("s", "ECG", "Pulse"), ("s", "ECG", "BIO1"), ("t", "ECG", None), (None, "ECG", "Pulse")], "subject string, ecg_channel string, ppg_channel string")
    x = preprocess.with_aux(epochs, preprocess.epoch_signals(epochs, preprocess.chunks_of(spark.createDataFrame(samples, SAMPLE), chunk), chunk), aux)
    assert x.columns[:5] == ["subject", "kind", "epoch_idx", "start", "stop"] and sorted(x.columns[5:]) == ["ecg", "ppg"]
    out = [r for r in x.collect() if r.start is not None and r.stop - r.start == 4]
    s_rows = [r for r in out if r.subject == "s" and r.epoch_idx == 1]
    assert sorted(r.ppg == [0.0] * 4 for r in s_rows) == [False, True] and all(r.ecg == [f(v) for v in signals["s", "ECG"][:4]] for r in s_rows)
    assert all(r.ecg == [0.0] * 4 and r.ppg == [0.0] * 4 for r in out if r.subject in ("none", None)) and len([r for r in out if r.subject in ("none", None)]) == 4


def test_samples_and_pieces_are_dealt_out_once(spark):
    """Chunks lie where their join wants them, pieces of epochs where those of ECG and PPG do."""
    epochs = spark.createDataFrame([("s", "task", 0, 0, 4)], EPOCH)
    signals = preprocess.epoch_signals(epochs, preprocess.chunks_of(spark.createDataFrame([("s", "ECG", k, 1.0) for k in range(8)], SAMPLE), 4), 4)
    out = preprocess.with_aux(epochs, signals, spark.createDataFrame([("s", "ECG", "Pulse")], "subject string, ecg_channel string, ppg_channel string"))
    lines = dealt(plan(spark, out))
    assert sum("REPARTITION_BY_COL" in line for line in lines) == 2 and len(lines) == 7, lines
    assert out.count() == 1


def test_reference_deals_samples_out_once(spark):
    """Null keys and places go, null values stay null and count for nothing, repeated channels count each, a place of one channel is 0."""
    rows = [("s", "Fz", 0, 1.0, 7), ("s", "Cz", 0, 3.0, 7), ("s", "Pz", 0, None, 7), ("s", "Fz", 1, 5.0, 7), ("s", "Fz", 1, 5.0, 7), ("s", "Cz", 1, 2.0, 7), ("t", "Fz", 0, 4.0, 8), ("t", None, 1, None, 8)]
    nan = [("u", "Fz", 0, float("nan"), 9), ("u", "Cz", 0, 1.0, 9)]
    gone = [(None, "Fz", 0, 1.0, 7), ("s", "Fz", None, 9.0, 7), (None, None, None, None, None)]
    df = spark.createDataFrame(rows + nan + gone, "subject string, channel string, pos long, value double, run int")
    out = preprocess.average_reference(df)
    assert out.columns == ["subject", "pos", "channel", "value", "run"]
    want = [("s", 0, "Fz", -1.0, 7), ("s", 0, "Cz", 1.0, 7), ("s", 0, "Pz", None, 7), ("s", 1, "Fz", 1.0, 7), ("s", 1, "Fz", 1.0, 7), ("s", 1, "Cz", -2.0, 7), ("t", 0, "Fz", 0.0, 8), ("t", 1, None, None, 8)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*want, ("u", 0, "Fz", float("nan"), 9), ("u", 0, "Cz", float("nan"), 9)]))
    two = preprocess.average_reference(df, ("subject", "run"))
    assert two.columns == ["subject", "run", "pos", "channel", "value"] and two.count() == 10
    assert preprocess.average_reference(df.limit(0)).count() == 0
    assert len(dealt(plan(spark, preprocess.average_reference(df)))) == 1
