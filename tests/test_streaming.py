"""Streams over files: order, lateness, restarts, missing values."""

import uuid

import numpy as np
import pandas as pd
import pytest

from linkcast.streaming import online, parity, runs, scoring, windowed

SCHEMA = "link string, ts timestamp_ntz, id long, x double"
NAN = float("nan")


@pytest.fixture()
def place(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def at(seconds):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seconds)).to_pydatetime()


def part(spark, rows):
    return spark.createDataFrame([(k, None if t is None else at(t), i, x) for k, t, i, x in rows], SCHEMA)


def run_windows(spark, place, parts, slide=None):
    source, out, checkpoint = place("in"), place("out"), place("ck")

    def run():
        stream = runs.file_stream(spark, source, SCHEMA)
        return runs.drain(runs.to_parquet(windowed.windowed_statistics(stream, ["link"], "ts", "x", "10 seconds", slide, "5 seconds"), out), checkpoint)

    runs.feed([part(spark, p) for p in parts], source, run)
    return spark.read.parquet(out), checkpoint


def test_windows_late_rows_and_what_is_held(spark, place):
    parts = [
        [("a", 1, 1, 1.0), ("a", 9, 2, 3.0), ("b", 3, 3, NAN), (None, 4, 4, 7.0), ("a", None, 5, 9.0), ("a", 16, 6, 5.0)],
        [("a", 2, 7, 100.0), ("a", 12, 8, None), ("a", 38, 9, 6.0)],  # the first comes after its window was given out
    ]
    found, checkpoint = run_windows(spark, place, parts)
    rows = {(r.link, r.window_start.second): r for r in found.collect()}
    assert set(rows) == {("a", 0), ("b", 0), (None, 0), ("a", 10)}
    assert (rows["a", 0].n, rows["a", 0].mean, rows["a", 0].min, rows["a", 0].max) == (2, 2.0, 1.0, 3.0)
    assert rows["a", 0].std == pytest.approx(2**0.5)
    assert (rows["b", 0].n, rows["b", 0].mean, rows["b", 0].entries) == (0, None, 1)
    assert (rows["a", 10].n, rows["a", 10].entries) == (1, 2)
    assert windowed.open_entries(spark, checkpoint) == 1
    assert windowed.late_entries(8, found, spark, checkpoint) == 1  # the row without a time is in no window


def test_windows_of_a_batch_are_the_same_without_lateness(spark, place):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], float(t), i, float(rng.normal())) for i, t in enumerate(np.sort(rng.uniform(0, 200, 300)))]
    found, _ = run_windows(spark, place, [rows[:100], rows[100:200], rows[200:]], "5 seconds")
    batch = windowed.windowed_statistics(part(spark, rows), ["link"], "ts", "x", "10 seconds", "5 seconds")
    given = found.select("link", "window_start")
    assert found.count() > 60
    assert parity.differing(found, batch.join(given, ["link", "window_start"], "left_semi"), ["link", "window_start"]).count() == 0


def run_online(spark, place, parts, spec):
    source, out, checkpoint = place("in"), place("out"), place("ck")

    def run():
        with runs.settings(spark, {runs.PROVIDER: runs.ROCKSDB}):
            stream = runs.file_stream(spark, source, SCHEMA)
            return runs.drain(runs.to_parquet(online.online_features(stream, "link", "ts", "id", "x", "5 seconds", spec), out), checkpoint)

    runs.feed([part(spark, p) for p in parts], source, run)
    return spark.read.parquet(out).orderBy("link", "seq").toPandas()


def test_online_features_of_rows_out_of_order(spark, place):
    spec = online.Spec((1, 2), (3,), (0.5,))
    rng = np.random.default_rng(5)
    times = np.arange(40.0)
    times = times.tolist()
    rows = [("a", t, int(t), float(rng.normal())) for t in times] + [("b", t, 100 + int(t), 2.0 * float(t)) for t in times[::4]]
    rows += [("a", 7.0, 3, 50.0)]  # a tie in time: the order column decides
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 4))
    late = ("a", 0.5, 999, -1.0)
    got = run_online(spark, place, [arriving[:25], [late, *arriving[25:40]], arriving[40:]], spec)
    # A tie in time: the order column decides.
    want = pd.DataFrame(rows, columns=["link", "ts", "row", "x"]).sort_values(["link", "ts", "row"])
    want["seq"] = want.groupby("link").cumcount()
    by = want.groupby("link")["x"]
    want["x_diff"] = by.diff()
    for k in spec.taps:
        want[f"x_diff_lag{k}"] = want.groupby("link")["x_diff"].shift(k)
    for s in ("mean", "std", "min", "max"):
        want[f"x_rolling_{s}_3"] = by.transform(lambda v, s=s: getattr(v.rolling(3, 1), s)())
    want["x_ema_0_5"] = by.transform(lambda v: v.ewm(alpha=0.5, adjust=False).mean())
    want = want[want.ts <= 39 - 5].reset_index(drop=True)
    assert 999 not in set(got["row"])
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, atol=1e-12)


def test_online_features_of_missing_values_and_keys(spark, place):
    spec = online.Spec((1,), (2,), (0.5,))
    parts = [[("a", 0, 1, 1.0), ("a", 1, 2, None), ("a", 2, 3, 4.0), ("a", 3, 4, 6.0), (None, 1, 5, 1.0), ("a", None, 6, 1.0), ("a", 30, 7, 0.0)]]
    got = run_online(spark, place, parts, spec)
    assert got["row"].tolist() == [1, 2, 3, 4] and got["seq"].tolist() == [0, 1, 2, 3]
    assert got["x_diff"].isna().tolist() == [True, True, True, False] and got["x_diff"][3] == 2.0
    assert got["x_rolling_mean_2"].tolist() == [1.0, 1.0, 4.0, 5.0]
    assert got["x_ema_0_5"].isna().tolist() == [False, True, True, True]


def test_features_do_not_depend_on_where_the_stream_is_cut():
    spec = online.Spec((1, 4), (2, 7), (0.3,))
    x = np.random.default_rng(8).normal(size=30)
    whole, _ = online.features_of(spec, np.zeros(0), x, np.zeros(1), True)
    ring, averages, parts = np.zeros(0), np.zeros(1), []
    for lo, hi in ((0, 1), (1, 2), (2, 9), (9, 30)):
        columns, averages = online.features_of(spec, ring, x[lo:hi], averages, lo == 0)
        ring = np.concatenate([ring, x[lo:hi]])[-spec.reach:]
        parts.append(columns)
    for k, column in enumerate(whole):
        np.testing.assert_allclose(np.concatenate([p[k] for p in parts]), column, atol=1e-12)


def test_a_replayed_batch_is_there_once(spark, place):
    source, out, checkpoint = place("in"), place("out"), place("ck")
    parts = [part(spark, [("a", float(10 * k + j), 10 * k + j, 1.0) for j in range(5)]) for k in range(3)]
    written = []
    folder = scoring.batch_folder(out)

    def write(batch, number):
        written.append(number)
        folder(batch, number)

    start = lambda w: scoring.to_batches(runs.file_stream(spark, source, SCHEMA), w)
    assert parity.replay(parts, source, checkpoint, write, start, crash_at=1) == 1
    assert written == [0, 1, 1, 2]
    assert sorted(r.id for r in scoring.read_batches(spark, out).collect()) == [10 * k + j for k in range(3) for j in range(5)]


def test_differing_finds_changed_missing_and_repeated_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, v double, t string")
    a = make([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, None), (4, 4.0, "z"), (4, 4.0, "z")])
    b = make([(1, 1.0 + 1e-9, "x"), (2, 2.5, "y"), (4, 4.0, "z"), (5, None, "w")])
    got = {r.k: (r.in_stream, r.in_batch, r.changed) for r in parity.differing(a, b, ["k"]).collect()}
    assert got == {
        2: (True, True, ["v"]), 3: (True, False, ["_rows", "v"]), 4: (True, True, ["_rows"]), 5: (False, True, ["_rows", "t"]),
    }


def test_settings_are_put_back(spark):
    before = spark.conf.get(runs.PROVIDER, None)
    with pytest.raises(ValueError), runs.settings(spark, {runs.PROVIDER: runs.ROCKSDB, "spark.linkcast.none": "1"}):
        assert spark.conf.get(runs.PROVIDER) == runs.ROCKSDB
        raise ValueError
    assert spark.conf.get(runs.PROVIDER, None) == before and spark.conf.get("spark.linkcast.none", None) is None


class Held(dict):
    """Map, value and timers of one key, and the most rows that were read or written at once."""

    def __init__(self):
        super().__init__()
        self.value, self.most, self.timers = None, 0, []

    getMapState = getValueState = lambda self, *args: self
    listTimers = lambda self: self.timers
    deleteTimer = lambda self, at: None
    registerTimer = lambda self, at: self.timers.append(at)
    exists = lambda self: len(self) > 0 or self.value is not None
    get = lambda self: self.value
    removeKey = dict.__delitem__

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.most = max(self.most, len(value[0]))
        self[key] = value

    getValue = dict.__getitem__


def test_online_state_is_never_held_whole(monkeypatch):
    """Rows come and go in slices, however many of a link wait for the watermark."""
    monkeypatch.setattr(online, "SLICE", 100)
    monkeypatch.setattr(online, "BUCKET", 3_600_000_000)
    spec, n = online.Spec((1,), (3,), (0.3,)), 5_000
    rng = np.random.default_rng(4)
    order = rng.permutation(n)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"at": order * 60_000_000, "row": order, "x": x[order]})
    processor, pending, ring = online.OnlineFeatures("link", spec), Held(), Held()
    processor.init(pending)
    processor.pending, processor.ring = pending, ring
    clock = type("Clock", (), {"mark": -1, "getCurrentWatermarkInMs": lambda self: self.mark})()
    batches = (pdf[k:k + 100] for k in range(0, n, 100))
    assert not list(processor.handleInputRows(("a",), batches, clock))
    assert pending.most <= 100
    clock.mark = (n - 105) * 60_000
    frames = list(processor.handleExpiredTimer(("a",), clock, None))
    assert max(map(len, frames)) <= 160 and len(frames) > 30
    clock.mark = n * 60_000
    frames += list(processor.handleExpiredTimer(("a",), clock, None))
    got = pd.concat(frames)
    assert got["seq"].tolist() == got["row"].tolist() == list(range(n)) and not len(pending)
    whole, _ = online.features_of(spec, np.zeros(0), x, np.zeros(1), True)
    for name, column in zip(spec.names(), whole):
        np.testing.assert_allclose(got[name], column, rtol=1e-9)
