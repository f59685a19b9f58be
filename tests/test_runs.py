import numpy as np
import pandas as pd

from depthforge.operators.book import build_depth
from depthforge.operators.kernels import Decay, decayed
from depthforge.sources.views import mbo
from depthforge.streaming import runs
from depthforge.streaming.event_time import stream_decayed_in_order, stream_future_price
from depthforge.streaming.runs import Runs
from depthforge.streaming.states import stream_decayed, stream_depth
from test_streaming import HOUR, SF, batch_labels, prices


def test_runs_merge_in_order(monkeypatch):
    """Runs on disk come back in order, ties as they came, in pieces of bounded size; no more than a run is held."""
    monkeypatch.setattr(runs, "RUN", 40)
    monkeypatch.setattr(runs, "PIECE", 7)
    g = np.random.default_rng(1)
    whole = pd.DataFrame({"t": g.integers(0, 30, 1000), "r": g.integers(0, 3, 1000), "n": range(1000), "s": [None if i % 9 == 0 else f"x{i}" for i in range(1000)]})
    for order in (["t", "r"], ["r"], []):
        r = Runs(order)
        for a in range(0, 1000, 13):
            r.add(whole.iloc[a : a + 13])
            assert r.n < 40
        assert len(r.files) > 15
        got = list(r.merged())
        assert max(map(len, got)) <= 7
        want = whole.sort_values(order, kind="stable", ignore_index=True) if order else whole
        pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), want)
    assert list(Runs(["t"]).merged()) == []


class Held:
    """A state as Spark hands it to a step."""

    def __init__(self):
        self.hasTimedOut, self.exists, self.get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value


def step_of(monkeypatch, spark, build, schema):
    """The step that ``build`` gives to Spark."""
    from pyspark.sql.group import GroupedData

    taken = []
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, step, *a: taken.append(step))
    build(spark.createDataFrame([], schema))
    return taken[0]


def test_steps_in_pieces(spark, monkeypatch):
    """A micro-batch of many frames leaves in pieces, with the sums of the batch form."""
    monkeypatch.setattr(runs, "RUN", 50)
    monkeypatch.setattr(runs, "PIECE", 8)
    df = prices(spark).where("instrument_id = 1")
    rows = df.toPandas().sample(frac=1.0, random_state=3, ignore_index=True)
    frames = [rows.iloc[a : a + 20] for a in range(0, len(rows), 20)]
    spec = [Decay("a", "price", 6 * HOUR)]
    sums = {r.row_nr: r.a for r in decayed(df, spec).collect()}
    for build in (lambda s: stream_decayed(s, spec, ["instrument_id"]), lambda s: stream_decayed_in_order(s, spec)):
        got = list(step_of(monkeypatch, spark, build, df.schema)((1,), iter(frames), Held()))
        assert max(map(len, got)) <= 16
        out = pd.concat(got)
        assert len(out) == len(rows) and np.allclose(out["a"].to_numpy(float), [sums[r] for r in out["row_nr"]])


def test_depth_in_pieces(spark, monkeypatch):
    """The depth rows of a micro-batch leave piece by piece, and are those of the batch form."""
    monkeypatch.setattr(runs, "RUN", 50)
    monkeypatch.setattr(runs, "PIECE", 8)
    df = mbo(spark, SF).where("row_nr < 1000 and instrument_id = 1")
    rows = df.toPandas().sample(frac=1.0, random_state=3, ignore_index=True)
    got = list(step_of(monkeypatch, spark, lambda s: stream_depth(s, 2), df.schema)((1, 1), (rows.iloc[a : a + 20] for a in range(0, len(rows), 20)), Held()))
    assert len(got) > 10
    last = rows["row_nr"][rows["flags"] == 128].max()
    want = sorted(r.row_nr for r in build_depth(df, 2).where(f"row_nr <= {last}").collect())
    assert sorted(pd.concat(got)["row_nr"]) == want


def test_labels_in_pieces(spark, monkeypatch):
    """Labels of a micro-batch in pieces are the batch form's; late rows are counted whole."""
    monkeypatch.setattr(runs, "RUN", 50)
    monkeypatch.setattr(runs, "PIECE", 8)
    df = prices(spark).where("instrument_id = 1")
    rows = df.toPandas().sample(frac=1.0, random_state=3, ignore_index=True)
    frames = [rows.iloc[a : a + 20] for a in range(0, len(rows), 20)]
    step, state = step_of(monkeypatch, spark, lambda s: stream_future_price(s, "price", ["1h", "6h"], [2.0, 1.0], delay="1h"), df.schema), Held()
    got = list(step((1,), iter(frames), state))
    want = batch_labels(df, HOUR)
    assert {r: None if pd.isna(v) else v for f in got for r, v in zip(f["row_nr"], f["future_price"], strict=True)} == {r: v for r, v in want.items() if r in set(rows["row_nr"])}
    assert len(got) > 3
    late = list(step((1,), iter(frames), state))
    assert sum(map(len, late)) < len(rows) and all(f["late"].all() and f["n_late"].nunique() == 1 for f in late if f["late"].any())


def test_labels_hold_no_more_than_their_horizon(spark, monkeypatch):
    """However many rows a micro-batch has, labels leave in frames as long as a piece and what waits for its horizon."""
    monkeypatch.setattr(runs, "RUN", 50)
    monkeypatch.setattr(runs, "PIECE", 8)
    rows = pd.DataFrame({"publisher_id": 1, "instrument_id": 1, "row_nr": range(2000), "ts_ns": np.arange(2000) * HOUR // 2, "price": np.arange(2000) * 1.0})
    mixed = rows.sample(frac=1.0, random_state=3, ignore_index=True)
    schema = "publisher_id int, instrument_id int, row_nr long, ts_ns long, price double"
    step = step_of(monkeypatch, spark, lambda s: stream_future_price(s, "price", "1h", delay="1h"), schema)
    got = list(step((1, 1), (mixed.iloc[a : a + 100] for a in range(0, 2000, 100)), Held()))
    assert max(map(len, got)) <= 24
    out = pd.concat(got)
    assert out["row_nr"].tolist() == list(range(1996)) and out["future_price"].tolist() == [i + 2.0 for i in range(1996)] and not out["late"].any()
