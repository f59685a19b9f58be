"""Options of the lasso path, the kernel's precision, segment plans, curves, and Arrow streams of the command line."""

import hashlib
import io
import json
import sys
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depthforge import cli
from depthforge.operators import linear
from depthforge.operators.kernels import Decay, decayed
from depthforge.plans import pipeline
from depthforge.sources import dated
from depthforge.sources.views import mbo, quotes

SF = "/root/testdata/sf0.001"


def gram(seed=0, n=200, k=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k))
    y = x @ np.array([2.0, -1.0, 0.5, 0.0, -3.0, 1.0]) + rng.normal(size=n)
    return x, y, linear.Gram(x.T @ x, x.T @ y, x.sum(0), y.sum(), float(n), n)


def descent(x, y, alpha, positive=False, centre=True):
    """Coordinate descent to the minimum."""
    x, y = (x - x.mean(0), y - y.mean()) if centre else (x, y)
    beta, n = np.zeros(x.shape[1]), len(y)
    for _ in range(4000):
        for j in range(x.shape[1]):
            c = x[:, j] @ (y - x @ beta + x[:, j] * beta[j]) / n
            beta[j] = max(c - alpha, 0) if positive else np.sign(c) * max(abs(c) - alpha, 0)
            beta[j] /= x[:, j] @ x[:, j] / n
    return beta


def test_lasso_options():
    x, y, g = gram()
    names = [f"x{i}" for i in range(6)]
    for alpha in (0.0, 0.3, 2.0):
        assert np.allclose(linear.lasso_path(g, names, positive=True).at(alpha).coef, descent(x, y, alpha, positive=True), atol=1e-5)
        assert np.allclose(linear.lasso_path(g, names, fit_intercept=False).at(alpha).coef, descent(x, y, alpha, centre=False), atol=1e-5)
    cut = linear.lasso_path(g, names, alpha_min=0.7)
    assert abs(cut.alphas[-1] - 0.7) < 1e-12 and np.allclose(cut.at(0.7).coef, descent(x, y, 0.7), atol=1e-5) and np.allclose(cut.at(0.0).coef, cut.at(0.7).coef)
    lar = linear.lasso_path(g, names, method="lar")
    assert len(lar.alphas) == 7 and np.allclose(lar.at(0.0).coef, np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0])
    assert np.allclose(lar.coefs[1], linear.lasso_path(g, names).coefs[1])  # the same until a coefficient turns back
    for bad in ({"method": "other"}, {"method": "lar", "positive": True}):
        with pytest.raises(ValueError):
            linear.lasso_path(g, names, **bad)
    adapter = pipeline.LassoAdapter()
    assert (adapter.fit(g, names, {"alpha": 0.3, "positive": True}).coef >= 0).all() and (adapter.fit(g, names, {"alpha": 0.3}).coef < 0).any()
    assert linear.lasso_path(linear.Gram(g.xtx, -np.abs(g.xty) * 0, g.x_sum * 0, 0.0, 200.0, 200), names).at(0.1).coef.tolist() == [0.0] * 6


def test_single_precision(spark):
    df = quotes(spark, SF).select("publisher_id", "instrument_id", "row_nr", "ts_ns", F.col("trade_sz").cast("double").alias("x"))
    spec = [Decay("a", "x", 3600 * 10**9), Decay("b", "x", 3600 * 10**9, True)]
    want = {r.row_nr: (r.a, r.b) for r in decayed(df, spec).collect()}
    for width in (None, 100):
        out = decayed(df, spec, width=width, precision="float32")
        assert [f.dataType.simpleString() for f in out.schema][-2:] == ["float", "float"]
        for r in out.collect():
            assert all((g is None) == (w is None) and (w is None or g == float(np.float32(w)) or abs(g - w) < 1e-6 * abs(w)) for g, w in zip((r.a, r.b), want[r.row_nr], strict=True))
    with pytest.raises(KeyError):
        decayed(df, spec, precision="float16")


def test_segments(spark, tmp_path):
    assert dated.day_ranges("20240131", "gaps") == [("gap_before", "2024-01-31T00:00:00Z", "2024-01-31T13:15:00Z"), ("gap_after", "2024-01-31T20:05:00Z", "2024-02-01T00:00:00Z")]
    assert dated.day_ranges("2024-01-31") == [("full_day", "2024-01-31T00:00:00Z", "2024-02-01T00:00:00Z")] and dated.day_ranges("20240131", "window")[0][0] == "window"
    with pytest.raises(ValueError):
        dated.day_ranges("20240131", "night")
    parts = [f"{s}_{d}_t_{g}.parquet" for s in ("x", "y") for d in ("20240102", "20240103") for g in ("gap_before", "window", "gap_after")]
    for i, p in enumerate(p for p in parts if p != "y_20240103_t_window.parquet"):
        spark.range(i * 3, i * 3 + 3).coalesce(1).write.parquet(str(tmp_path / "in" / p))
    assert list(dated.plan_segments(parts, start="2024-01-03", stems=["y"])) == [("y", "20240103", "t")] and len(dated.plan_segments(parts, end="20240102")) == 2 and list(dated.plan_segments(parts[::-1], limit=1)) == [("x", "20240102", "t")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    actions = lambda **how: [p.action for p in dated.assemble_days(spark, folder, out, **how)]
    assert actions(dry_run=True) == ["write", "write", "write", "missing"] and not (tmp_path / "out").exists()
    assert actions(limit=1) == ["write"] and actions() == ["skip", "write", "write", "missing"] and actions(overwrite=True, stems=["x"]) == ["write", "write"]
    plan = dated.assemble_days(spark, folder, out, dry_run=True)[-1]
    assert plan.missing == ("window",) and spark.read.parquet(f"{out}/x_20240102_t_full_day.parquet").count() == 9


def test_curves(spark):
    network = types.SimpleNamespace(history=[{"epoch": 0, "train": 2.0, "valid": 3.0}, {"epoch": 1, "train": 1.0, "valid": None}])
    assert sorted(map(tuple, pipeline.learning_curves(spark, network).collect()), key=str) == [(0, "train", 2.0), (0, "valid", 3.0), (1, "train", 1.0), (1, "valid", None)]
    assert pipeline.learning_curves(spark, types.SimpleNamespace(history=[0.5, 0.25])).orderBy("step").collect()[1] == (1, "valid", 0.25)


def test_arrow_streams_of_the_command_line(spark, tmp_path, capsys, monkeypatch):
    events = mbo(spark, SF)
    events.coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    table, sink = events.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table, max_chunksize=100)
    try:
        cli.main([str(tmp_path / "in.parquet"), "--levels", "2", "--out", str(tmp_path / "out.parquet")])
        monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(sink.getvalue())))
        cli.main(["--input-ipc", "--format", "ipc", "--levels", "2", "--out", str(tmp_path / "out.arrows")])
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "false")
    assert len({line for line in capsys.readouterr().err.splitlines() if line.startswith("{")}) == 1 and json
    with pa.ipc.open_stream(str(tmp_path / "out.arrows")) as r:
        got = r.read_all()
    want = spark.read.parquet(str(tmp_path / "out.parquet")).orderBy("publisher_id", "instrument_id", "row_nr")
    assert got.column_names == want.columns and [tuple(r.values()) for r in got.to_pylist()] == [tuple(r) for r in want.collect()]
    for bad in ([], ["x", "--input-ipc", "--out", "y"], ["x"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_manifest_of_files(spark, tmp_path):
    """Streamed hashes are those of the whole files; folders count as their visible files."""
    for name, body in (("a.bin", b"x" * 3_000_000), ("b/c.bin", b""), ("b/_hidden", b"no"), ("b/d e.bin", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: (r.length, r.sha256) for r in dated.file_manifest(spark, [str(tmp_path / "a.bin"), f"file:{tmp_path}/b"]).collect()}
    want = {f"file:{tmp_path}/{n}": (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"x" * 3_000_000), ("b/c.bin", b""), ("b/d e.bin", b"y"))}
    assert got == want
    assert dated.file_manifest(spark, []).count() == 0
