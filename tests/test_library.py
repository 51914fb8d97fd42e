"""Queries against SQL, and properties that SQL does not show."""

from __future__ import annotations

import math
import re
import time
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barspark.functions import indicators, registry, stable, windows
from barspark.functions.registry import USER, register_indicator
from barspark.operators import align, clean, frame, linear, models, parity, ranges, rolling, scan, stats
from barspark.plans import fixtures as fx
from barspark.plans import queries as library
from barspark.sources import bars as src
from barspark.sources import store
from barspark.streaming import live

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "entry_up_rate a05_bars_15m a10_slice_tail b03_common_start b04_repair_outliers b06_ffill c02_safe_resample c03_merge_timeframes c06_asof d05_histogram e09_rolling_median e11_bars_since "
    "e20_affine_scan e20_halo_chunks f16_macd f17_adx f33_kama f48_ichimoku g05_ret_vol_corr g14_wavelet h02_ready h08_folds i09_ks i11_psi i13_correlation_gap k02_find_thresholds k05_adaptive_thresholds "
    "k14_shift_sweep l01_feature_diff l07_row_distance l10_tail_convergence m04_warmup_report n01_stream_bars "
    "a01_read_bars a02_read_timeframes a09_model b14_drop_constant c08_trim_to_common e09_rolling_apply j04_oversample k02_find_thresholds_600 n02_wait_all n04_stream_features n08_replay_parity f37_parabolic_sar e18_prefix_scan f57_build_indicators g13_spectrum j09_ridge_path j02_ridge_predictions j03_isotonic i10_start_date h09_chosen_features"
).split()


@pytest.fixture(scope="module")
def bars(spark):
    return fx.bars(spark, FOLDER).cache()


def values(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in row) for row in df.values.tolist()), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = library.QUERIES[name](spark, FOLDER).toPandas(), con.sql(library.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_registry_is_whole(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert __spark_entry__.entry(spark).count() == 5


def series(spark, closes, name="x"):
    rows = [(name, datetime(2024, 1, 1) + timedelta(minutes=30 * i), *[None if v is None else float(v)] * 4, 10.0) for i, v in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double")


def ordered(df, column):
    return [r[0] for r in df.orderBy("symbol", "time").select(column).collect()]


def test_safe_resample_of_small_buckets(spark):
    rows = []
    for hour, n in ((0, 1), (1, 2), (2, 3), (3, 6)):
        rows += [("x", datetime(2024, 1, 1) + timedelta(hours=hour, minutes=5 * i), 10.0 * hour + i, 100.0 * hour + i, 1.0 * i, 10.0 * hour + i + 0.5, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double")
    got = [tuple(r)[2:] for r in align.safe_resample(df, "60 minutes").orderBy("time").collect()]
    assert got == [(0.0, 0.0, 0.0, 0.5, 1.0), (10.0, None, None, None, 0.0), (20.0, 200.0, 0.0, 20.5, 1.0), (30.0, 303.0, 0.0, 33.5, 4.0)]


@pytest.mark.parametrize("chunk", [32, 128, 4096])
def test_scans_do_not_depend_on_chunks(spark, bars, chunk):
    a = 1 - scan.span_alpha(20)
    got = scan.affine_scan(bars, {"y": ("close", a, 1 - a)}, chunk=chunk).toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    want = got.groupby("symbol")["close"].transform(lambda s: s.ewm(span=20, adjust=False).mean())
    assert np.abs(got["y"] - want).max() < 1e-9


def test_scans_of_long_series_in_levels(spark, monkeypatch):
    monkeypatch.setattr(scan, "FOLD", 4)
    n = 3_000
    df = spark.range(n).selectExpr("'x' AS symbol", "timestamp_seconds(id * 60) AS time", "sin(id) + id % 17 AS close", "CASE WHEN id % 100 = 7 THEN 0D WHEN id > 0 THEN 0.9D END AS a")
    spans = (1, 2, 200, 2_000)
    got = scan.ema(df, {f"e{k}": ("close", scan.span_alpha(k)) for k in spans}).orderBy("time").toPandas()
    for k in spans:
        assert np.allclose(got[f"e{k}"], got.close.ewm(span=k, adjust=False).mean(), rtol=1e-10)
    got = scan.varying_scan(df, "y", "a", "close", chunk=16).orderBy("time").toPandas()
    y, want = 0.0, []
    for a, b in zip(got.a.fillna(0), got.close, strict=True):
        y = a * y + b
        want.append(y)
    assert np.allclose(got.y, want)


def test_statistics_hold_no_column_in_one_task(spark):
    """No window over a single feature's values, and no cross join; the results are those of pandas and numpy."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(size=500).round(2), "y": rng.normal(size=500), "t": pd.date_range("2023-01-01", periods=500, freq="D")})
    df = spark.createDataFrame(pdf)
    got = {(r.feature, r.p): r.value for r in stats.quantiles(df, ["x", "y"], [0.0, 0.1, 0.5, 1.0]).collect()}
    for (k, p), v in got.items():
        assert v == pytest.approx(np.quantile(pdf[k], p))
    dates = stats.suggest_start_date(df, ["x", "y"], "t", least_rows=10)
    plan = dates._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for r in dates.collect():
        old, new = pdf[pdf.t < r.start], pdf[pdf.t >= r.start]
        gaps = [max(abs((old[k] <= v).mean() - (new[k] <= v).mean()) for v in pdf[k]) for k in ("x", "y")]
        assert (r.older, r.newer) == (len(old), len(new)) and r.ks == pytest.approx(np.mean(gaps))
    assert stats.suggest_start_date(df.limit(0), ["x"], "t").count() == 0
    edges = stats.equal_edges(df, ["x", "y"], 10)
    assert [r.n for r in stats.histogram(df, edges, ["x"]).filter("feature = 'x'").orderBy("bin").collect()] == np.histogram(pdf.x, 10)[0].tolist()


def test_scan_starts_at_the_first_value(spark):
    got = ordered(scan.ema(series(spark, [None, None, 4, 8, 8]), {"y": ("close", 0.5)}), "y")
    assert got == [None, None, 4.0, 6.0, 7.0]


def test_varying_scan(spark):
    rng = np.random.default_rng(3)
    a, b = rng.choice([0.0, 0.5, 0.9], 300), rng.standard_normal(300)
    rows = [("x", datetime(2024, 1, 1) + timedelta(minutes=i), float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, a double, b double")
    y, want = 0.0, []
    for p, q in zip(a, b, strict=True):
        y = p * y + q
        want.append(y)
    assert np.allclose(ordered(scan.varying_scan(df, "y", "a", "b", chunk=16), "y"), want)


def test_repair_is_sequential(spark):
    got = ordered(clean.repair_outliers(series(spark, [1, 1.2, 0, 0, 1.4, None, None, 2, 0])), "close_fixed")
    # the second zero looks at the repaired first one; a missing next value leaves a gap
    assert got[:5] == pytest.approx([1, 1.2, 0.6, (0.6 + 1.4) / 2, 1.4]) and got[5] is None and got[7:] == [2, 2]


def test_sar_and_kama(spark, bars):
    rising = indicators.parabolic_sar(series(spark, range(10, 40)))
    stops = ordered(rising, "psar")
    assert stops == sorted(stops) and all(s < 10 + i for i, s in enumerate(stops) if i)
    got = [v for v in ordered(indicators.kama(series(spark, range(1, 60))), "kama") if v is not None]
    assert len(got) == 49 and got == sorted(got)


def test_spectrum_and_wavelet(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(16)
    df = spark.createDataFrame([(list(map(float, v)),)], "v array<double>")
    row = df.select(*[e.alias(k) for k, e in stable.spectral(F.col("v"), 16).items()], stable.wavelet_energy(F.col("v")).alias("w")).first()
    power = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
    freq = np.fft.rfftfreq(16)[1:]
    assert row.fft_energy_ratio == pytest.approx(power[freq > 0.25].sum() / power.sum())
    assert row.fft_dom_freq == pytest.approx(freq[power.argmax()])
    padded = np.concatenate([v[:3][::-1], v, v[-3:][::-1]])
    want = sum(np.dot(stable.DB2_HIGH, padded[2 * k + 1 : 2 * k + 5][::-1]) ** 2 for k in range(9))
    assert row.w == pytest.approx(want)


def test_features_of_closed_bars_do_not_look_ahead(bars):
    names = ["mfi", "atr", "macd_signal", "adx", "rsi", "stoch_k", "ppo", "hv"]
    cut = ["2024-01-12", "2024-01-21"]
    got = parity.prefix_invariance(bars, lambda df, keys: indicators.add_indicators(df, names, keys, shifted=True), cut, names, rtol=1e-7, atol=1e-7)
    assert got.count() == 2 * 5 * len(names) and got.filter("is_diff = 1").count() == 0


def test_halo_is_the_whole_series(bars):
    rows = scan.with_halo(bars, 9, 50)
    a = rows.withColumn("m", windows.rolling_mean(F.col("close"), 10, windows.series("symbol", "chunk"))).filter("NOT halo")
    b = bars.withColumn("m", windows.rolling_mean(F.col("close"), 10, windows.series()))
    assert parity.feature_diff_long(a, b, ["m"]).filter("is_diff = 1").count() == 0 and a.count() == b.count()


def test_users_own_indicator(bars):
    register_indicator("half_range", "hl", lambda w: F.col("hl") / 2)
    got = indicators.add_indicators(bars, ["half_range"]).filter("abs(half_range * 2 - (high - low)) > 1e-9")
    assert got.count() == 0
    USER.features.clear()


def test_guards(spark, bars):
    with pytest.raises(ValueError, match="not finite: close"):
        parity.assert_finite(fx.dirty_bars(spark, FOLDER), ["close", "high"])
    with pytest.raises(ValueError, match="too few rows: 1H"):
        parity.assert_warmup(bars.withColumn("tf", F.lit("30T")), {"30T": 10, "1H": 1})
    own = bars.select("symbol", "time", "high", "low")
    with pytest.raises(ValueError, match="missing"):
        parity.guard_for_predict(own, ["high", "close"])
    assert [k for _, k in parity.guard_for_predict(own, ["low", "high"]).dtypes][2:] == ["float", "float"]


def test_files(spark, bars, tmp_path):
    one = bars.filter("symbol = 'view'")
    one.select(F.col("time").alias("Date"), "open", "high", "low", F.col("close").alias("Close"), "volume").coalesce(1).write.option("header", True).csv(f"{tmp_path}/30")
    got = src.read_timeframes(spark, {"30T": [f"{tmp_path}/none", f"{tmp_path}/30"], "1H": f"{tmp_path}/none"}, "30T", "view")
    assert got.count() == one.count() and got.columns == ["symbol", "tf", "time", "open", "high", "low", "close", "volume"]
    assert got.filter("close IS NULL").count() == 0
    with pytest.raises(FileNotFoundError):
        src.read_timeframes(spark, {"30T": f"{tmp_path}/none"}, "30T", "view")
    hist = stats.histogram(bars, stats.equal_edges(bars, ["close"], 5), ["close"])
    store.save_distribution(hist, f"{tmp_path}/dist")
    back = {(r.feature, r.bin): r.freq for r in store.load_distribution(spark, f"{tmp_path}/dist").collect()}
    assert back == {(r.feature, r.bin): r.freq for r in hist.collect()}
    (tmp_path / "a.txt").write_text("x_tminus3\ny\n")
    (tmp_path / "b.json").write_text('["z", "y"]')
    (tmp_path / "c.csv").write_text("feature,mismatch_cnt\nq,2\nr,0\n")
    (tmp_path / "d.csv").write_text("feature,ratio_diff\ns,0.5\nt,0.0\n")
    got = store.load_blacklist(spark, (f"{tmp_path}/a.txt",), (f"{tmp_path}/b.json",), (f"{tmp_path}/c.csv",), (f"{tmp_path}/d.csv",))
    assert {r.feature for r in got.collect()} == {"x", "y", "z", "q", "s"}
    store.write_report(stats.day_profile(frame.label_next_up(bars)), f"{tmp_path}/report", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() > 0


def test_models(spark, bars, tmp_path):
    w = windows.series()
    rows = frame.label_next_up(bars).withColumn("z", windows.zscore(F.col("close"), 10, w)).withColumn("up", F.col("z") + F.col("y")).dropna()
    model = models.fit_classifier(rows, ["z", "up"])
    scored = models.predict_proba(model, rows)
    assert scored.filter("(p >= 0.5) = (y = 1)").count() > 0.9 * rows.count()
    meta = {"window_size": 1, "neg_thr": 0.4, "pos_thr": 0.6, "feats": ["z"], "train_window_cols": ["z", "up"], "schema_version": 1}
    store.save_model(model, meta, f"{tmp_path}/m")
    loaded, back = store.load_model(spark, f"{tmp_path}/m")
    assert back == meta and models.predict_proba(loaded, rows).count() == rows.count()
    with pytest.raises(ValueError, match="lacks"):
        store.save_model(model, {}, f"{tmp_path}/n")
    few = rows.filter("y = 1 OR z > 1").withColumn("row_id", F.xxhash64("symbol", "time"))
    more = models.oversample_knn(few, ["z", "up"])
    low, high = few.filter("y = 0").agg(F.min("z"), F.max("z")).first()
    assert more.filter("synthetic").count() > 0
    assert more.filter((F.col("synthetic")) & ((F.col("z") < low - 1e-9) | (F.col("z") > high + 1e-9))).count() == 0


def test_oversampling_reaches_the_ratio(spark):
    base = [(i, 0, float(i % 7), 0.0) for i in range(1000)]
    alone = [(5000, 1, 3.0, 4.0)]
    apart = [(6000 + i, 1, 1000.0 * 3**i, -1000.0 * 2**i) for i in range(9)]
    near = [(7000 + i, 1, (i % 300) / 10, float(i // 300)) for i in range(600)]
    for own in (alone, apart, near):
        df = spark.createDataFrame(base + own, "row_id long, y int, p double, q double")
        made = models.oversample_knn(df, ["p", "q"]).filter("synthetic").select("p", "q", "y").collect()
        assert len(made) == 800 - len(own) and {r.y for r in made} == {1}
        if own is alone:
            assert {(r.p, r.q) for r in made} == {(3.0, 4.0)}  # repeated as it is
    rows = spark.createDataFrame([(r[0], [r[2], r[3]]) for r in near], "a long, x array<double>")
    found = {r.a: [n.d for n in r.n] for r in models.near_neighbours(rows, 2).collect()}
    assert len(found) == 600 and all(len(d) == 5 and d == sorted(d) for d in found.values())
    assert sum(d[0] < 0.11 for d in found.values()) > 570  # the true nearest is 0.1 away


def test_streams(spark, bars, tmp_path):
    both = bars.filter("symbol = 'view'").withColumn("tf", F.lit("30T")).unionByName(fx.bars(spark, FOLDER, "60 minutes").filter("symbol = 'view'").withColumn("tf", F.lit("1H")))
    both.select("symbol", "tf", F.col("time").cast("timestamp").alias("time"), "close").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    got = live.to_table(live.wait_all_timeframes(stream, "30T", ("1H",)), f"{tmp_path}/wait", f"{tmp_path}/wait-c")
    last = both.filter("tf = '1H'").agg(F.max("time")).first()[0]
    assert got.count() == both.filter((F.col("tf") == "30T") & (F.col("time") <= F.lit(last))).count()
    fx.scored(spark, FOLDER).filter("y IS NOT NULL").select("symbol", F.col("time").cast("timestamp").alias("time"), "close", "p", "y", "decision").write.parquet(f"{tmp_path}/scored")
    rows = spark.read.parquet(f"{tmp_path}/scored")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/scored")
    once = live.to_table(live.process_once(stream.union(stream)), f"{tmp_path}/once", f"{tmp_path}/once-c")
    assert once.count() == rows.count()
    decided = live.stream_decisions(stream.drop("decision"), lambda df: df, 0.4, 0.6)
    live.signal_sink(decided, f"{tmp_path}/latest", f"{tmp_path}/log", f"{tmp_path}/sink-c").awaitTermination()
    assert live.latest_signals(spark, f"{tmp_path}/latest").count() == 5 and spark.read.parquet(f"{tmp_path}/log").count() == rows.count()
    hist = stats.histogram(rows, stats.equal_edges(rows, ["p"], 10), ["p"])
    live.stream_drift(stream, hist, ["p"], f"{tmp_path}/drift", f"{tmp_path}/drift-c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/drift").first().psi == pytest.approx(0)
    query = live.running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows.filter("decision = y").groupBy("symbol").count().collect()
    assert {r.symbol: r.wins for r in spark.table("metrics").collect()} == {r.symbol: r["count"] for r in want}


def plain_stops(highs, lows, step, most):
    rising, rate, extreme, stop, out = True, step, highs[0], lows[0], [lows[0]]
    for high, low in zip(highs[1:], lows[1:], strict=True):
        stop = stop + rate * (extreme - stop)
        if (rising and low < stop) or (not rising and high > stop):
            stop, rate, rising = extreme, step, not rising
            extreme = high if rising else low
        elif rising and high > extreme:
            extreme, rate = high, min(rate + step, most)
        elif not rising and low < extreme:
            extreme, rate = low, min(rate + step, most)
        out.append(stop)
    return out


@pytest.mark.parametrize("kind", ["walk", "rising", "flat"])
def test_stops_of_chunks_are_those_of_a_loop(spark, kind):
    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("a", 1), ("b", 37), ("c", 1200)):
        mid = {"walk": np.cumsum(rng.normal(0, 1, n)) + 100, "rising": np.arange(n) * 0.5 + 10, "flat": np.full(n, 7.0)}[kind]
        frames.append(pd.DataFrame({"symbol": name, "time": pd.date_range("2024-01-01", periods=n, freq="15min"), "high": mid + rng.random(n), "low": mid - rng.random(n)}))
    rows = pd.concat(frames)
    got = indicators.parabolic_sar(spark.createDataFrame(rows), chunk=64).toPandas().sort_values(["symbol", "time"])
    want = np.concatenate([plain_stops(f["high"].tolist(), f["low"].tolist(), 0.018, 0.2) for f in frames])
    assert got["psar"].tolist() == want.tolist()


def test_prefix_scans_of_one_long_series(spark):
    """Every kind of scan over many ranges of one series, nulls and a null key among them, forward and backward."""
    rng = np.random.default_rng(3)
    n = 3000
    v = pd.Series(np.where(rng.random(n) < 0.6, np.nan, rng.normal(1, 0.01, n)))
    rows = [(None if k % 1000 == 999 else "s", int(k), None if math.isnan(x) else float(x)) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol string, time long, v double")
    kinds = ("sum", "count", "max", "min", "product", "last")
    got = ranges.prefix_scan(df, {k: ("v", k) for k in kinds}, ranges=13)
    assert got.count() == n
    own = got.filter("symbol = 's'").toPandas().sort_values("time").set_index("time")
    x = v[own.index]
    want = {"sum": x.cumsum().ffill(), "count": x.notna().cumsum(), "max": x.cummax().ffill(), "min": x.cummin().ffill(), "product": x.cumprod().ffill(), "last": x.ffill()}
    for k in kinds:
        np.testing.assert_allclose(own[k].to_numpy(float), want[k].to_numpy(float), rtol=1e-12)
    back = ranges.prefix_scan(df, {"n": ("v", "count"), "v": ("v", "last")}, backward=True, ranges=13).filter("symbol = 's'").toPandas().sort_values("time")
    np.testing.assert_array_equal(back["v"].to_numpy(), x.bfill().to_numpy())
    assert back["n"].tolist() == x[::-1].notna().cumsum()[::-1].tolist()


def windows_in(df) -> list[str]:
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", text)


def test_chunks_give_the_same_features_and_no_window_over_a_series(spark, bars):
    names = ["bb_high", "adx", "obv", "macd_hist", "ulcer", "kst_signal", "wma20", "vwap", "cum_ret", "kc_percent", "ichimoku_span_a_26"]
    key = ["symbol", "time"]
    for shifted in (False, True):
        want = indicators.add_indicators(bars, names, shifted=shifted).toPandas().sort_values(key)
        cut = indicators.add_indicators(bars, names, shifted=shifted, chunk=64)
        got = cut.toPandas().sort_values(key)
        assert list(got.columns) == list(want.columns)
        for n in names:
            np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), rtol=1e-9, atol=1e-9)
        found = windows_in(cut)
        assert found and all("chunk" in w or "range" in w.lower() for w in found)
    cut = stable.add_stable_features(bars, "5T", chunk=64, names=("trend_slope", "dir_entropy", "vpin", "spectral_entropy"))
    want = stable.add_stable_features(bars, "5T", names=("trend_slope", "dir_entropy", "vpin", "spectral_entropy")).toPandas().sort_values(key)
    got = cut.toPandas().sort_values(key)
    for n in want.columns[7:]:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), rtol=1e-6, atol=1e-9)


def test_features_declare_what_they_look_at(spark):
    assert indicators.R.features["bb_high"].looks() == (0, 0) and indicators.R.features["std20"].looks() == (19, 0)
    assert indicators.R.features["down_move"].looks() == (0, 1) and indicators.R.features["vroc"].looks() == (20, 0)
    for f in indicators.R.features.values():
        assert f.scanned or max(f.looks()) < 100
    own = registry.Registry()
    own.add("whole", "close", lambda w: windows.cumsum(F.col("close"), w))
    with pytest.raises(ValueError, match="whole series"):
        own.features["whole"].looks()


def plain_information(v, y, neighbors=3):
    """By all distances of each row."""
    psi = lambda n: -0.5772156649015329 + sum(1 / k for k in range(1, n))
    keep = [i for i in range(len(v)) if y.count(y[i]) > 1]
    v, y = [v[i] for i in keep], [y[i] for i in keep]
    total = []
    for i, x in enumerate(v):
        same = sorted((abs(v[j] - x), v[j]) for j in range(len(v)) if j != i and y[j] == y[i])
        d, at = same[min(neighbors, len(same)) - 1]
        low, high = at if at < x else x - d, at if at > x else x + d
        m = sum(z == x for z in v) if d == 0 else sum(low < z < high for z in v)
        total.append(psi(min(neighbors, len(same))) - psi(len(same) + 1) - psi(m))
    return max(0.0, psi(len(v)) + sum(total) / len(v))


def test_information_is_that_of_all_distances(spark):
    rng = np.random.default_rng(11)
    n = 240
    y = [["a", "b", "b", "c"][k] for k in rng.integers(0, 4, n)] + ["alone", "pair", "pair"]
    base = np.array([ord(k[0]) for k in y], float)
    columns = {"near": base + rng.normal(0, 0.5, n + 3), "far": rng.normal(0, 1, n + 3), "ties": rng.integers(0, 4, n + 3).astype(float), "flat": np.ones(n + 3)}
    rows = pd.DataFrame({**columns, "y": y})
    df = spark.createDataFrame(rows)
    df = df.unionByName(df.limit(1).withColumns({k: F.lit(float("nan")) for k in columns})).unionByName(df.limit(1).withColumn("y", F.lit(None)))
    got = {r.feature: r.mi for r in stats.mutual_information(df, list(columns), "y", chunk=17).collect()}
    for k, v in columns.items():
        assert got[k] == pytest.approx(plain_information(v.tolist(), y), abs=1e-9)


def test_correlations_of_300_columns_are_one_pass(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (400, 300)) + 1e6
    x[:, 1] = -x[:, 0]
    x[:, 2] = 5.0
    x[rng.random((400, 300)) < 0.1] = np.nan
    x[:200, 3], x[200:, 4] = np.nan, np.nan
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = {(r.i, r.j): r.r for r in stats.correlation_pairs(df, names).collect()}
    want = pd.DataFrame(x).corr().to_numpy()
    assert len(got) == 300 * 299 // 2
    for (i, j), r in got.items():
        assert (r is None and math.isnan(want[i, j])) or r == pytest.approx(want[i, j], abs=1e-7)
    assert stats.rank_by_target_corr(df, names[1:], "c0", 1).first().feature == "c1"


def test_selection_uses_training_prefixes(spark):
    """A feature that follows the label in the newest rows only is not chosen: no fold trains on them."""
    rng = np.random.default_rng(13)
    n = 400
    y = rng.integers(0, 2, n)
    old = np.where(np.arange(n) < 260, y, 0) + rng.normal(0, 0.2, n)
    new = np.where(np.arange(n) >= 300, y, 0) + rng.normal(0, 0.2, n)
    gaps = np.where(rng.random(n) < 0.1, np.nan, y + rng.normal(0, 0.3, n))
    rows = pd.DataFrame({"symbol": "s", "time": pd.date_range("2024-01-01", periods=n), "old": old, "new": new, "gaps": gaps, "copy": old, "flat": 1.0, "y": y})
    df = frame.ts_folds(spark.createDataFrame(rows), 3)
    got = stats.select_features(df, ["old", "new", "gaps", "copy", "flat"], "y", "test_fold", 2).collect()
    assert {r.feature for r in got} == {"old", "gaps"} and {r.votes for r in got} == {3}


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace

    from barspark.storage import shared_folder

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=_Conf({"spark.master": master})))
    assert shared_folder(SimpleNamespace(conf=_Conf({"spark.master": master, "spark.checkpoint.dir": "hdfs://x/y/"}))) == "hdfs://x/y"
    assert shared_folder(SimpleNamespace(conf=_Conf({"spark.master": "local[4]"}))).startswith("file:/")


def test_a_silent_timeframe_holds_nothing_up(spark, tmp_path):
    """The hourly bars stop after the first; main bars come out when event time is two hours past them, and the state stays small."""
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=30 * k)
    schema = "symbol string, tf string, time timestamp, close double"
    n, files = 40, f"{tmp_path}/in"
    for k in range(n):
        rows = [("s", "30T", at(k), float(k))] + ([("s", "1H", at(0), 0.0)] if k == 0 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        time.sleep(0.02)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    out = live.wait_all_timeframes(stream, "30T", ("1H",), wait=timedelta(hours=2))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.close: r.complete for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[0.0] is True and all(got[float(k)] is False for k in range(1, n - 6)) and float(n - 1) not in got
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) > 20 and max(sizes[10:]) <= max(sizes[:10]) + 2  # does not grow with the bars


def test_readers_see_whole_versions(spark, tmp_path):
    schema = "symbol string, time timestamp, p double"
    latest, files = f"{tmp_path}/latest", f"{tmp_path}/in"
    with pytest.raises(FileNotFoundError):
        live.latest_signals(spark, latest)
    row = lambda s, k, p: (s, datetime(2024, 1, 1, k), p)
    batches = [[row("a", 1, 0.1), row("b", 1, 0.2)], [row("a", 2, 0.3)], [row("a", 1, 0.9), row("c", 1, 0.4)], [row("b", 1, 0.5)]]
    readers = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files)
        live.signal_sink(stream, latest, f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
        readers.append(live.latest_signals(spark, latest))
        if k:  # who began to read before the batch still reads a whole version
            readers[k - 1].collect()
    assert {(r.symbol, r.p) for r in live.latest_signals(spark, latest).collect()} == {("a", 0.3), ("b", 0.5), ("c", 0.4)}
    assert {(r.symbol, r.p) for r in readers[1].collect()} == {("a", 0.3), ("b", 0.2)}
    # a version that is written but not yet current is not seen, nor one that is torn
    (tmp_path / "latest" / "version=000000000009").mkdir()
    (tmp_path / "latest" / "version=000000000009" / "part-0.parquet").write_bytes(b"torn")
    assert live.latest_signals(spark, latest).count() == 3
    assert not (tmp_path / "latest" / "version=000000000000").exists()


@pytest.mark.parametrize("before", [False, True])
def test_rolling_quantiles_are_those_of_sorted_frames(spark, before):
    rng = np.random.default_rng(15)
    n = 700
    v = pd.Series(np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 40, n) / 7))
    df = spark.createDataFrame([("s", datetime(2024, 1, 1) + timedelta(minutes=k), None if math.isnan(x) else float(x)) for k, x in enumerate(v)], "symbol string, time timestamp, v double")
    got = rolling.rolling_quantiles(df, "v", {"q10": 0.1, "q50": 0.5, "top": 1.0}, 60, 20, before, chunk=128).toPandas().sort_values("time")
    frames = (v.shift(1) if before else v).rolling(60, min_periods=20)
    for name, p in (("q10", 0.1), ("q50", 0.5), ("top", 1.0)):
        np.testing.assert_allclose(got[name].to_numpy(float), frames.quantile(p).to_numpy(float), rtol=1e-12)


def linear_rows(spark, n=4000, folds=4):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 5)) * [1.0, 1000.0, 0.01, 1.0, 0.0] + [0.0, 1e6, 3.0, -2.0, 7.0]
    x[:, 3] = 2 * x[:, 0] + 1  # collinear; the last is constant
    y = 4 * x[:, 0] - 0.003 * x[:, 1] + 50 * x[:, 2] + rng.normal(size=n)
    data = pd.DataFrame(x, columns=list("abcde")).assign(y=y, test_fold=rng.integers(0, folds, n).astype("int32"))
    data.loc[::97, "b"] = np.nan
    data.loc[::89, "y"] = np.inf
    return data, spark.createDataFrame(data).repartition(7)


def test_linear_paths_are_separate_fits(spark):
    """Every prefix and penalty has the coefficients of a fit of its own, and the errors that its predictions make."""
    data, rows = linear_rows(spark)
    names, ridges = list("abcde"), (0.0, 1.0, 500.0)
    fits = linear.ridge_path(rows, names, "y", ridges=ridges)
    found = {(r["fold"], r["ridge"]): r for r in fits.collect()}
    assert sorted(found) == [(f, r) for f in (1, 2, 3, 4) for r in ridges]
    good = np.isfinite(data[[*names, "y"]]).all(axis=1)
    for (f, ridge), row in found.items():
        own, test = data[good & (data.test_fold < f)], data[good & (data.test_fold == f)]
        mean, level = own[names].mean(), own["y"].mean()
        z = (own[names] - mean).to_numpy()
        z[:, 4] = 0.0
        scale = np.sqrt((z**2).sum(axis=0) + 1e-300)
        w = np.linalg.pinv((z / scale).T @ (z / scale) + np.diag(ridge / scale**2) * (scale > 1e-9), rcond=1e-10) @ ((z / scale).T @ (own["y"] - level)) / scale
        guess = level + (test[names] - mean).to_numpy() @ (w * (scale > 1e-9))
        assert row["n_train"] == len(own) and row["n_test"] == len(test) and row["n_skipped"] == int((~good & (data.test_fold < f)).sum())
        assert row["coefficients"] == pytest.approx((w * (scale > 1e-9)).tolist(), rel=1e-6, abs=1e-9)
        if len(test):
            assert row["mse"] == pytest.approx(float(((test["y"] - guess) ** 2).mean()), rel=1e-7)
            assert row["r2"] == pytest.approx(1 - row["mse"] / float(test["y"].var(ddof=0)), rel=1e-6)
        else:
            assert row["mse"] is None and row["r2"] is None
    said = linear.predict_path(rows, fits, names, 1.0).filter("prediction IS NOT NULL AND abs(y) < 1e300")
    errors = {r["test_fold"]: r["mse"] for r in said.groupBy("test_fold").agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse")).collect()}
    assert errors == pytest.approx({f: found[f, 1.0]["mse"] for f in (1, 2, 3)}, rel=1e-7)
    report = linear.path_report(fits).collect()
    assert [r["folds"] for r in report] == [3, 3, 3] and report[0]["mse"] == min(r["mse"] for r in report) and report[-1]["ridge"] == 500.0


def test_linear_paths_are_those_of_spark(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data, rows = linear_rows(spark)
    rows = rows.filter("abs(y) < 1e300 AND NOT isnan(b)")
    found = {r["fold"]: r for r in linear.ridge_path(rows, ["a", "b", "c"], "y", ridges=(20.0,)).collect()}
    for f in (1, 3):
        own = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows.filter(F.col("test_fold") < f))
        penalty = 20.0 / own.count() * own.agg(F.stddev_pop("y")).first()[0]  # Spark divides the penalty by the label's deviation
        model = LinearRegression(featuresCol="x", labelCol="y", regParam=penalty, standardization=False, solver="normal").fit(own)
        assert found[f]["coefficients"] == pytest.approx(model.coefficients.toArray().tolist(), rel=1e-5)
        assert found[f]["intercept"] == pytest.approx(model.intercept, rel=1e-5)


def test_linear_paths_of_odd_rows(spark):
    """No rows, prefixes without rows, and folds of gaps only."""
    kind = "a double, y double, test_fold int"
    assert linear.ridge_path(spark.createDataFrame([], kind), ["a"], "y").count() == 0
    rows = spark.createDataFrame([(None, 1.0, 0), (1.0, 2.0, 1), (2.0, 4.0, 1), (3.0, None, 2), (9.0, 9.0, None)], kind)
    found = {r["fold"]: r for r in linear.ridge_path(rows, ["a"], "y", ridges=(0.0,)).collect()}
    assert found[1]["coefficients"] is None and found[1]["mse"] is None and found[1]["n_train"] == 0 and found[1]["n_skipped"] == 1
    assert found[2]["coefficients"] == pytest.approx([2.0]) and found[2]["intercept"] == pytest.approx(0.0, abs=1e-12) and found[2]["n_test"] == 0
    assert found[3]["n_skipped"] == 2 and found[3]["n_train"] == 2


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_forward_chained_calibration(spark, method):
    """Rises with the score, lies in [0, 1], has the label's mean, and no fold's model has seen later rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x))).astype("int32")
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "test_fold": (np.arange(3000) // 1000).astype("int32")}))
    apply = models.calibrated_ensemble(rows, ["x"], method=method)
    got = apply(rows).select("x", "y", "test_fold", "calibrated").toPandas().sort_values("x")
    assert len(got) == 3000 and got.calibrated.between(0, 1).all()
    assert (got.calibrated.diff().dropna() >= -1e-9).all()
    assert abs(got.calibrated.mean() - got.y.mean()) < 0.03 and abs(got.calibrated - 1 / (1 + np.exp(-3 * got.x))).mean() < 0.05
    # with other rows in the last fold, the first fold's model and calibrator stay
    first = rows.filter("test_fold < 2")
    alone = models.calibrated_ensemble(first, ["x"], method=method)(first).agg(F.sum("calibrated")).first()[0]
    turned = rows.withColumn("y", F.when(F.col("test_fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    both = models.calibrated_ensemble(turned, ["x"], method=method)(first).agg(F.sum("calibrated")).first()[0]
    assert abs(both - alone) > 1  # the mean takes in the last fold
    with pytest.raises(ValueError, match="no fold"):
        models.calibrated_ensemble(rows.filter("test_fold = 0"), ["x"])


def test_only_some_indicators(bars):
    """Builders know closed bars only, the other blocks come as they are, and unknown names are refused."""
    got = indicators.build_indicators(bars, "30T", only=("sma10", "bb_percent"))
    assert got.columns == ["symbol", "time", *[f"30T_{k}" for k in ("open", "high", "low", "close", "volume", "sma10", "bb_percent")]]
    w = windows.series()
    want = indicators.add_indicators(bars, ["sma10", "bb_percent"]).select("symbol", "time", F.lag("sma10").over(w).alias("30T_sma10"), F.col("bb_percent").alias("30T_bb_percent"))
    assert values(got.select(*want.columns).toPandas()) == values(want.toPandas())
    assert "30T_bb_percent" not in indicators.build_indicators(bars, "30T", only=("sma10",)).columns
    with pytest.raises(KeyError, match="nothing_such"):
        indicators.build_indicators(bars, "30T", only=("sma10", "nothing_such"))


@pytest.fixture(scope="module")
def zero_prices(tmp_path_factory):
    """Events of three series whose bars have zeros as lows, as opens, as closes and as all prices."""
    rng = np.random.default_rng(2)
    rows = []
    for k, symbol in enumerate("abc"):
        for i in range(150):
            prices = (rng.random(4) * 90 + 10).round(2)
            if i >= 40:
                prices[{0: [2], 15: [0], 35: [3], 55: [0, 1, 2, 3]}.get((i + 5 * k) % 70, [])] = 0.0
            rows += [(len(rows) + j, datetime(2024, 1, 1) + timedelta(minutes=30 * i + 5 * j), symbol, float(v)) for j, v in enumerate(prices)]
    folder = tmp_path_factory.mktemp("zeros")
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet", index=False)
    return str(folder)


def told_apart(rows) -> list:
    """Values as text, so that null, infinite and not a number are three things."""
    return sorted(tuple(f"{abs(v):.9g}" if isinstance(v, float) and (v == 0 or math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def is_its_sql(spark, folder, name, got=None):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = library.QUERIES[name](spark, folder) if got is None else got
    columns = ", ".join(f'"{k}"' for k in got.columns)
    want = told_apart(con.execute(f"SELECT {columns} FROM ({library.ORACLES[name]})").fetchall())
    assert told_apart(got.collect()) == want
    return want


def test_garman_klass_of_zero_prices(spark, zero_prices):
    assert {"inf", "nan", "None"} <= {r[2] for r in is_its_sql(spark, zero_prices, "f41_garman_klass")}


def test_parkinson_of_zero_prices(spark, zero_prices):
    assert {"inf", "nan", "None"} <= {r[2] for r in is_its_sql(spark, zero_prices, "f42_parkinson")}


def test_indicator_set_of_zero_prices(spark, zero_prices):
    """In chunks, too: whatever takes quotients or logarithms of prices, and the running product that is zero after a zero close."""
    only = ("garman_klass", "parkinson", "hv", "daily_logret", "daily_ret", "cum_ret", "kst_main", "range_close_ratio", "return_difference")
    got = fx.rounded(indicators.build_indicators(fx.bars(spark, zero_prices), "30T", chunk=32, only=only), digits=4)
    want = is_its_sql(spark, zero_prices, "f57_build_indicators", got)
    assert {"inf", "-inf", "nan", "None", "-100"} <= {v for r in want for v in r}
    for name in ("f36_returns", "f40_hv"):
        is_its_sql(spark, zero_prices, name)
