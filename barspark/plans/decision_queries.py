"""Queries of decisions, backtests, models, parity, guards and streams, and SQL that says the same."""

from __future__ import annotations



from pyspark.sql import functions as F

from barspark.functions import windows as x
from barspark.operators import decide, frame, linear, models, parity, scan, stats
from barspark.plans import fixtures as fx
from barspark.plans.indicator_queries import BARS, W, fr
from barspark.plans.operator_queries import B30, COUNTS, LAB, METRICS, SCORED, SECOND, T, named_bars, on_scored, r
from barspark.storage import shared_folder
from barspark.streaming import live

c = F.col
QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# --- K ---
add("k01_decide", on_scored("symbol", "time", "decision", "signal")(lambda s: s.withColumn("signal", decide.signal(c("decision")))), f"WITH {SCORED} SELECT symbol, {T}, CAST(decision AS BIGINT) AS decision, CASE decision WHEN 1 THEN 'BUY' WHEN 0 THEN 'SELL' ELSE 'NONE' END AS signal FROM scored")
GRID = """g AS (SELECT unnest(range(0, 51)) AS k), b AS (SELECT k AS i, count(*) FILTER (WHERE p * 50 <= k + 1e-9 AND y = 0) AS tn, count(*) FILTER (WHERE p * 50 <= k + 1e-9 AND y = 1) AS fn FROM g, scored GROUP BY 1),
a AS (SELECT k AS j, count(*) FILTER (WHERE p * 50 >= k - 1e-9 AND y = 1) AS tp, count(*) FILTER (WHERE p * 50 >= k - 1e-9 AND y = 0) AS fp FROM g, scored GROUP BY 1),
t AS (SELECT i / 50 AS lo, j / 50 AS hi, tp, fp, tn, fn, (SELECT count(*) FROM scored WHERE y IS NOT NULL) AS n FROM b, a WHERE i < j),
m AS (SELECT *, (tp + fp + tn + fn) / n AS confident, (tp + fp) / nullif(tp + fp + tn + fn, 0) AS buy, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS bal, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)"""
add("k02_find_thresholds", on_scored("lo", "hi", "score", "confident", "buy")(lambda s: decide.find_thresholds(s, steps=50)), f"WITH {SCORED}, {GRID} SELECT {r('lo', 'hi', 'score=(f1 + bal) / 2', 'confident', 'buy')} FROM m WHERE round(hi - lo, 9) >= 0.05 AND confident >= 0.5 AND tp + fp > 0 AND tn + fn > 0 AND buy BETWEEN 0.3 AND 0.7 ORDER BY round((f1 + bal) / 2, 12) DESC, m.lo, m.hi LIMIT 1")
_FINE = GRID.replace("51", "601").replace("50", "600")
add("k02_find_thresholds_600", on_scored("lo", "hi", "score", "confident", "buy")(lambda s: decide.find_thresholds(s, steps=600)), f"WITH {SCORED}, {_FINE} SELECT {r('lo', 'hi', 'score=(f1 + bal) / 2', 'confident', 'buy')} FROM m WHERE round(hi - lo, 9) >= 0.05 AND confident >= 0.5 AND tp + fp > 0 AND tn + fn > 0 AND buy BETWEEN 0.3 AND 0.7 ORDER BY round((f1 + bal) / 2, 12) DESC, m.lo, m.hi LIMIT 1")
add("k03_find_thresholds_accuracy",on_scored("lo", "hi", "accuracy", "coverage")(lambda s: decide.find_thresholds_accuracy(s, steps=50)), f"WITH {SCORED}, {GRID} SELECT {r('lo', 'hi', 'accuracy', 'coverage=confident')} FROM m WHERE confident >= 0.5 ORDER BY round(m.accuracy, 12) DESC, m.lo, m.hi LIMIT 1")
add("k04_adjust_thresholds", on_scored("symbol", "time", "regime", "neg_thr", "pos_thr")(lambda s: decide.adjust_thresholds(s.withColumn("atr", c("high") - c("low")), 0.4, 0.6)),
    f"""WITH {SCORED}, k AS (SELECT *, lag(high - low) OVER {W} AS a, lag(volume) OVER {W} AS v FROM scored), m AS (SELECT *, a / nullif(avg(a) OVER {fr(50)}, 0) AS ra, v / nullif(avg(v) OVER {fr(50)}, 0) AS rv FROM k),
g AS (SELECT *, CASE WHEN ra > 1.5 OR rv < 0.5 THEN 'HIGH' WHEN ra < 0.5 AND rv > 1.5 THEN 'LOW' ELSE 'NORMAL' END AS regime FROM m), h AS (SELECT *, CASE regime WHEN 'HIGH' THEN 0.02 WHEN 'LOW' THEN -0.02 ELSE 0 END AS mv FROM g)
SELECT symbol, {T}, regime, {r('neg_thr=greatest(0, least(0.4 - mv, 0.5))', 'pos_thr=least(1, greatest(0.6 + mv, 0.5))')} FROM h""")
_ADA = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
add("k05_adaptive_thresholds", on_scored("symbol", "time", "neg_thr", "pos_thr")(lambda s: decide.adaptive_thresholds(s, n=100, least=50)), f"WITH {SCORED} SELECT symbol, {T}, {r(f'neg_thr=CASE WHEN count(p) OVER {_ADA} >= 50 THEN quantile_cont(p, 0.1) OVER {_ADA} ELSE 0.01 END', f'pos_thr=CASE WHEN count(p) OVER {_ADA} >= 50 THEN quantile_cont(p, 0.9) OVER {_ADA} ELSE 0.99 END')} FROM scored")
add("k06_resolve_uncertain", on_scored("symbol", "time", "decision")(lambda s: decide.resolve_uncertain(s, most_share=0.1)),
    f"WITH {SCORED}, k AS (SELECT *, count(*) FILTER (WHERE decision = -1) OVER (PARTITION BY symbol) AS u, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol, decision ORDER BY abs(p - 0.5) DESC, time) AS i FROM scored) SELECT symbol, {T}, CAST(CASE WHEN decision = -1 AND i <= u - floor(n * 0.1) THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END ELSE decision END AS BIGINT) AS decision FROM k")
add("k07_metrics", on_scored()(decide.classification_metrics), f"WITH {SCORED}, k AS (SELECT symbol, {COUNTS} FROM scored GROUP BY 1) SELECT {METRICS.format(keys='symbol')} FROM k")
LABELS = "count(*) FILTER (WHERE d = 1 AND y = 1) AS tp, count(*) FILTER (WHERE d = 1 AND y = 0) AS fp, count(*) FILTER (WHERE d = 0 AND y = 0) AS tn, count(*) FILTER (WHERE d = 0 AND y = 1) AS fn, count(*) FILTER (WHERE d <> -1) AS decided, count(*) AS n"
add("k07_metrics_labels", lambda spark, d: fx.rounded(decide.classification_metrics(fx.table(spark, d, "labels").withColumn("g", (c("doc_id") % 3).cast("int")), "quality", "toxic", ("g",))), f"WITH k AS (SELECT doc_id % 3 AS g, {LABELS} FROM (SELECT doc_id, quality AS d, toxic AS y FROM labels) GROUP BY 1) SELECT {METRICS.format(keys='CAST(g AS BIGINT) AS g')} FROM k")
LEDGER = """v AS (SELECT *, CASE WHEN y IS NULL THEN 'UNKNOWN' WHEN decision = -1 THEN 'NONE' WHEN decision = y THEN 'WIN' ELSE 'LOSS' END AS verdict FROM {src}),
w AS (SELECT *, count(*) FILTER (WHERE verdict = 'WIN') OVER g AS wins, count(*) FILTER (WHERE verdict = 'LOSS') OVER g AS losses, count(*) FILTER (WHERE verdict = 'NONE') OVER g AS nones FROM v WINDOW g AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING))"""
_LED = f"symbol, {T}, verdict, wins, losses, nones, {r('cum_accuracy=100 * wins / nullif(wins + losses, 0)', 'cum_coverage=100 * (wins + losses) / nullif(wins + losses + nones, 0)')}"
_LC = ("symbol", "time", "verdict", "wins", "losses", "nones", "cum_accuracy", "cum_coverage")
add("k08_ledger", on_scored(*_LC)(decide.running_ledger), f"WITH {SCORED}, {LEDGER.format(src='scored')} SELECT {_LED} FROM w")
add("k16_day_report", on_scored(*_LC)(lambda s: decide.day_report(s, "2024-01-17")), f"WITH {SCORED}, dy AS (SELECT * FROM scored WHERE CAST(time AS DATE) = DATE '2024-01-17'), {LEDGER.format(src='dy')} SELECT {_LED} FROM w")
add("k09_pip_profit", on_scored("symbol", "time", "profit", "cum_profit")(decide.pip_profit), f"WITH {SCORED}, m AS (SELECT *, coalesce(CASE decision WHEN 1 THEN lead(close) OVER {W} - close WHEN 0 THEN close - lead(close) OVER {W} ELSE 0 END, 0) AS profit FROM scored) SELECT symbol, {T}, {r('profit', 'cum_profit=sum(profit) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)')} FROM m")
SRET = "sr AS (SELECT *, CASE WHEN lead(close) OVER {w} IS NOT NULL THEN CASE WHEN {d} = 1 THEN lead(close) OVER {w} / nullif(close, 0) - 1 ELSE 0 END END AS strategy_return FROM scored)"
for k in (0, 1):
    add(f"k10_strategy_returns_{k}", on_scored("symbol", "time", "strategy_return")(lambda s, k=k: decide.strategy_returns(s, lag=k)), f"WITH {SCORED}, {SRET.format(w=W, d='lag(decision) OVER ' + W if k else 'decision')} SELECT symbol, {T}, {r('strategy_return')} FROM sr")
PERF = f"""{SCORED.replace('p >= 0.6', 'p >= 0.97')}, {SRET.format(w=W, d='decision')}, gr AS (SELECT *, ln(1 + strategy_return) AS g FROM sr WHERE strategy_return IS NOT NULL), eq AS (SELECT *, exp(sum(g) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM gr),
fl AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) - equity AS f FROM eq)"""
_PC = "coalesce(CASE WHEN stddev_samp(strategy_return) > 0 THEN avg(strategy_return) / stddev_samp(strategy_return) * sqrt(252 * 48) ELSE 0 END, 0)"


def rare(s):
    """A strategy that seldom buys, so that its running product stays in range."""
    return decide.strategy_returns(s.withColumn("decision", decide.decide(c("p"), 0.4, 0.97)))


add("k11_performance", on_scored("symbol", "sharpe", "max_drawdown", "equity", digits=3)(lambda s: decide.performance(rare(s)).withColumns({"max_drawdown": F.log10(1 + c("max_drawdown")), "equity": F.log10("equity")})),
    f"WITH {PERF} SELECT symbol, {r(f'sharpe={_PC}', 'max_drawdown=log10(1 + max(f))', 'equity=log10(arg_max(equity, time))', digits=3)} FROM fl GROUP BY 1")
add("k13_fitness", on_scored("symbol", "fitness")(lambda s: decide.performance(rare(s)).join(decide.classification_metrics(s), "symbol").withColumn("fitness", decide.fitness(c("sharpe"), c("max_drawdown"), c("balanced_accuracy"), 0.2))),
    f"WITH {PERF}, pf AS (SELECT symbol, {_PC} AS s, max(f) AS dd FROM fl GROUP BY 1), o AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN 0 ELSE -1 END AS d FROM scored), cm AS (SELECT symbol, {LABELS} FROM o GROUP BY 1), bl AS (SELECT symbol, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS b FROM cm) SELECT symbol, {r('fitness=CASE WHEN b < 0.2 THEN 0 ELSE 0.4 * (tanh(s / 5) + 1) / 2 + 0.4 * (1 - least(dd, 1)) + 0.2 * b END')} FROM pf JOIN bl USING (symbol)")
PAIRS = [(0.3, 0.7), (0.4, 0.6)]
add("k14_shift_sweep", on_scored()(lambda s: decide.shift_sweep(s, PAIRS)),
    f"""WITH {SCORED}, m AS (SELECT *, unnest([-2, -1, 0, 1, 2]) AS shift, unnest([lag(y, 2) OVER {W}, lag(y, 1) OVER {W}, y, lead(y, 1) OVER {W}, lead(y, 2) OVER {W}]) AS t FROM scored), k AS (SELECT shift, lo, hi, t, CASE WHEN p >= hi THEN 1 WHEN p <= lo THEN 0 ELSE -1 END AS d FROM m, (VALUES (0.3, 0.7), (0.4, 0.6)) v(lo, hi) WHERE t IS NOT NULL)
SELECT CAST(shift AS BIGINT) AS shift, {r('lo', 'hi', 'accuracy=coalesce(count(*) FILTER (WHERE d = t) / nullif(count(*) FILTER (WHERE d <> -1), 0), 0)', 'coverage=count(*) FILTER (WHERE d <> -1) / count(*)')} FROM k GROUP BY k.shift, k.lo, k.hi""")


def _families(s):
    keep = ["symbol", "time", "decision"]
    other = s.withColumn("decision", decide.decide(c("p"), 0.3, 0.7))
    return decide.compare_ensembles(s.select(*keep).withColumn("family", F.lit("wide")).unionByName(other.select(*keep).withColumn("family", F.lit("narrow"))), s.select("symbol", "time", "y"))


add("k15_compare_ensembles", on_scored()(_families), f"WITH {SCORED}, f AS (SELECT 'wide' AS family, y, decision AS d FROM scored UNION ALL SELECT 'narrow', y, CASE WHEN p >= 0.7 THEN 1 WHEN p <= 0.3 THEN 0 ELSE -1 END FROM scored), k AS (SELECT family, {LABELS} FROM f GROUP BY 1) SELECT {METRICS.format(keys='family')} FROM k")

# --- J: votes in SQL, models by their own tests ---
THREE = ("p", "p2", "p3")


def three():
    """Three probabilities made of one."""
    return {"p": c("p"), "p2": 1 - c("p") / 2, "p3": c("p") * c("p")}


_THREE = f"{SCORED}, tri AS (SELECT *, 1 - p / 2 AS p2, p * p AS p3 FROM scored)"
add("j05_ensemble_proba", on_scored("symbol", "time", "m", "v")(lambda s: s.withColumns(three()).withColumns({"m": decide.ensemble_proba(list(THREE)), "v": decide.ensemble_vote(list(THREE))})), f"WITH {_THREE} SELECT symbol, {T}, {r('m=(p + p2 + p3) / 3')}, CAST((CAST(p >= 0.5 AS INT) + CAST(p2 >= 0.5 AS INT) + CAST(p3 >= 0.5 AS INT)) * 2 > 3 AS BIGINT) AS v FROM tri")
_VB = " + ".join(f"CASE WHEN {k} >= 0.6 THEN 1 ELSE 0 END" for k in THREE)
_CF = " + ".join(f"CASE WHEN {k} >= 0.6 OR {k} <= 0.4 THEN 1 ELSE 0 END" for k in THREE)
add("j07_ensemble_actions", on_scored("symbol", "time", "votes_buy", "confident_models", "action")(lambda s: s.withColumns(three()).withColumns(decide.ensemble_actions({k: (0.4, 0.6) for k in THREE}, 2))),
    f"WITH {_THREE}, k AS (SELECT *, {_VB} AS b, {_CF} AS n FROM tri) SELECT symbol, {T}, CAST(b AS BIGINT) AS votes_buy, CAST(n AS BIGINT) AS confident_models, CASE WHEN n < 2 THEN 'NONE' WHEN b / nullif(n, 0) >= 0.7 THEN 'BUY' WHEN b / nullif(n, 0) <= 0.3 THEN 'SELL' ELSE 'NONE' END AS action FROM k")
add("j08_vote_table", on_scored()(lambda s: decide.vote_table(stats.unpivot(s.withColumns(three()), ["symbol", "time"], list(THREE), "model", "p"))), f"WITH {_THREE}, u AS (SELECT symbol, time, unnest([p, p2, p3]) AS v FROM tri) SELECT symbol, {T}, count(*) FILTER (WHERE v >= 0.5) AS votes_buy, count(*) FILTER (WHERE v <= 0.4 OR v >= 0.6) AS confident_models, {r('mean_confidence=avg(abs(v - 0.5) * 2)')} FROM u GROUP BY symbol, time")
add("j10_class_weights", on_scored()(lambda s: models.class_weights(s.filter("y IS NOT NULL"))), f"WITH {SCORED}, k AS (SELECT y, count(*) AS n FROM scored WHERE y IS NOT NULL GROUP BY 1) SELECT CAST(y AS BIGINT) AS y, n, {r('weight=(SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n)')} FROM k")
add("j11_bias_penalty", on_scored()(lambda s: decide.bias_penalty(s.withColumn("u", (c("p") > 0.02).cast("int")), "u", share=0.5, keys=("symbol",))), f"WITH {SCORED}, k AS (SELECT symbol, avg(CAST(p > 0.02 AS INT)) AS share_up FROM scored GROUP BY 1) SELECT symbol, {r('share_up', 'penalty=CASE WHEN share_up > 0.5 OR share_up < 0.5 THEN 0.1 ELSE 0 END')} FROM k")
_HALVES = "time {o} TIMESTAMP '2024-01-15'"


def _stability(s):
    s = s.withColumn("model", c("symbol"))
    return decide.stability_report(s.filter("time < '2024-01-15'"), s.filter("time >= '2024-01-15'"))


_ACC = "coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
add("j12_stability_report", on_scored()(_stability),
    f"""WITH {SCORED}, a AS (SELECT symbol, {COUNTS} FROM scored WHERE {_HALVES.format(o='<')} GROUP BY 1), b AS (SELECT symbol, {COUNTS}, avg(decision) AS u FROM scored WHERE {_HALVES.format(o='>=')} GROUP BY 1),
x AS (SELECT symbol, {_ACC} AS accuracy, {_F1} AS f1 FROM a), y AS (SELECT symbol, {_ACC} AS live_accuracy, {_F1} AS live_f1, CASE WHEN u > 0.9 OR u < 0.1 THEN 0.1 ELSE 0 END AS penalty FROM b)
SELECT symbol AS model, {r('accuracy', 'f1', 'live_accuracy', 'live_f1', 'penalty', 'drift=live_accuracy - accuracy', 'stability_index=1 - abs(live_accuracy - accuracy) - penalty')} FROM x JOIN y USING (symbol)""")
FEATURES = ["high", "low", "close", "volume"]


def _framed(spark, d):
    w = x.series()
    rows = frame.label_next_up(fx.bars(spark, d))
    rows = rows.withColumns({"z": x.zscore(c("close"), 10, w), "pos": x.pos_in_channel(c("close"), 10, w), "dv": x.diff(c("volume"), w)}).dropna()
    return frame.ts_folds(rows, 2)


XS = ["z", "pos", "dv"]


def _classifier(spark, d):
    """Metrics of each algorithm on the last fold; trained on the rows before it."""
    rows = _framed(spark, d)
    train, test = rows.filter("test_fold < 2"), rows.filter("test_fold = 2")
    out = None
    for algo, params in (("logreg", {}), ("rf", {"numTrees": 10}), ("gbt", {"maxIter": 5}), ("svm", {"maxIter": 20}), ("mlp", {"maxIter": 20})):
        scored = models.predict_proba(models.fit_classifier(train, XS, algo=algo, **params), test).withColumn("decision", (c("p") >= 0.5).cast("int")).withColumn("model", F.lit(algo))
        own = decide.classification_metrics(scored, keys=("model",))
        out = own if out is None else out.unionByName(own)
    return fx.rounded(out)


def _regressor(spark, d):
    rows = _framed(spark, d)
    out = None
    for algo in ("linear", "ridge", "poly", "rf", "gbt"):
        fitted = models.fit_regressor(rows.filter("test_fold < 2"), XS, "close", algo).transform(rows.filter("test_fold = 2"))
        own = fitted.agg(F.avg(F.abs(c("prediction") - c("close"))).alias("mae")).select(F.lit(algo).alias("model"), "mae")
        out = own if out is None else out.unionByName(own)
    return fx.rounded(out, digits=3)


def _calibrated(spark, d):
    rows = _framed(spark, d)
    oof = models.out_of_fold(rows, XS)
    return fx.rounded(models.calibrate(oof)(oof).groupBy("symbol").agg(F.avg("calibrated").alias("calibrated"), F.avg(c("y").cast("double")).alias("up")), digits=4)


def _oversampled(spark, d):
    rows = _framed(spark, d).filter("y = 1 OR minute(time) = 0").withColumn("row_id", F.xxhash64("symbol", "time"))
    return fx.rounded(models.oversample_knn(rows, XS).groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n")))


#: Counts only: which rows are drawn and which neighbours they meet is random.
_OVERSAMPLED = f"""WITH {B30}, {LAB}, m AS (SELECT *, count(close) OVER {fr(10)} AS k, max(close) OVER {fr(10)} - min(close) OVER {fr(10)} AS wide FROM lab WHERE y IS NOT NULL),
n AS (SELECT y, count(*) AS n FROM m WHERE k >= 10 AND wide > 0 AND (y = 1 OR minute(time) = 0) GROUP BY 1), w AS (SELECT min(n) AS few, CAST(floor(0.8::DOUBLE * max(n)) AS BIGINT) AS want FROM n)
SELECT CAST(y AS BIGINT) AS y, false AS synthetic, n FROM n UNION ALL SELECT CAST(y AS BIGINT), true, want - n FROM n, w WHERE n = few AND want > n"""


add("j01_classifiers", _classifier)
add("j02_regressors", _regressor)
add("j03_calibrate", _calibrated)
add("j04_oversample", _oversampled, _OVERSAMPLED)
add("j09_grid", lambda spark, d: fx.rounded(models.grid_evaluate(_framed(spark, d), XS, [{"algo": "logreg"}, {"algo": "logreg", "regParam": 0.1}, {"algo": "rf", "numTrees": 5}])))

RIDGES = (0.0, 1.0, 100.0)


def _path(spark, d):
    """Coefficients and errors of every training prefix and penalty."""
    fits = linear.ridge_path(_framed(spark, d), XS, "close", ridges=RIDGES)
    weights = [F.get("coefficients", F.lit(i)).alias(f"w_{k}") for i, k in enumerate(XS)]
    return fx.rounded(fits.select("fold", "ridge", "n_train", "n_test", "n_skipped", "intercept", *weights, "mse", "r2"))


def _path_predictions(spark, d):
    rows = _framed(spark, d)
    return fx.rounded(linear.predict_path(rows, linear.ridge_path(rows, XS, "close", ridges=(1.0,)), XS, 1.0), "symbol", "time", "test_fold", "prediction")


_SPREADS = [("z", "z", "a11"), ("z", "pos", "a12"), ("z", "dv", "a13"), ("pos", "pos", "a22"), ("pos", "dv", "a23"), ("dv", "dv", "a33"), ("z", "close", "b1"), ("pos", "close", "b2"), ("dv", "close", "b3")]
#: The three coefficients by Cramer's rule.
_FRAMED = f"""WITH {B30}, {LAB}, wi AS (SELECT *, count(close) OVER {fr(10)} AS k, avg(close) OVER {fr(10)} AS mid, stddev_pop(close) OVER {fr(10)} AS dev, min(close) OVER {fr(10)} AS lo, max(close) OVER {fr(10)} AS hi, volume - lag(volume) OVER {W} AS dv FROM lab),
fm AS (SELECT symbol, time, close, y, (close - mid) / (dev + 1e-12) AS z, (close - lo) / (hi - lo + 1e-12) AS pos, dv, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS m FROM wi WHERE y IS NOT NULL AND k >= 10 AND hi > lo),
fd AS (SELECT *, CAST(CASE WHEN i <= m - 2 * (m // 3) OR m < 3 THEN 0 ELSE ceil((i - (m - 2 * (m // 3))) / (m // 3)) END AS BIGINT) AS fold FROM fm),
sp AS (SELECT f, ridge, count(*) AS n, avg(z) AS mz, avg(pos) AS mpos, avg(dv) AS mdv, avg(close) AS my, {', '.join(f"covar_pop({a}, {b}) * count(*)" + (" + ridge" if a == b else "") + f" AS {name}" for a, b, name in _SPREADS)}
FROM fd, (VALUES (1), (2), (3)) g(f), (VALUES {', '.join(f'({v}::DOUBLE)' for v in RIDGES)}) h(ridge) WHERE fold < f GROUP BY f, ridge),
cf AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM sp),
ws AS (SELECT *, (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS w_z, (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS w_pos,
(a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS w_dv FROM cf),
ft AS (SELECT *, my - w_z * mz - w_pos * mpos - w_dv * mdv AS intercept FROM ws),
pd AS (SELECT fd.*, ridge, intercept + w_z * z + w_pos * pos + w_dv * dv AS prediction FROM fd JOIN ft ON fold = f)"""
_PATH = f"""{_FRAMED}, te AS (SELECT fold AS f, ridge, count(*) AS n_test, avg(pow(close - prediction, 2)) AS mse, var_pop(close) AS total FROM pd GROUP BY 1, 2)
SELECT CAST(f AS BIGINT) AS fold, n AS n_train, coalesce(n_test, 0) AS n_test, CAST(0 AS BIGINT) AS n_skipped, {r('ridge', 'intercept', 'w_z', 'w_pos', 'w_dv', 'mse', 'r2=1 - mse / total')} FROM ft LEFT JOIN te USING (f, ridge)"""
add("j09_ridge_path", _path, _PATH)
add("j02_ridge_predictions", _path_predictions, f"{_FRAMED} SELECT symbol, {T}, fold AS test_fold, {r('prediction')} FROM pd WHERE ridge = 1")


def _isotonic(s):
    steps = s.withColumn("p", F.floor(c("p") * 100) / 100).filter("y IS NOT NULL")
    return models.calibrate(steps, method="isotonic")(steps).select("symbol", "time", "p", "calibrated")


#: What pooling adjacent violators comes to: the greatest, over the starts before a step, of the least mean up to an end after it.
add("j03_isotonic", on_scored("symbol", "time", "p", "calibrated")(_isotonic),
    f"""WITH {SCORED}, sx AS (SELECT symbol, time, floor(p * 100) / 100 AS p, y FROM scored WHERE y IS NOT NULL), st AS (SELECT p, sum(y) AS s, count(*) AS n FROM sx GROUP BY 1), us AS (SELECT p, s, n, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS us, sum(n) OVER (ORDER BY p) AS un FROM st),
mn AS (SELECT j.i AS j, k.i AS k, (k.us - j.us + j.s) / (k.un - j.un + j.n) AS mean FROM us j JOIN us k ON k.i >= j.i), lo AS (SELECT j, us.i, min(mean) AS least FROM mn JOIN us ON us.i >= j AND us.i <= k GROUP BY 1, 2), iso AS (SELECT i, max(least) AS calibrated FROM lo GROUP BY 1)
SELECT symbol, {T}, {r('p', 'calibrated')} FROM sx JOIN us USING (p) JOIN iso USING (i)""")


def _chained(spark, d):
    """Mean calibrated probability and share of rises per symbol, by a model and a calibrator for each fold."""
    rows = _framed(spark, d)
    return fx.rounded(models.calibrated_ensemble(rows, XS, method="isotonic")(rows).groupBy("symbol").agg(F.avg("calibrated").alias("calibrated"), F.avg(c("y").cast("double")).alias("up"), F.count(F.lit(1)).alias("n")), digits=4)


add("j03_time_series_cv", _chained)

# --- L ---
DIFF = f"""{SECOND}, lg AS (SELECT a.symbol, a.time, unnest(['close', 'p']) AS feature, unnest([a.close, a.p]) AS a, unnest([b.close, b.p]) AS b FROM scored a JOIN feed b USING (symbol, time)),
dl AS (SELECT *, abs(a - b) AS abs_diff, abs(a - b) / nullif(abs(b), 0) AS rel_diff, CASE WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 0 ELSE 1 END AS is_diff FROM lg)"""


def diff(make, *names, digits=6):
    def query(spark, d):
        s = fx.scored(spark, d)
        return fx.rounded(make(parity.feature_diff_long(s, fx.second_feed(s), ["close", "p"])), *names, digits=digits)

    return query


add("l01_feature_diff", diff(lambda v: v), f"WITH {DIFF} SELECT symbol, {T}, feature, {r('a', 'b', 'abs_diff', 'rel_diff')}, CAST(is_diff AS BIGINT) AS is_diff FROM dl")
add("l02_diff_summary", diff(parity.feature_diff_summary), f"WITH {DIFF} SELECT feature, count(*) AS tests, CAST(sum(is_diff) AS BIGINT) AS n_diff, {r('ratio_diff=sum(is_diff) / count(*)', 'max_diff=max(abs_diff)', 'mean_abs_diff=avg(abs_diff)')} FROM dl GROUP BY 1")
add("l03_row_diff_list", diff(lambda v: parity.row_diff_list(v).select("symbol", "time", F.array_join("features", ",").alias("features"), "n_diff")), f"WITH {DIFF} SELECT symbol, {T}, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE is_diff = 1), '') AS features, CAST(sum(is_diff) AS BIGINT) AS n_diff FROM dl GROUP BY symbol, time")


def _tails(spark, d):
    s = fx.scored(spark, d)
    return fx.rounded(parity.tail_row_diff(s, fx.second_feed(s).filter("minute(time) = 0"), ["close", "p"]), "symbol", "feature", "a", "b", "is_diff", "not_finite")


add("l04_tail_row_diff", _tails, f"WITH {SECOND}, x AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1), z2 AS (SELECT * FROM feed WHERE minute(time) = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1), lg AS (SELECT symbol, unnest(['close', 'p']) AS feature, unnest([x.close, x.p]) AS a, unnest([z2.close, z2.p]) AS b FROM x JOIN z2 USING (symbol)) SELECT symbol, feature, {r('a', 'b')}, CAST(abs(a - b) > 1e-4 + 1e-2 * abs(b) AS BIGINT) AS is_diff, CAST(0 AS BIGINT) AS not_finite FROM lg")


def _pred(s):
    other = fx.second_feed(s)
    return parity.prediction_compare(s, other.withColumn("decision", decide.decide(c("p"), 0.4, 0.6)))


_PCMP = f"""{SECOND}, fd AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN 0 ELSE -1 END AS db FROM feed), j AS (SELECT a.p AS pa, a.decision AS da, a.y, b.p AS pb, b.db FROM scored a JOIN fd b USING (symbol, time)),
pc AS (SELECT count(*) AS n, 100 * count(*) FILTER (WHERE abs(pa - pb) <= 1e-6) / count(*) AS same_p, 100 * count(*) FILTER (WHERE da = db) / count(*) AS same_decision, 100 * count(*) FILTER (WHERE da = y AND da <> -1) / count(*) FILTER (WHERE da <> -1 AND y IS NOT NULL) AS accuracy_a, 100 * count(*) FILTER (WHERE db = y AND db <> -1) / count(*) FILTER (WHERE db <> -1 AND y IS NOT NULL) AS accuracy_b, 100 * count(*) FILTER (WHERE da <> -1) / count(*) AS coverage_a, 100 * count(*) FILTER (WHERE db <> -1) / count(*) AS coverage_b FROM j)"""
add("l05_prediction_compare", on_scored()(_pred), f"WITH {_PCMP} SELECT n, {r('same_p', 'same_decision', 'accuracy_a', 'accuracy_b', 'coverage_a', 'coverage_b')} FROM pc")
add("l06_diff_reason", diff(parity.diff_reason, digits=5), f"WITH {DIFF}, k AS (SELECT feature, avg(CASE WHEN (a IS NULL) <> (b IS NULL) THEN 1.0 ELSE 0.0 END) AS null_share, avg(CASE WHEN abs(b) > 1e-12 THEN a / b END) AS ratio_mean, stddev_pop(CASE WHEN abs(b) > 1e-12 THEN a / b END) AS ratio_std FROM dl WHERE is_diff = 1 GROUP BY 1) SELECT feature, {r('null_share', 'ratio_mean', 'ratio_std', digits=5)}, CASE WHEN null_share > 0.6 THEN 'insufficient_history' WHEN abs(ratio_mean - 1) > 0.2 AND ratio_std < 0.2 THEN 'scale_mismatch' ELSE 'other' END AS reason FROM k")
add("l07_row_distance", diff(lambda v: parity.row_distance(v, 1).select("symbol", "time", "l2", "max_abs", F.array_join("top", ",").alias("top"))), f"WITH {DIFF} SELECT symbol, {T}, {r('l2=sqrt(sum(abs_diff * abs_diff))', 'max_abs=max(abs_diff)')}, first(feature ORDER BY abs_diff DESC, feature) AS top FROM dl GROUP BY symbol, time")


def _gate(spark, d):
    s = fx.scored(spark, d)
    return fx.rounded(parity.readiness_gate(_pred(s), parity.feature_diff_long(s, fx.second_feed(s), ["close", "p"])))


add("l08_readiness_gate", _gate, f"WITH {_PCMP}, lg AS (SELECT unnest([a.close, a.p]) AS a, unnest([b.close, b.p]) AS b FROM scored a JOIN feed b USING (symbol, time)), fp AS (SELECT 100 * (1 - avg(CASE WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 0 ELSE 1 END)) AS f FROM lg) SELECT {r('same_decision', 'feature_parity=f', 'accuracy_gap=abs(accuracy_a - accuracy_b)')}, CASE WHEN same_decision >= 99.9 AND f >= 99.9 AND abs(accuracy_a - accuracy_b) <= 0.5 THEN 'READY' ELSE 'NOT_READY' END AS verdict FROM pc, fp")


def _window_features(df, keys):
    w = x.series(*keys)
    return df.withColumns({"m": x.rolling_mean(c("close"), 10, w), "ahead": F.lead("close").over(w)})


CUTS = ["2024-01-10", "2024-01-20"]
add("l09_prefix_invariance", lambda spark, d: fx.rounded(parity.prefix_invariance(fx.bars(spark, d), _window_features, CUTS, ["m", "ahead"]), "symbol", "time", "cutoff", "feature", "is_diff"),
    f"WITH {B30}, u AS (SELECT *, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20']) AS cutoff FROM bars), l AS (SELECT symbol, cutoff, max(time) AS time FROM u WHERE time <= cutoff GROUP BY 1, 2) SELECT symbol, {T}, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, unnest(['m', 'ahead']) AS feature, CAST(unnest([0, 1]) AS BIGINT) AS is_diff FROM l")
add("l10_tail_convergence", lambda spark, d: fx.rounded(parity.tail_convergence(fx.bars(spark, d), lambda df, k: _window_features(df, k), CUTS, [5, 10, 20], ["m"])),
    f"WITH {B30}, u AS (SELECT symbol, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20']) AS cutoff FROM (SELECT DISTINCT symbol FROM bars)) SELECT strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, symbol, CAST(10 AS BIGINT) AS length FROM u")
add("l11_blacklist", diff(lambda v: parity.blacklist_from_summary(parity.feature_diff_summary(v))), f"WITH {DIFF} SELECT feature FROM dl GROUP BY 1 HAVING sum(is_diff) > 0")
add("l12_focus_diff", diff(lambda v: parity.focus_diff(v, "2024-01-17 12:00:00", "^p"), "symbol", "time", "feature", "a", "b"), f"WITH {DIFF} SELECT symbol, {T}, feature, {r('a', 'b')} FROM dl WHERE time = TIMESTAMP '2024-01-17 12:00:00' AND feature = 'p'")
add("l13_batch_vs_single", lambda spark, d: fx.rounded(parity.warmup_batch_vs_single(fx.bars(spark, d), lambda df: df.withColumns({"hl": c("high") - c("low"), "prev": F.lag("close").over(x.series())}), ["hl", "prev"]), "symbol", "time", "feature", "is_diff"),
    f"WITH {B30}, l AS (SELECT symbol, max(time) AS time FROM bars GROUP BY 1) SELECT symbol, {T}, unnest(['hl', 'prev']) AS feature, CAST(unnest([0, 1]) AS BIGINT) AS is_diff FROM l")

# --- M ---
add("m01_finite_report", lambda spark, d: fx.rounded(parity.finite_report(fx.dirty_bars(spark, d), ["close", "high"])), f"""WITH {B30}, dd AS (SELECT CASE WHEN row_number() OVER {W} % 17 = 0 THEN NULL ELSE close END AS close, high FROM bars) SELECT 'close' AS feature, count(*) FILTER (WHERE close IS NULL) AS nulls, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infinities FROM dd UNION ALL SELECT 'high', 0, 0, 0""")
add("m04_warmup_report", lambda spark, d: fx.rounded(parity.warmup_report(fx.bars(spark, d).withColumn("tf", F.lit("30T")).unionByName(fx.bars(spark, d, "60 minutes").withColumn("tf", F.lit("1H"))), {"30T": 1000, "1H": 10_000_000, "5T": 1})),
    f"WITH {B30}, {named_bars(60, 'b60')} SELECT '30T' AS tf, count(*) AS have, CAST(1000 AS BIGINT) AS need, count(*) >= 1000 AS ok FROM bars UNION ALL SELECT '1H', count(*), 10000000, count(*) >= 10000000 FROM b60 UNION ALL SELECT '5T', 0, 1, false")
add("m05_guard_for_predict", lambda spark, d: fx.rounded(parity.guard_for_predict(fx.bars(spark, d).select("symbol", "time", "volume", "close"), ["close", "volume"]), digits=3), f"WITH {B30} SELECT symbol, {T}, {r('close', 'volume', digits=3)} FROM bars")


# --- N: streams over the events table, run to the end of what is there ---
def _events_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _folder(spark):
    import uuid

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream_bars(spark, d):
    """The bars that the watermark has closed at the end of the input."""
    f = _folder(spark)
    out = live.to_table(live.stream_bars(_events_stream(spark, d)), f"{f}/bars", f"{f}/checkpoint")
    return fx.rounded(out, "symbol", "time", "open", "high", "low", "close", "volume")


def _replay(spark, d):
    """Features of the streamed bars against the same by batch scans."""
    features, bars = live.replay_parity(_events_stream(spark, d), _folder(spark))
    batch = scan.ema(bars, {"ema12": ("close", scan.span_alpha(12)), "ema26": ("close", scan.span_alpha(26))})
    long = parity.feature_diff_long(features, batch, ["ema12", "ema26"], 1e-9, 1e-9)
    return fx.rounded(parity.feature_diff_summary(long), "feature", "tests", "n_diff")


add("n01_stream_bars", _stream_bars, f"WITH {B30}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT symbol, {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM bars, m WHERE time + INTERVAL 30 MINUTE <= w")
add("n08_replay_parity", _replay, f"WITH {B30}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), k AS (SELECT count(*) AS tests FROM bars, m WHERE time + INTERVAL 30 MINUTE <= w) SELECT unnest(['ema12', 'ema26']) AS feature, tests, CAST(0 AS BIGINT) AS n_diff FROM k")
