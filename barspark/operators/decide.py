"""Decisions, thresholds and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.functions import windows as x
from barspark.operators.ranges import prefix_scan
from barspark.operators.rolling import rolling_quantiles

div = F.try_divide


def decide(p: Column, negative: Column | float, positive: Column | float) -> Column:
    """1 at or above the upper threshold, else 0 at or below the lower one, else -1."""
    return F.when(p >= positive, 1).when(p <= negative, 0).otherwise(-1)


def signal(decision: Column) -> Column:
    return F.when(decision == 1, "BUY").when(decision == 0, "SELL").otherwise("NONE")


def threshold_table(df: DataFrame, p: str = "p", y: str = "y", steps: int = 100) -> DataFrame:
    """lo, hi and the counts of the confident rows for every pair of grid thresholds lo < hi.

    Rows are counted per grid step first: p <= lo is a running count from below, p >= hi one from above.  The pairs are of grid steps, so the work
    beyond the first count does not depend on the number of rows.
    """
    v = F.col(p)
    place = F.least(F.greatest(v * steps, F.lit(0.0)), F.lit(float(steps)))
    rows = df.filter(v.isNotNull() & F.col(y).isNotNull()).select(F.ceil(place - 1e-9).cast("int").alias("up"), F.floor(place + 1e-9).cast("int").alias("down"), F.col(y).cast("int").alias("y"))
    one = F.struct(F.col("up").alias("k"), F.lit(0).alias("side")), F.struct(F.col("down").alias("k"), F.lit(1).alias("side"))
    counts = rows.select(F.explode(F.array(*one)).alias("z"), "y").groupBy("z.side", "z.k").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    low, high = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0)).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)

    def side(s: int, w) -> DataFrame:
        own = grid.join(counts.filter(F.col("side") == s), "k", "left")
        return own.select("k", F.sum(F.coalesce("n0", F.lit(0))).over(w).alias("n0"), F.sum(F.coalesce("n1", F.lit(0))).over(w).alias("n1"))

    below = side(0, low).select(F.col("k").alias("i"), F.col("n0").alias("tn"), F.col("n1").alias("fn"))
    above = side(1, high).select(F.col("k").alias("j"), F.col("n1").alias("tp"), F.col("n0").alias("fp"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    pairs = below.join(F.broadcast(above), F.col("i") < F.col("j")).join(F.broadcast(total))
    return pairs.select((F.col("i") / steps).alias("lo"), (F.col("j") / steps).alias("hi"), "tp", "fp", "tn", "fn", "n")


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, balanced accuracy and the positive class's F1 of counts; 0 where a divisor is."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "accuracy": z(div(tp + tn, tp + tn + fp + fn)),
        "balanced_accuracy": (z(div(tp, tp + fn)) + z(div(tn, tn + fp))) / 2,
        "f1": z(div(2 * tp, 2 * tp + fp + fn)),
    }


def find_thresholds(df: DataFrame, p: str = "p", y: str = "y", steps: int = 100, gap: float = 0.05, least_confident: float = 0.5, buy_share: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """The pair with the best mean of F1 and balanced accuracy among those that leave a gap, decide enough rows, and decide both ways in proportion.

    Of equally good pairs the one with the lowest thresholds.
    """
    t = threshold_table(df, p, y, steps)
    counts = [F.col(k) for k in ("tp", "fp", "tn", "fn")]
    r = rates(*counts)
    decided = sum(counts[1:], counts[0])
    buys = F.col("tp") + F.col("fp")
    t = t.withColumns({"confident": div(decided, F.col("n")), "buy": div(buys, decided), **r}).withColumn("score", (F.col("f1") + F.col("balanced_accuracy")) / 2)
    t = t.filter((F.round(F.col("hi") - F.col("lo"), 9) >= gap) & (F.col("confident") >= least_confident) & (buys > 0) & (decided > buys) & F.col("buy").between(*buy_share))
    return t.orderBy(F.round("score", 12).desc(), "lo", "hi").limit(1)


def find_thresholds_accuracy(df: DataFrame, p: str = "p", y: str = "y", steps: int = 100, least_coverage: float = 0.5) -> DataFrame:
    """The pair with the best accuracy on the rows it decides, if it decides enough."""
    t = threshold_table(df, p, y, steps)
    counts = [F.col(k) for k in ("tp", "fp", "tn", "fn")]
    t = t.withColumns({"coverage": div(sum(counts[1:], counts[0]), F.col("n")), "accuracy": rates(*counts)["accuracy"]}).filter(F.col("coverage") >= least_coverage)
    return t.orderBy(F.round("accuracy", 12).desc(), "lo", "hi").limit(1)


def adjust_thresholds(df: DataFrame, negative: float, positive: float, atr: str = "atr", volume: str = "volume", atr_limits: tuple[float, float] = (0.5, 1.5), volume_limits: tuple[float, float] = (0.5, 1.5), step: float = 0.02, n: int = 50, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds ``regime``, ``neg_thr`` and ``pos_thr``: wider in wild times, narrower in calm ones, by the bar before; never crossing the middle.

    Wild or calm is the lagged value against the mean of the n before.
    """
    w = x.series(*keys, order=order)
    df = df.withColumns({"__a": x.shift(F.col(atr), w), "__v": x.shift(F.col(volume), w)})
    df = df.withColumns({"__am": x.rolling_mean(F.col("__a"), n, w, 1), "__vm": x.rolling_mean(F.col("__v"), n, w, 1)})
    a, v = div(F.col("__a"), F.col("__am")), div(F.col("__v"), F.col("__vm"))
    regime = F.when((a > atr_limits[1]) | (v < volume_limits[0]), "HIGH").when((a < atr_limits[0]) & (v > volume_limits[1]), "LOW").otherwise("NORMAL")
    df = df.withColumn("regime", regime)
    move = F.when(F.col("regime") == "HIGH", step).when(F.col("regime") == "LOW", -step).otherwise(0.0)
    middle = (negative + positive) / 2
    return df.withColumns({"neg_thr": F.greatest(F.lit(0.0), F.least(F.lit(negative) - move, F.lit(middle))), "pos_thr": F.least(F.lit(1.0), F.greatest(F.lit(positive) + move, F.lit(middle)))}).drop("__a", "__v", "__am", "__vm")


def adaptive_thresholds(df: DataFrame, p: str = "p", n: int = 1000, low: float = 0.1, high: float = 0.9, least: int = 500, fallback: tuple[float, float] = (0.01, 0.99), keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds ``neg_thr`` and ``pos_thr``: quantiles of the n probabilities before the row, or the fallback until there are enough.

    The quantiles come from a tree of counts that moves with the row, so a row costs the logarithm of the frame.
    """
    df = rolling_quantiles(df, p, {"neg_thr": low, "pos_thr": high}, n, least, True, keys, order)
    return df.withColumns({"neg_thr": F.coalesce("neg_thr", F.lit(fallback[0])), "pos_thr": F.coalesce("pos_thr", F.lit(fallback[1]))})


def resolve_uncertain(df: DataFrame, p: str = "p", decision: str = "decision", most_share: float = 0.5, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Where more than a share of a series is undecided, decides those with p furthest from a half until the share is met."""
    part = Window.partitionBy(*keys)
    undecided = F.col(decision) == -1
    rank = F.row_number().over(Window.partitionBy(*keys, decision).orderBy(F.abs(F.col(p) - 0.5).desc(), order))
    df = df.withColumns({"__u": F.count_if(undecided).over(part), "__n": F.count(F.lit(1)).over(part), "__r": rank})
    extra = F.col("__u") - F.floor(F.col("__n") * most_share)
    return df.withColumn(decision, F.when(undecided & (F.col("__r") <= extra), F.when(F.col(p) >= 0.5, 1).otherwise(0)).otherwise(F.col(decision))).drop("__u", "__n", "__r")


def classification_metrics(df: DataFrame, decision: str = "decision", y: str = "y", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, rates and coverage; only decided rows with a label count as right or wrong."""
    d, t = F.col(decision), F.col(y)
    n = lambda a, b: F.count_if((d == a) & (t == b))
    out = df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 0).alias("tn"), n(0, 1).alias("fn"), F.count_if(d != -1).alias("decided"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({**rates(*[F.col(k) for k in ("tp", "fp", "tn", "fn")]), "coverage": 100 * F.col("decided") / F.col("n")})


def running_ledger(df: DataFrame, decision: str = "decision", y: str = "y", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds each row's verdict and the running wins, losses, undecided rows, accuracy and coverage."""
    d, t = F.col(decision), F.col(y)
    verdict = F.when(t.isNull(), "UNKNOWN").when(d == -1, "NONE").when(d == t, "WIN").otherwise("LOSS")
    df = df.withColumn("verdict", verdict)
    df = df.withColumns({k: F.when(F.col("verdict") == v, 1) for k, v in (("wins", "WIN"), ("losses", "LOSS"), ("nones", "NONE"))})
    df = prefix_scan(df, {k: (k, "count") for k in ("wins", "losses", "nones")}, keys, order)
    done = F.col("wins") + F.col("losses")
    return df.withColumns({"cum_accuracy": 100 * div(F.col("wins"), done), "cum_coverage": 100 * div(done, done + F.col("nones"))})


def pip_profit(df: DataFrame, decision: str = "decision", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds the next move's size, gained or lost by the decision, and its running sum."""
    w = x.series(*keys, order=order)
    df = df.withColumn("__m", F.lead("close").over(w) - F.col("close"))
    gain = F.when(F.col(decision) == 1, F.col("__m")).when(F.col(decision) == 0, -F.col("__m")).otherwise(0.0)
    df = df.withColumn("profit", F.coalesce(gain, F.lit(0.0)))
    return df.withColumn("cum_profit", F.sum("profit").over(x.running(w))).drop("__m")


def strategy_returns(df: DataFrame, decision: str = "decision", lag: int = 0, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds the return from each row to the next where the decision (``lag`` rows before) is to buy; the last row of a series has none."""
    w = x.series(*keys, order=order)
    on = F.lag(decision, lag).over(w) if lag else F.col(decision)
    df = df.withColumns({"__r": div(F.lead("close").over(w), F.col("close")) - 1, "__d": on})
    return df.withColumn("strategy_return", F.when(F.col("__r").isNotNull(), F.when(F.col("__d") == 1, F.col("__r")).otherwise(0.0))).drop("__r", "__d")


def performance(df: DataFrame, periods: float = 252 * 48, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Sharpe ratio (0 without deviation), largest fall of the running product from its peak, and its end."""
    w = x.series(*keys, order=order)
    df = df.filter("strategy_return IS NOT NULL").withColumn("__g", 1 + F.col("strategy_return"))
    df = df.withColumn("equity", x.cumprod(F.col("__g"), w))
    df = df.withColumn("__f", x.cummax(F.col("equity"), w) - F.col("equity"))
    r = F.col("strategy_return")
    sharpe = F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(float(periods)))).otherwise(0.0)
    return df.groupBy(*keys).agg(F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.max("__f").alias("max_drawdown"), F.max_by("equity", order).alias("equity"))


def fitness(sharpe: Column, drawdown: Column, balanced: Column, least: float = 0.55) -> Column:
    return F.when(balanced < least, 0.0).otherwise(0.4 * (F.tanh(sharpe / 5) + 1) / 2 + 0.4 * (1 - F.least(drawdown, F.lit(1.0))) + 0.2 * balanced)


def shift_sweep(df: DataFrame, grid: list[tuple[float, float]], shifts: range = range(-2, 3), p: str = "p", y: str = "y", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Accuracy and coverage for labels moved by some rows, times a grid of thresholds: one pass, the grid is a handful of rows."""
    w = x.series(*keys, order=order)
    moved = F.array(*[F.struct(F.lit(s).alias("shift"), (F.lead(y, s).over(w) if s >= 0 else F.lag(y, -s).over(w)).alias("t")) for s in shifts])
    pairs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in grid])
    rows = df.withColumn("__m", moved).select(p, F.explode("__m").alias("m")).select(p, "m.*", F.explode(pairs).alias("g")).select(p, "shift", "t", "g.*").filter("t IS NOT NULL")
    d = decide(F.col(p), F.col("lo"), F.col("hi"))
    out = rows.withColumn("d", d).groupBy("shift", "lo", "hi").agg(F.count_if(F.col("d") == F.col("t")).alias("right"), F.count_if(F.col("d") != -1).alias("decided"), F.count(F.lit(1)).alias("n"))
    return out.select("shift", "lo", "hi", F.coalesce(div(F.col("right"), F.col("decided")), F.lit(0.0)).alias("accuracy"), (F.col("decided") / F.col("n")).alias("coverage"))


def compare_ensembles(signals: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("symbol", "time"), family: str = "family") -> DataFrame:
    """Metrics of each family's decisions against the truth."""
    return classification_metrics(signals.join(truth, list(keys)), keys=(family,))


def day_report(df: DataFrame, day, decision: str = "decision", y: str = "y", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The running ledger of one day's bars; the day is cut out before any window."""
    return running_ledger(df.filter(F.to_date(order) == F.lit(day).cast("date")), decision, y, keys, order)


# --- votes of several models (J5-J8, J11) ---


def ensemble_proba(columns: list[str]) -> Column:
    return sum((F.col(k) for k in columns[1:]), F.col(columns[0])) / len(columns)


def ensemble_vote(columns: list[str]) -> Column:
    votes = sum((F.when(F.col(k) >= 0.5, 1).otherwise(0) for k in columns), F.lit(0))
    return F.when(votes * 2 > len(columns), 1).otherwise(0)


def ensemble_actions(thresholds: dict[str, tuple[float, float]], least_confident: int = 3, buy: float = 0.7, sell: float = 0.3) -> dict[str, Column]:
    """Votes of the models outside their own bands, and the action if enough of them agree."""
    d = [decide(F.col(k), a, b) for k, (a, b) in thresholds.items()]
    buys, sure = sum((F.when(v == 1, 1).otherwise(0) for v in d), F.lit(0)), sum((F.when(v != -1, 1).otherwise(0) for v in d), F.lit(0))
    ratio = div(buys, sure)
    action = F.when(sure < least_confident, "NONE").when(ratio >= buy, "BUY").when(ratio <= sell, "SELL").otherwise("NONE")
    return {"votes_buy": buys, "confident_models": sure, "action": action}


def vote_table(long: DataFrame, p: str = "p", keys: tuple[str, ...] = ("symbol", "time"), band: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Of predictions with a row per model: votes to buy, models outside the band, and their mean distance from a half."""
    v, sure = F.col(p), (F.col(p) <= band[0]) | (F.col(p) >= band[1])
    return long.groupBy(*keys).agg(F.count_if(v >= 0.5).alias("votes_buy"), F.count_if(sure).alias("confident_models"), F.avg(F.abs(v - 0.5) * 2).alias("mean_confidence"))


def bias_penalty(df: DataFrame, prediction: str, penalty: float = 0.1, share: float = 0.9, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """A penalty where one class makes up more than the share of a model's predictions."""
    up = F.avg(F.col(prediction).cast("double"))
    return df.groupBy(*keys).agg(up.alias("share_up")).withColumn("penalty", F.when((F.col("share_up") > share) | (F.col("share_up") < 1 - share), penalty).otherwise(0.0))


def stability_report(test: DataFrame, live: DataFrame, keys: tuple[str, ...] = ("model",), prediction: str = "decision", y: str = "y", penalty: float = 0.1) -> DataFrame:
    """Per model: metrics on both data sets, their drift, the bias penalty, and an index of both."""
    a, b = (classification_metrics(df, prediction, y, keys) for df in (test, live))
    a = a.select(*keys, "accuracy", "f1")
    b = b.select(*keys, F.col("accuracy").alias("live_accuracy"), F.col("f1").alias("live_f1"))
    out = a.join(b, list(keys)).join(bias_penalty(live, prediction, penalty, keys=keys).select(*keys, "penalty"), list(keys))
    drift = F.col("live_accuracy") - F.col("accuracy")
    return out.withColumn("drift", drift).withColumn("stability_index", 1 - F.abs("drift") - F.col("penalty"))
