"""Autoregressive terms on top of trend, season and holidays.

What a fit of `forecasting` leaves over is modelled per series as an
autoregression whose order is chosen by Akaike's criterion, as the reference's
model chooses its own.

* Autocovariances are sums of products of residuals k buckets apart, for all
  series in one aggregate. A series is cut into runs of ``BLOCK`` buckets; the
  rows that begin a run are also sent to the one before, so each run finds its
  products alone, and a series of any length is many small windows. Buckets
  without sales count as residual 0.
* Coefficients follow from the autocovariances by the Levinson-Durbin
  recursion, a fold over the lags in one higher-order expression per series;
  it gives the innovation variance of every order on its way.
* Forecasts fold the last residuals forward; their variance sums the squared
  impulse responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import lake, register
from ..schemas import Z_BY_CONFIDENCE
from ..session import written
from . import forecasting as M

c, KEY = F.col, M.KEY
MAX_ORDER, BLOCK = 14, 4096
_STATE = "struct<phi: array<double>, v: double, aic: double, p: int, best: array<double>, left: double>"


def expected(at: str, unit: str) -> Column:
    """Trend, season and holiday of the fit whose columns stand beside ``at``."""
    t = M._steps(c("start"), c(at), unit).cast("double")
    season = F.coalesce(F.try_element_at("weekday_effect", M._season(at, unit)), F.lit(0.0))
    return c("intercept") + c("slope") * t + season + F.when(c("holiday"), c("holiday_effect")).otherwise(F.lit(0.0))


def residuals(d: DataFrame, fit: DataFrame, unit: str = "day", holidays: DataFrame | None = None) -> DataFrame:
    """(series, i, e): bucket number since the series' start, what the fit leaves."""
    j = M._is_holiday(d, holidays).join(fit, KEY)
    return j.select(KEY, M._steps(c("start"), c("date"), unit).alias("i"), (c("y") - expected("date", unit)).alias("e"))


def lag_products(rest: DataFrame, max_order: int = MAX_ORDER, block: int = BLOCK) -> DataFrame:
    """(series, k, s): sums of e[i] * e[i + k] for k = 0..max_order."""
    blk = F.floor(c("i") / block)
    runs = rest.withColumn("run", F.explode(F.when((c("i") % block < max_order) & (c("i") >= block), F.array(blk, blk - 1)).otherwise(F.array(blk))))
    w = Window.partitionBy(KEY, "run").orderBy("i")
    ahead = [F.struct((F.lead("i", j).over(w) - c("i")).alias("k"), (c("e") * F.lead("e", j).over(w)).alias("x")) for j in range(1, max_order + 1)]
    own = F.struct(F.lit(0).cast("long").alias("k"), (c("e") * c("e")).alias("x"))
    pairs = runs.select(KEY, (c("run") == blk).alias("mine"), F.array(own, *ahead).alias("xs")).filter("mine")
    return (pairs.select(KEY, F.inline("xs")).filter(c("k") <= max_order).groupBy(KEY, "k").agg(F.sum("x").alias("s")))


def levinson(cov: Column, n: Column, max_order: int = MAX_ORDER) -> Column:
    """Struct (p, best, left): the order of least AIC (the smaller one of
    equals), its coefficients and its innovation variance."""
    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(acc: Column, m: Column) -> Column:
        # c[m] less what the coefficients so far explain, over the variance left
        ahead = F.reverse(F.slice(cov, F.lit(2), m - 1))
        explained = F.aggregate(F.zip_with(acc.phi, ahead, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        kappa = F.when(acc.v > 0, (F.element_at(cov, m + 1) - explained) / acc.v).otherwise(F.lit(0.0))

        def grown(k: Column) -> Column:
            phi = F.concat(F.zip_with(acc.phi, F.reverse(acc.phi), lambda a, b: a - k * b), F.array(k))
            v = acc.v * (1 - k * k)
            aic = F.when(v > 0, n * F.log(v) + 2 * m).otherwise(F.lit(float("inf")))
            better = aic < acc.aic
            return F.struct(phi.alias("phi"), v.alias("v"), F.when(better, aic).otherwise(acc.aic).alias("aic"), F.when(better, m).otherwise(acc.p).alias("p"),
                            F.when(better, phi).otherwise(acc.best).alias("best"), F.when(better, v).otherwise(acc.left).alias("left")).cast(_STATE)

        return let(kappa, grown)

    c0, none = F.element_at(cov, 1), F.array().cast("array<double>")
    aic0 = F.when(c0 > 0, n * F.log(c0)).otherwise(F.lit(float("-inf")))
    start = F.struct(none.alias("phi"), c0.alias("v"), aic0.alias("aic"), F.lit(0).alias("p"), none.alias("best"), c0.alias("left")).cast(_STATE)
    most = F.least(F.lit(max_order), F.call_function("div", n, F.lit(4)).cast("int"))
    lags = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lags, start, step, lambda s: F.struct(s.p.alias("p"), s.best.alias("best"), s.left.alias("left")))


def fit_ar(d: DataFrame, unit: str = "day", holidays: DataFrame | None = None, max_order: int = MAX_ORDER) -> DataFrame:
    """``forecasting.fit_buckets`` with, per series: ar_order, phi (its
    coefficients), innovation_sigma and recent (the last residuals, newest
    first, at most ``max_order``). A series of fewer than 8 buckets, or one the
    fit explains exactly, has order 0."""
    d = written(d, "buckets")     # the fit and the residuals of both uses read it
    fit = M.fit_buckets(d, unit, holidays)
    rest = residuals(d, fit, unit, holidays)
    sums = lag_products(rest, max_order).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("sums"))
    span = M._steps(c("start"), c("last"), unit)
    ends = fit.select(KEY, span.alias("end"))
    last = (rest.join(ends, KEY).filter(c("i") > c("end") - max_order).groupBy(KEY)
                .agg(F.map_from_entries(F.collect_list(F.struct((c("end") - c("i")).alias("back"), "e"))).alias("tail")))
    out = fit.join(sums, KEY, "left").join(last, KEY, "left").withColumn("buckets", span + 1)
    at = lambda m, k: F.coalesce(F.try_element_at(m, k.cast("long")), F.lit(0.0))
    out = out.withColumn("cov", F.transform(F.sequence(F.lit(0), F.lit(max_order)), lambda k: at(c("sums"), k) / c("buckets")))
    out = out.withColumn("ar", levinson(c("cov"), c("buckets"), max_order))
    recent = F.transform(F.sequence(F.lit(0), F.lit(max_order - 1)), lambda k: at(c("tail"), k))
    return out.select(*fit.columns, c("ar.p").alias("ar_order"), c("ar.best").alias("phi"), F.sqrt(c("ar.left")).alias("innovation_sigma"), recent.alias("recent"))


def _dot(phi: Column, recent: Column) -> Column:
    """Coefficients times the newest values, over as many as there are coefficients."""
    return F.aggregate(F.zip_with(phi, F.slice(recent, F.lit(1), F.size(phi)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def forecast_ar(fit: DataFrame, horizon: int = 30, confidence: float = 0.95, unit: str = "day",
                holidays: DataFrame | None = None) -> DataFrame:
    """date, revenue, lower_bound, upper_bound for the ``horizon`` units after
    each series' last one, from a fit of `fit_ar`."""
    z = Z_BY_CONFIDENCE[confidence]
    steps = F.sequence(F.lit(1), F.lit(horizon))

    def roll(first: Column) -> Column:
        """Values 1..horizon of the recursion that starts from ``first`` (newest first)."""
        seed = F.struct(first.alias("recent"), F.array().cast("array<double>").alias("out"))
        return F.aggregate(steps, seed, lambda s, h: F.struct(F.concat(F.array(_dot(c("phi"), s.recent)), s.recent).alias("recent"), F.concat(s.out, F.array(_dot(c("phi"), s.recent))).alias("out")),
                           lambda s: s.out)

    impulse = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), MAX_ORDER))
    f = fit.withColumns({"path": roll(c("recent")), "psi": F.concat(F.array(F.lit(1.0)), roll(impulse))})
    f = f.select("*", F.posexplode("path").alias("h0", "ar_part"))
    spread = F.aggregate(F.slice("psi", F.lit(1), c("h0") + 1), F.lit(0.0), lambda s, x: s + x * x)
    f = f.withColumn("date", F.date_add("last", c("h0") + 1) if unit == "day" else F.timestamp_seconds(F.unix_seconds("last") + (c("h0") + 1) * M.UNIT_SECONDS[unit]))
    f = M._is_holiday(f, holidays)
    value = expected("date", unit) + c("ar_part")
    half = F.lit(z) * c("innovation_sigma") * F.sqrt(spread + F.lit(1.0) / c("n"))
    return f.select(KEY, "date", F.round(value, 0).alias("revenue"), F.round(value - half, 0).alias("lower_bound"), F.round(value + half, 0).alias("upper_bound"))


# ------------------------------------------------------------ registration
def _rounded(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38, 12)), {places}) AS DOUBLE)"


def _ar_sql(src: str, unit: str = "day", max_order: int = MAX_ORDER) -> str:
    """The same model in DuckDB: lag sums by a self join, the recursion row by row."""
    return f"""
rest AS (SELECT d.series, d.t, d.y - (f.intercept + f.slope * d.t + e.effect) AS e
         FROM dt d JOIN fit f USING (series) JOIN eff e ON e.series = d.series AND e.wd = {M._slot_sql(unit, 'd.date')}),
whole AS (SELECT series, date_diff('{unit}', start, last) + 1 AS buckets FROM fit),
lagged AS (SELECT a.series, b.t - a.t AS k, sum(a.e * b.e) AS s FROM rest a JOIN rest b ON a.series = b.series AND b.t - a.t BETWEEN 0 AND {max_order} GROUP BY 1, 2),
cov AS (SELECT w.series, any_value(buckets) AS n, list(coalesce(s, 0.0) / buckets ORDER BY k) AS cv
        FROM (SELECT series, buckets, unnest(range(0, {max_order + 1})) AS k FROM whole) w LEFT JOIN lagged l USING (series, k) GROUP BY 1),
lev AS (SELECT series, n, cv, 0 AS m, CAST([] AS DOUBLE[]) AS phi, cv[1] AS v FROM cov
        UNION ALL
        SELECT series, n, cv, m + 1, list_append(list_transform(range(1, m + 1), lambda j: phi[j] - kappa * phi[m + 1 - j]), kappa), v * (1 - kappa * kappa)
        FROM (SELECT *, CASE WHEN v > 0 THEN (cv[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda j: phi[j] * cv[m + 2 - j])), 0.0)) / v ELSE 0.0 END AS kappa
              FROM lev WHERE m < least({max_order}, n // 4))),
pick AS (SELECT *, CASE WHEN v > 0 THEN n * ln(v) + 2 * m WHEN m = 0 THEN -1e300 ELSE 1e300 END AS aic FROM lev),
ar AS (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY series ORDER BY aic, m) = 1)"""


def _ar_forecast_sql(horizon: int, conf: float, unit: str = "day", max_order: int = MAX_ORDER) -> str:
    later = "CAST(f.last + CAST(p.h AS INTEGER) AS DATE)" if unit == "day" else f"f.last + to_{unit}s(CAST(p.h AS INTEGER))"
    dot = "coalesce(list_sum(list_transform(range(1, len(phi) + 1), lambda j: phi[j] * {x}[j])), 0.0)"
    return f"""
tail AS (SELECT w.series, list(coalesce(e, 0.0) ORDER BY back) AS recent
         FROM (SELECT series, buckets, unnest(range(0, {max_order})) AS back FROM whole) w LEFT JOIN rest r ON r.series = w.series AND r.t = w.buckets - 1 - w.back GROUP BY 1),
path AS (SELECT a.series, phi, v, 0 AS h, recent, list_prepend(CAST(1.0 AS DOUBLE), list_transform(range(0, {max_order}), lambda j: CAST(0.0 AS DOUBLE))) AS psi, CAST(0.0 AS DOUBLE) AS part, CAST(0.0 AS DOUBLE) AS spread
         FROM ar a JOIN tail USING (series)
         UNION ALL
         SELECT series, phi, v, h + 1, list_prepend({dot.format(x='recent')}, recent), list_prepend({dot.format(x='psi')}, psi), {dot.format(x='recent')}, spread + psi[1] * psi[1]
         FROM path WHERE h < {horizon}),
fcv AS (SELECT f.series, {later} AS date, p.part, p.spread, p.v, f.n, f.start, f.intercept, f.slope FROM path p JOIN fit f USING (series) WHERE p.h > 0),
fcw AS (SELECT series, date, intercept + slope * CAST(date_diff('{unit}', start, date) AS DOUBLE)
               + coalesce((SELECT effect FROM eff e WHERE e.series = fcv.series AND e.wd = {M._slot_sql(unit, 'fcv.date')}), 0.0) + part AS x,
               CAST({Z_BY_CONFIDENCE[conf]} AS DOUBLE) * sqrt(v) * sqrt(spread + CAST(1 AS DOUBLE) / n) AS half FROM fcv),
fc AS (SELECT series, date, round(x, 0) AS revenue, round(x - half, 0) AS lower_bound, round(x + half, 0) AS upper_bound FROM fcw)"""


_FIT_ROWS = f"""
SELECT series, CAST(m AS INTEGER) AS ar_order, list_transform(phi, lambda x: {_rounded('x', 6)}) AS phi, {_rounded('sqrt(v)', 2)} AS innovation_sigma FROM ar"""


def _fit_rows(fit: DataFrame) -> DataFrame:
    return fit.select(KEY, "ar_order", F.transform("phi", lambda x: F.round(x, 6)).alias("phi"), F.round("innovation_sigma", 2).alias("innovation_sigma"))


def _recursive(sql_with: str, final: str) -> str:
    return M._nest(sql_with, final).replace("WITH ", "WITH RECURSIVE ", 1)


def _buckets(spark, d, key=None, unit="day"):
    series = M._keyed(spark, d, key, unit) if key else M.revenue_series(lake(spark, d).table("fact_sales_stream"), unit=unit)
    return M._buckets(series, [key] if key else [], unit)


for _name, _key, _unit, _source in (("", None, "day", "fact_sales_stream"), ("_by_category", "category", "day", M._BY_CATEGORY), ("_hourly", None, "hour", "fact_sales_stream")):
    _daily = M._daily_sql(_key or "'all'", _unit, _source)
    _with = f"WITH {_daily}, {M._fit_sql('daily', _unit)}, {_ar_sql('daily', _unit)}"
    register(f"forecast_fit_ar{_name}", _recursive(_with, _FIT_ROWS))(
        lambda spark, d, k=_key, u=_unit: _fit_rows(fit_ar(_buckets(spark, d, k, u), u)))
    register(f"forecast_ar{_name}", _recursive(f"{_with}, {_ar_forecast_sql(M.HORIZON, M.CONF, _unit)}", "SELECT * FROM fc"))(
        lambda spark, d, k=_key, u=_unit: forecast_ar(fit_ar(_buckets(spark, d, k, u), u), M.HORIZON, M.CONF, u))
