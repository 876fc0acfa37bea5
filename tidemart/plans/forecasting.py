"""Revenue forecasting for many series at once.

The reference trains a proprietary ARIMA model. Here a model Spark can fit
with grouped aggregates: per series, a least-squares trend on the day
index (days, hours or minutes), a seasonal effect (mean residual per weekday,
or hour of the day), an optional holiday effect and the residual standard
deviation; bounds are value +- z * sigma * sqrt(1 + 1/n). The fit
reads the (series, bucket) rows once: every figure follows from sums per
(series, slot), so it scales with the number of series, has no self join and
no checkpoint, and never brings a series to the driver.

The trend uses exact integer sums (n, sum t, sum y, sum t^2, sum t*y), so
slope and intercept are reproducible bit for bit; outputs are rounded to
whole currency units.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefilter import time_filter
from ..lake import ORDERS_AS_OF
from ..oracle.sql import avg_pct_sql, with_ctes
from ..registry import lake, register
from ..schemas import CI_OUTSIDE, CI_WITHIN, Z_BY_CONFIDENCE
from ..session import written

c = F.col
KEY = "series"


def revenue_series(sales: DataFrame, ts_col: str = "order_ts", unit: str = "day",
                   keys: list[str] | None = None) -> DataFrame:
    """Training set: sum(net_revenue) per time bucket (and series keys)."""
    keys = keys or []
    bucket = F.date_trunc(unit, ts_col).alias("time_bucket")
    return sales.groupBy(*keys, bucket).agg(F.sum("net_revenue").alias("net_revenue"))


UNIT_SECONDS = {"minute": 60, "hour": 3600}   # units below the day


def _steps(start, end, unit: str):
    """Whole units from ``start`` to ``end``."""
    if unit == "day":
        return F.datediff(end, start).cast("long")
    return F.call_function("div", F.unix_seconds(end) - F.unix_seconds(start), F.lit(UNIT_SECONDS[unit]))


def _season(col, unit: str):
    """The seasonal slot: weekday for days, hour of the day below."""
    return F.dayofweek(col) if unit == "day" else F.hour(col)


def _buckets(series: DataFrame, keys: list[str], unit: str = "day") -> DataFrame:
    """(series, date, y) with one row per series and bucket; ``date`` is a
    date for days, else the bucket's timestamp."""
    at = F.to_date("time_bucket") if unit == "day" else F.date_trunc(unit, "time_bucket")
    key = F.concat_ws("|", *[c(k).cast("string") for k in keys]) if keys else F.lit("all")
    return series.groupBy(key.alias(KEY), at.alias("date")).agg(F.sum("net_revenue").alias("y"))


def forecast_fit(series: DataFrame, keys: list[str] | None = None, unit: str = "day",
                 holidays: DataFrame | None = None) -> DataFrame:
    """One row per series (all, or one per value of ``keys``): start date,
    last date, n, slope, intercept, seasonal effects (map slot -> effect),
    holiday effect and residual sigma. ``holidays``: a frame of dates."""
    return fit_buckets(_buckets(series, keys or [], unit), unit, holidays)


def _is_holiday(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    if holidays is None:
        return df.withColumn("holiday", F.lit(False))
    h = holidays.select(F.to_date("date").alias("_h")).distinct().withColumn("_y", F.lit(True))
    return df.join(h, F.to_date("date") == c("_h"), "left").withColumn("holiday", c("_y").isNotNull()).drop("_h", "_y")


def _index(col, unit: str):
    """Whole units since 1970-01-01."""
    return _steps(F.lit("1970-01-01").cast("date" if unit == "day" else "timestamp"), col, unit)


def fit_buckets(d: DataFrame, unit: str = "day", holidays: DataFrame | None = None) -> DataFrame:
    """``forecast_fit`` on (series, date, y) rows, read once: exact sums per
    (series, slot), gathered per series (at most 24 slots), hold all that
    trend, seasonal and holiday effects and the spread of the rest need."""
    wide, i, y = (lambda x: F.sum(x.cast("decimal(38,0)"))), c("i").cast("decimal(12,0)"), c("y").cast("decimal(20,0)")
    d = _is_holiday(d, holidays).withColumn("i", _index(c("date"), unit))
    hol = lambda x: F.sum(F.when(c("holiday"), x.cast("decimal(38,0)")).otherwise(0))
    slots = d.groupBy(KEY, _season("date", unit).alias("wd")).agg(
        F.min("date").alias("start"), F.max("date").alias("last"), F.count("*").alias("n"), wide(i).alias("si"), wide(i * i).alias("sii"),
        wide(y).alias("sy"), wide(i * y).alias("siy"),
        F.var_pop("y").alias("vy"), F.covar_pop("i", "y").alias("cv"), F.var_pop("i").alias("vi"),   # about the slot's means
        F.count_if("holiday").alias("hn"), hol(i).alias("hi"), hol(y).alias("hy"))
    big = lambda x: x.cast("decimal(38,0)")
    sums = ["n", "si", "sii", "sy", "siy"]
    f = slots.groupBy(KEY).agg(F.min("start").alias("start"), F.max("last").alias("last"), *[big(F.sum(x)).alias(x) for x in sums],
                               F.sum("hn").alias("hn"), F.collect_list(F.struct("wd", *sums, "vy", "cv", "vi", "hn", "hi", "hy")).alias("slots"))
    f = f.withColumn("i0", _index(c("start"), unit).cast("decimal(12,0)"))
    # sums of t = i - i0; n * sum(t * y) passes a LONG at a few thousand days of billions
    f = f.withColumns({"st": big(c("si") - c("n") * c("i0")), "stt": big(c("sii") - 2 * c("i0") * c("si") + c("n") * c("i0") * c("i0")),
                       "sty": big(c("siy") - c("i0") * c("sy"))})
    den = big(c("n") * c("stt") - c("st") * c("st"))
    f = f.withColumn("slope", F.when(den != 0, big(c("n") * c("sty") - c("st") * c("sy")).cast("double") / den.cast("double")).otherwise(F.lit(0.0)))
    f = f.withColumn("n", c("n").cast("long"))
    f = f.withColumn("intercept", (c("sy").cast("double") - c("slope") * c("st").cast("double")) / c("n"))

    def parts(x):
        """Of a slot: its effect (mean residual of the trend), the residuals'
        squares about it, and their sum over the slot's holidays."""
        b = c("slope")
        t, ht = (big(v).cast("double") for v in (x.si - x.n * c("i0"), x.hi - x.hn * c("i0")))
        effect = (x.sy.cast("double") - c("intercept") * x.n - b * t) / x.n
        return effect, x.n * (x.vy - 2 * b * x.cv + b * b * x.vi), x.hy.cast("double") - (c("intercept") + effect) * x.hn - b * ht

    f = f.withColumns({
        "weekday_effect": F.map_from_entries(F.transform("slots", lambda x: F.struct(x.wd.alias("wd"), parts(x)[0].alias("effect")))),
        "ssr": F.aggregate("slots", F.lit(0.0), lambda acc, x: acc + parts(x)[1]),
        "on_holidays": F.aggregate("slots", F.lit(0.0), lambda acc, x: acc + parts(x)[2])})
    f = f.withColumn("holiday_effect", F.when(c("hn") > 0, c("on_holidays") / c("hn")).otherwise(F.lit(0.0)))
    # what is left after the holiday effect: sum of squares, and its mean (that of the residuals is 0)
    h, mean = c("holiday_effect"), -c("hn") * c("holiday_effect") / c("n")
    left = c("ssr") - 2 * h * c("on_holidays") + c("hn") * h * h - c("n") * mean * mean
    f = f.withColumn("sigma", F.when(c("n") > 1, F.sqrt(F.greatest(left, F.lit(0.0)) / (c("n") - 1))).otherwise(F.lit(0.0)))
    return f.select(KEY, "start", "last", "n", "slope", "intercept", "weekday_effect", "holiday_effect", "sigma")


def forecast(fit: DataFrame, horizon: int = 30, confidence: float = 0.95, unit: str = "day",
             holidays: DataFrame | None = None) -> DataFrame:
    """date, revenue, lower_bound, upper_bound for the ``horizon`` units after
    each series' last one."""
    z = Z_BY_CONFIDENCE[confidence]
    f = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    f = f.withColumn("date", F.date_add("last", c("h")) if unit == "day"
                     else F.timestamp_seconds(F.unix_seconds("last") + c("h") * UNIT_SECONDS[unit]))
    f = _is_holiday(f, holidays)
    t = _steps(c("start"), c("date"), unit).cast("double")
    eff = F.coalesce(F.try_element_at("weekday_effect", _season("date", unit)), F.lit(0.0))
    value = c("intercept") + c("slope") * t + eff + F.when(c("holiday"), c("holiday_effect")).otherwise(F.lit(0.0))
    half = F.lit(z) * c("sigma") * F.sqrt(F.lit(1.0) + F.lit(1.0) / c("n"))
    return f.select(KEY, "date", F.round(value, 0).alias("revenue"),
                    F.round(value - half, 0).alias("lower_bound"), F.round(value + half, 0).alias("upper_bound"))


def history(fs: DataFrame, days: int, as_of=None) -> DataFrame:
    return (fs.filter(time_filter("date_key", days, as_of=as_of)).groupBy(c("date_key").alias("date"))
              .agg(F.sum("net_revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit"),
                   (F.try_divide(F.sum(F.round(c("gross_margin_pct") * 100).cast("long")), F.count("gross_margin_pct"))
                    / F.lit(100.0)).alias("avg_margin"),
                   F.count_distinct("order_id").alias("orders"))
              .orderBy("date"))


def forecast_vs_actual(series: DataFrame, holdout_days: int = 7, confidence: float = 0.95, shift_days: int = 0) -> DataFrame:
    """Hold-out backtest (Q13): fit on days before the cut-off, forecast the
    held-out days, join actuals by date; ape % and CI hit per day. With
    ``shift_days`` the whole series is fitted, as many days are forecast, and
    each is set against the actual so many days before it."""
    d = written(_buckets(series, []), "buckets")    # read by the fit and by the actuals
    actual = d.select(KEY, F.date_add("date", shift_days).alias("date"), c("y").alias("actual"))
    if shift_days:
        fc = forecast(fit_buckets(d), shift_days, confidence)
    else:
        last = F.max("date").over(Window.partitionBy(KEY))
        train = d.withColumn("m", last).filter(c("date") <= F.date_sub("m", holdout_days)).drop("m")
        fc = forecast(fit_buckets(train), holdout_days, confidence)
    j = fc.join(actual, [KEY, "date"])
    return j.select(
        "date", c("revenue").alias("predicted"), "lower_bound", "upper_bound", "actual",
        (F.abs(c("revenue") - c("actual")) / F.nullif(c("actual"), F.lit(0)) * 100).alias("mape_pct"),
        F.when(c("actual").between(c("lower_bound"), c("upper_bound")), CI_WITHIN)
         .otherwise(CI_OUTSIDE).alias("ci_hit")).orderBy("date")


def category_forecast(fs: DataFrame, horizon: int, days: int, as_of=None) -> DataFrame:
    b = (fs.filter(time_filter("date_key", days, as_of=as_of)).groupBy("category")
           .agg(F.sum("net_revenue").alias("revenue_last30"), F.count_distinct("date_key").alias("days_active")))
    b = b.withColumn("avg_daily", c("revenue_last30") / c("days_active"))
    return (b.select("category", "revenue_last30", "avg_daily",
                     F.round(c("avg_daily") * horizon, 0).alias("projected_revenue"))
             .orderBy(c("projected_revenue").desc_nulls_last(), "category"))


def top_products_forecast(fs: DataFrame, horizon: int, days: int, as_of=None, limit: int = 10) -> DataFrame:
    b = (fs.filter(time_filter("date_key", days, as_of=as_of)).groupBy("product_name", "category", "brand")
           .agg((F.sum("net_revenue") / F.count_distinct("date_key")).alias("avg_daily_revenue"),
                (F.try_divide(F.sum(F.round(c("gross_margin_pct") * 100).cast("long")), F.count("gross_margin_pct"))
                 / F.lit(100.0)).alias("avg_margin")))
    return (b.select("product_name", "category", "brand",
                     F.round(c("avg_daily_revenue") * horizon, 0).alias("projected_revenue"), "avg_margin")
             .orderBy(c("projected_revenue").desc_nulls_last(), "product_name", "category", "brand").limit(limit))


def forecast_summary(fc: DataFrame, series: DataFrame) -> DataFrame:
    """Totals of one forecast, plus first forecast vs last actual in %.
    Forecast and actual rows are unioned and reduced by one aggregate per
    series (no join between the two)."""
    d = _buckets(series, [])
    nul = F.lit(None).cast("double")
    u = (fc.select(KEY, "date", "revenue", (c("upper_bound") - c("lower_bound")).alias("width"),
                   F.lit(None).cast("long").alias("y"))
           .unionByName(d.select(KEY, "date", nul.alias("revenue"), nul.alias("width"), "y")))
    is_fc = c("revenue").isNotNull()
    s = u.groupBy(KEY).agg(
        F.sum("revenue").alias("total_forecast"), F.avg("revenue").alias("avg_daily_forecast"),
        F.max("revenue").alias("peak_forecast"), F.min("revenue").alias("trough_forecast"),
        F.avg("width").alias("ci_width_avg"),
        F.min_by("revenue", F.when(is_fc, c("date"))).alias("first_forecast"),
        F.max_by("y", F.when(c("y").isNotNull(), c("date"))).alias("last_actual"))
    return s.drop(KEY).withColumn("delta_first_vs_last_pct",
                                  F.try_divide(c("first_forecast") - c("last_actual"), c("last_actual")) * 100)


def forecast_accuracy(fva: DataFrame) -> DataFrame:
    return fva.agg(F.round(F.avg("mape_pct"), 6).alias("mape"),
                   F.count_if(c("ci_hit") == CI_WITHIN).alias("ci_hits"), F.count("*").alias("ci_total"),
                   F.try_divide(F.count_if(c("ci_hit") == CI_WITHIN) * 100, F.count("*")).alias("ci_pct"))


def forecast_worst_misses(fva: DataFrame, limit: int = 5) -> DataFrame:
    return (fva.filter(c("ci_hit") == CI_OUTSIDE).orderBy(c("mape_pct").desc_nulls_last(), "date").limit(limit)
               .select("date", "actual", "predicted", "mape_pct"))


def forecast_error_bars(fc: DataFrame) -> DataFrame:
    return fc.select("date", "revenue", (c("upper_bound") - c("revenue")).alias("error_plus"),
                     (c("revenue") - c("lower_bound")).alias("error_minus"))


# ------------------------------------------------------------ registration
HORIZON, CONF, HOLDOUT, DAYS = 30, 0.95, 7, 3650


def _series(spark, d):
    return revenue_series(lake(spark, d).table("fact_sales_stream"))


def _fc(spark, d):
    return forecast(forecast_fit(_series(spark, d)), HORIZON, CONF)


def _fva(spark, d):
    return forecast_vs_actual(_series(spark, d), HOLDOUT, CONF)


# Oracle pieces: the model in DuckDB SQL, for a key, a unit and holidays.
_HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-02-14"]
_HOLIDAY_SQL = "CAST(date AS DATE) IN (" + ", ".join(f"DATE '{h}'" for h in _HOLIDAYS) + ")"


def _holidays(spark):
    return spark.createDataFrame([(h,) for h in _HOLIDAYS], "date string").withColumn("date", F.to_date("date"))


def _daily_sql(key: str = "'all'", unit: str = "day", source: str = "fact_sales_stream") -> str:
    kind = "DATE" if unit == "day" else "TIMESTAMP"
    return f"""daily AS (SELECT {key} AS series, CAST(date_trunc('{unit}', order_ts) AS {kind}) AS date,
                  CAST(sum(net_revenue) AS BIGINT) AS y FROM {source} GROUP BY 1, 2)"""


def _slot_sql(unit: str, col: str) -> str:
    return f"dayofweek({col}) + 1" if unit == "day" else f"hour({col})"


def _fit_sql(src: str, unit: str = "day", holidays: bool = False) -> str:
    off = f"CASE WHEN {_HOLIDAY_SQL} THEN 1 ELSE 0 END" if holidays else "0"
    return f"""
st AS (SELECT series, min(date) AS start, max(date) AS last FROM {src} GROUP BY 1),
dt AS (SELECT d.*, s.start, s.last, CAST(date_diff('{unit}', s.start, d.date) AS BIGINT) AS t
       FROM {src} d JOIN st s USING (series)),
sums AS (SELECT series, start, last, count(*) AS n, sum(t) AS st, sum(y) AS sy, sum(t * t) AS stt,
                sum(CAST(t AS HUGEINT) * y) AS sty FROM dt GROUP BY 1, 2, 3),
fit0 AS (SELECT *, CASE WHEN n * stt - st * st <> 0
                   THEN CAST(n * sty - st * sy AS DOUBLE) / CAST(n * stt - st * st AS DOUBLE) ELSE 0.0 END AS slope
         FROM sums),
fit AS (SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(st AS DOUBLE)) / n AS intercept FROM fit0),
wd AS (SELECT d.series, {_slot_sql(unit, 'd.date')} AS wd, count(*) AS nw, sum(t) AS stw, sum(y) AS syw
       FROM dt d GROUP BY 1, 2),
eff AS (SELECT w.series, w.wd, (CAST(syw AS DOUBLE) - f.intercept * nw - f.slope * CAST(stw AS DOUBLE)) / nw AS effect
        FROM wd w JOIN fit f USING (series)),
res AS (SELECT d.series, d.y - (f.intercept + f.slope * d.t + e.effect) AS r, {off} AS off
        FROM dt d JOIN fit f USING (series) JOIN eff e ON e.series = d.series AND e.wd = {_slot_sql(unit, 'd.date')}),
hol AS (SELECT series, coalesce(avg(r) FILTER (off = 1), 0.0) AS hol FROM res GROUP BY 1),
sig AS (SELECT series, coalesce(stddev_samp(r - off * hol), 0.0) AS sigma, any_value(hol) AS hol
        FROM res JOIN hol USING (series) GROUP BY 1)"""


def _fc_sql(horizon: int, conf: float, unit: str = "day", holidays: bool = False) -> str:
    z = Z_BY_CONFIDENCE[conf]
    off = f"CASE WHEN {_HOLIDAY_SQL} THEN hol ELSE 0 END" if holidays else "0"
    later = "CAST(f.last + CAST(h AS INTEGER) AS DATE)" if unit == "day" else f"f.last + to_{unit}s(CAST(h AS INTEGER))"
    return f"""
fch AS (SELECT f.*, s.sigma, s.hol, h, {later} AS date
        FROM fit f JOIN sig s USING (series), (SELECT unnest(generate_series(1, {horizon})) AS h)),
fcv AS (SELECT series, date, n, sigma,
               intercept + slope * CAST(date_diff('{unit}', start, date) AS DOUBLE)
                 + coalesce((SELECT effect FROM eff e WHERE e.series = fch.series AND e.wd = {_slot_sql(unit, 'fch.date')}), 0.0) + {off}
                 AS v FROM fch),
fc AS (SELECT series, date, round(v, 0) AS revenue,
              round(v - CAST({z} AS DOUBLE) * sigma * sqrt(CAST(1 AS DOUBLE) + CAST(1 AS DOUBLE) / n), 0) AS lower_bound,
              round(v + CAST({z} AS DOUBLE) * sigma * sqrt(CAST(1 AS DOUBLE) + CAST(1 AS DOUBLE) / n), 0) AS upper_bound
       FROM fcv)"""


_DAILY = _daily_sql()
_FC_SQL = f"WITH {_DAILY}, {_fit_sql('daily')}, {_fc_sql(HORIZON, CONF)}"
_FVA_SQL = (f"WITH {_DAILY}, train AS (SELECT * FROM daily WHERE date <= (SELECT max(date) FROM daily) - {HOLDOUT}),"
            f" {_fit_sql('train')}, {_fc_sql(HOLDOUT, CONF)},"
            """ fva AS (SELECT fc.date, fc.revenue AS predicted, fc.lower_bound, fc.upper_bound, d.y AS actual,
                       abs(fc.revenue - d.y) / nullif(d.y, 0) * 100 AS mape_pct,
                       CASE WHEN d.y BETWEEN fc.lower_bound AND fc.upper_bound THEN 'Within CI'
                            ELSE 'Outside CI' END AS ci_hit
                FROM fc JOIN daily d USING (date))""")


def _nest(sql_with: str, final: str) -> str:
    """Put a forecast ``WITH`` block after the layer CTEs."""
    return with_ctes("").rstrip() + ",\n" + sql_with[len("WITH "):] + "\n" + final


_FIT_SQL = """
SELECT f.series, f.start, f.last, f.n, CAST(round(CAST(f.slope AS DECIMAL(38, 12)), 6) AS DOUBLE) AS slope,
       CAST(round(CAST(f.intercept AS DECIMAL(38, 12)), 2) AS DOUBLE) AS intercept,
       CAST(round(CAST(s.sigma AS DECIMAL(38, 12)), 2) AS DOUBLE) AS sigma FROM fit f JOIN sig s USING (series)"""


def _fit_row(fit: DataFrame) -> DataFrame:
    return fit.select(KEY, "start", "last", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"),
                      F.round("sigma", 2).alias("sigma"))


def _keyed(spark, d, key, unit="day"):
    """Series per category or per product of the streamed sales; only a
    product's sums meet its category."""
    lk = lake(spark, d)
    sales = revenue_series(lk.table("fact_sales_stream"), unit=unit, keys=["product_id"])
    if key == "product_id":
        return sales
    products = lk.table("dim_products").select("product_id", "category")
    return revenue_series(sales.join(products, "product_id"), "time_bucket", unit, [key])


_BY_CATEGORY = "(SELECT s.order_ts, s.net_revenue, p.category FROM fact_sales_stream s JOIN s_products p USING (product_id))"
for _key, _source in (("category", _BY_CATEGORY), ("product_id", "fact_sales_stream")):
    _name = "category" if _key == "category" else "product"
    _with = f"WITH {_daily_sql(_key, source=_source)}, {_fit_sql('daily')}, {_fc_sql(HORIZON, CONF)}"
    register(f"forecast_fit_by_{_name}", _nest(_with, _FIT_SQL))(
        lambda spark, d, k=_key: _fit_row(forecast_fit(_keyed(spark, d, k), [k])))
    register(f"forecast_by_{_name}", _nest(_with, "SELECT * FROM fc"))(
        lambda spark, d, k=_key: forecast(forecast_fit(_keyed(spark, d, k), [k]), HORIZON, CONF))

register("forecast_hourly", _nest(f"WITH {_daily_sql(unit='hour')}, {_fit_sql('daily', 'hour')}, {_fc_sql(48, CONF, 'hour')}", "SELECT * FROM fc"))(
    lambda spark, d: forecast(forecast_fit(revenue_series(lake(spark, d).table("fact_sales_stream"), unit="hour"), unit="hour"), 48, CONF, "hour"))

register("forecast_with_holidays", _nest(f"WITH {_DAILY}, {_fit_sql('daily', holidays=True)}, {_fc_sql(HORIZON, CONF, holidays=True)}", "SELECT * FROM fc"))(
    lambda spark, d: forecast(forecast_fit(_series(spark, d), holidays=_holidays(spark)), HORIZON, CONF, holidays=_holidays(spark)))

register("forecast_vs_actual_shifted", _nest(f"WITH {_DAILY}, {_fit_sql('daily')}, {_fc_sql(30, CONF)}", """
SELECT fc.date, fc.revenue AS predicted, fc.lower_bound, fc.upper_bound, d.y AS actual,
       abs(fc.revenue - d.y) / nullif(d.y, 0) * 100 AS mape_pct,
       CASE WHEN d.y >= fc.lower_bound AND d.y <= fc.upper_bound THEN 'Within CI' ELSE 'Outside CI' END AS ci_hit
FROM fc JOIN daily d ON d.date + 30 = fc.date"""))(
    lambda spark, d: forecast_vs_actual(_series(spark, d), confidence=CONF, shift_days=30))

register("revenue_series", with_ctes("""
SELECT date_trunc('day', order_ts) AS time_bucket, CAST(sum(net_revenue) AS BIGINT) AS net_revenue
FROM fact_sales_stream GROUP BY 1"""))(lambda spark, d: _series(spark, d))

register("forecast_fit", _nest(_FC_SQL, _FIT_SQL))(lambda spark, d: _fit_row(forecast_fit(_series(spark, d))))

register("forecast", _nest(_FC_SQL, "SELECT * FROM fc"))(lambda spark, d: _fc(spark, d))

def _since(days: int) -> str:
    return f"date_key >= DATE '{(ORDERS_AS_OF - dt.timedelta(days=days)).date()}'"


def _sales(spark, d, days):
    return lake(spark, d).table_since("fact_sales", days, ORDERS_AS_OF)


for _suffix, _days in {"": DAYS, "_30d": 30}.items():
    register("history" + _suffix, with_ctes(f"""
SELECT date_key AS date, CAST(sum(net_revenue) AS BIGINT) AS revenue, CAST(sum(gross_profit) AS BIGINT) AS gross_profit,
       {avg_pct_sql('gross_margin_pct')} AS avg_margin, count(DISTINCT order_id) AS orders
FROM fact_sales WHERE {_since(_days)} GROUP BY 1"""))(
        lambda spark, d, days=_days: history(_sales(spark, d, days), days, ORDERS_AS_OF))
    register("category_forecast" + _suffix, with_ctes(f"""
SELECT category, CAST(sum(net_revenue) AS BIGINT) AS revenue_last30,
       sum(net_revenue) / count(DISTINCT date_key) AS avg_daily,
       round(sum(net_revenue) / count(DISTINCT date_key) * {HORIZON}, 0) AS projected_revenue
FROM fact_sales WHERE {_since(_days)} GROUP BY 1"""))(
        lambda spark, d, days=_days: category_forecast(_sales(spark, d, days), HORIZON, days, ORDERS_AS_OF))
    register("top_products_forecast" + _suffix, with_ctes(f"""
SELECT product_name, category, brand,
       round(sum(net_revenue) / count(DISTINCT date_key) * {HORIZON}, 0) AS projected_revenue,
       {avg_pct_sql('gross_margin_pct')} AS avg_margin
FROM fact_sales WHERE {_since(_days)} GROUP BY 1, 2, 3 ORDER BY 4 DESC NULLS LAST, 1, 2, 3 LIMIT 10"""))(
        lambda spark, d, days=_days: top_products_forecast(_sales(spark, d, days), HORIZON, days, ORDERS_AS_OF))

register("forecast_vs_actual", _nest(_FVA_SQL, "SELECT * FROM fva"))(lambda spark, d: _fva(spark, d))

register("forecast_summary", _nest(_FC_SQL, """
SELECT sum(revenue) AS total_forecast, avg(revenue) AS avg_daily_forecast, max(revenue) AS peak_forecast,
       min(revenue) AS trough_forecast, avg(upper_bound - lower_bound) AS ci_width_avg,
       min_by(revenue, date) AS first_forecast, (SELECT max_by(y, date) FROM daily) AS last_actual,
       (min_by(revenue, date) - (SELECT max_by(y, date) FROM daily)) / (SELECT max_by(y, date) FROM daily) * 100
         AS delta_first_vs_last_pct
FROM fc"""))(lambda spark, d: forecast_summary(_fc(spark, d), _series(spark, d)))

register("forecast_accuracy", _nest(_FVA_SQL, """
SELECT CAST(round(CAST(avg(mape_pct) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS mape,
       CAST(count_if(ci_hit = 'Within CI') AS BIGINT) AS ci_hits, count(*) AS ci_total,
       count_if(ci_hit = 'Within CI') * 100 / count(*) AS ci_pct FROM fva"""))(
    lambda spark, d: forecast_accuracy(_fva(spark, d)))

register("forecast_worst_misses", _nest(_FVA_SQL, """
SELECT date, actual, predicted, mape_pct FROM fva WHERE ci_hit = 'Outside CI'
ORDER BY mape_pct DESC NULLS LAST, date LIMIT 5"""))(lambda spark, d: forecast_worst_misses(_fva(spark, d)))

register("forecast_error_bars", _nest(_FC_SQL, """
SELECT date, revenue, upper_bound - revenue AS error_plus, revenue - lower_bound AS error_minus FROM fc"""))(
    lambda spark, d: forecast_error_bars(_fc(spark, d)))
