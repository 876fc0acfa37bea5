"""Hand-written frames for the semantic decisions of SURVEY §2.14."""
import datetime as dt

from pyspark.sql import functions as F

from tidemart.functions.economics import line_economics, percent_discount
from tidemart.functions.money import avg_pct, div_half_up, pct_half_up
from tidemart.functions.quality import Rule, dedup_latest, split_valid
from tidemart.operators import gold as G
from tidemart.operators import stream_topics as ST
from tidemart.plans import commerce_ops as C
from tidemart.plans import forecasting as FC


def test_allocation_is_exact_and_does_not_overflow(spark):
    # Q1: 2,800,000 x 28,000,000 overflows INT; Q10: subtotal 0; null discount
    df = spark.createDataFrame(
        [(1, 28_000_000, 19_600_000, 2_800_000, 28_000_000), (1, 100, 70, 10, 0), (2, 100, 70, None, 200),
         (1, 1, 0, 100, 3), (1, 1, 0, 100, 3), (1, 1, 0, 100, 3)],
        "q long, p long, cost long, d long, s long")
    out = df.withColumns(line_economics("q", "p", "cost", "d", "s")).collect()
    assert out[0].allocated_discount == 2_800_000 and out[0].net_revenue == 25_200_000
    assert out[0].gross_margin_pct == 22.22
    assert out[1].allocated_discount == 0 and out[1].net_revenue == 100
    assert out[2].allocated_discount == 0
    # three equal lines share 100: each rounds to 33 (HALF_UP), net is exact
    assert [r.allocated_discount for r in out[3:]] == [33, 33, 33]
    assert all(r.net_revenue + r.allocated_discount == r.gross_revenue for r in out)


def test_half_up_rounding(spark):
    df = spark.createDataFrame([(101, 2), (-101, 2), (1005, 1000), (7, 0)], "n long, d long")
    r = df.select(div_half_up("n", "d").alias("q"), pct_half_up("n", "d").alias("p")).collect()
    assert [x.q for x in r] == [51, -51, 1, None]
    assert r[2].p == 100.5 and r[3].p is None


def test_avg_pct_is_order_independent(spark):
    vals = [(x / 100.0,) for x in range(1, 33)]
    a = spark.createDataFrame(vals, "m double").repartition(7).agg(avg_pct("m")).first()[0]
    b = spark.createDataFrame(list(reversed(vals)), "m double").coalesce(1).agg(avg_pct("m")).first()[0]
    assert a == b == (sum(range(1, 33)) / 32) / 100.0


def test_percent_discount_truncates(spark):
    df = spark.createDataFrame([(999, "10.00"), (1_000_000_001, "12.50")], "s long, p string")
    r = df.select(percent_discount("s", F.col("p").cast("decimal(5,2)")).alias("d")).collect()
    assert [x.d for x in r] == [99, 125_000_000]


def test_split_valid_null_rule_goes_to_bad(spark):
    # Q2: null event_type with the rest present lands in bad, not nowhere
    df = spark.createDataFrame([("e1", None), ("e2", "user_login"), (None, None)], "event_id string, event_type string")
    rules = [Rule("null event_id", F.col("event_id").isNotNull()),
             Rule("unknown event_type", F.col("event_type").isin("user_login"))]
    good, bad = split_valid(df, rules)
    assert good.count() + bad.count() == df.count()
    reasons = sorted(r.quarantine_reason for r in bad.collect())
    assert reasons == ["null event_id", "unknown event_type"]


def test_bad_events_are_never_collapsed(spark):
    # Q4: two different rows with null event_id both reach quarantine
    raw = spark.createDataFrame(
        [("ecommerce.user", 0, 1, None, '{"event_type": "user_login"}'),
         ("ecommerce.user", 0, 2, None, '{"event_type": "user_logout"}'),
         ("ecommerce.user", 0, 3, None, "not json"),
         ("ecommerce.user", 0, 4, None, '{"event_id": "E1", "event_type": "user_login", '
                                        '"timestamp": "2024-01-01 00:00:00", "user_id": "U1"}'),
         ("ecommerce.user", 1, 9, None, '{"event_id": "E1", "event_type": "user_login", '
                                        '"timestamp": "2024-01-01 00:00:00", "user_id": "U1"}')],
        "topic string, partition int, offset long, kafka_timestamp timestamp, json_str string")
    good, bad = ST.split_topic(ST.parse(raw, "ecommerce.user"), "ecommerce.user")
    assert bad.count() == 3 and good.count() == 1
    assert good.first().offset == 4   # first delivery wins
    assert {r.quarantine_reason for r in bad.collect()} == {"null event_id", "unparsable json"}


def test_dedup_latest_is_deterministic_on_ties(spark):
    # Q5: equal ingested_at; the business timestamp then the row hash decide
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t, t, "a"), ("k", t, t + dt.timedelta(1), "b"), ("j", t, t, "x"),
                                ("j", t, t, "y")], "id string, ingested_at timestamp, ts timestamp, v string")
    order = [F.col("ingested_at"), F.col("ts"), F.xxhash64("id", "ingested_at", "ts", "v")]
    once = dedup_latest(df, "id", order)
    r = {x.id: x.v for x in once.collect()}
    assert r["k"] == "b"
    again = {x.id: x.v for x in dedup_latest(df.repartition(3), "id", order).collect()}
    assert again == r
    assert dedup_latest(once, "id", order).count() == once.count()  # idempotent


def test_stock_status_bands(spark):
    df = spark.createDataFrame([(None,), (0,), (9,), (10,), (19,), (20,), (49,), (50,)], "s long")
    got = [r[0] for r in df.select(G.stock_status("s")).collect()]
    assert got == ["Unknown", "Critical", "Critical", "Low", "Low", "Medium", "Medium", "Healthy"]


def test_sentiment_and_has_comment(spark):
    df = spark.createDataFrame([(i, 1, "P", "U", r, c, dt.datetime(2024, 1, 1)) for i, (r, c) in enumerate(
        [(1, "x"), (2, None), (3, "  "), (4, " ok "), (5, "")])],
        "review_id long, x int, product_id string, user_id string, rating int, comment string, review_date timestamp")
    r = G.fact_reviews(df).orderBy("review_id").collect()
    assert [x.sentiment_label for x in r] == ["Negative", "Negative", "Neutral", "Positive", "Positive"]
    assert [x.has_comment for x in r] == [True, False, False, True, False]


def test_dim_date(spark):
    d = G.dim_date(spark)
    assert d.count() == 2922
    first = d.orderBy("date_key").first()
    assert (first.day_of_week_num, first.day_of_week_name, first.week_of_year, first.is_weekend) == (1, "Sunday", 52, True)
    leap = d.filter(F.col("date_key") == F.lit("2024-02-29").cast("date")).first()
    assert leap.month_name == "February" and leap.year_month == "2024-02"


def test_promotion_ranges_are_null_open(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [("A", "A", "5.00", None, None, True), ("B", "B", "6.00", t, None, True), ("C", "C", "7.00", None, t, True),
            ("D", "D", "8.00", t + dt.timedelta(1), None, True), ("E", "E", "9.00", None, None, False)]
    p = spark.createDataFrame(rows, "promo_id string, promo_code string, discount_percent string, start_date timestamp, "
                                    "end_date timestamp, is_active boolean") \
        .withColumn("discount_percent", F.col("discount_percent").cast("decimal(5,2)"))
    got = [r.promo_id for r in C.active_promotions(p, t).collect()]
    assert got == ["C", "B", "A"]   # bounds equal to as_of are inside; D not started; E inactive


def test_forecast_exact_line(spark):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(i), 1000 + 10 * i) for i in range(21)]
    s = spark.createDataFrame(days, "time_bucket timestamp, net_revenue long")
    fit = FC.forecast_fit(s).first()
    assert abs(fit.slope - 10.0) < 1e-9 and abs(fit.intercept - 1000.0) < 1e-6 and fit.sigma < 1e-6
    fc = FC.forecast(FC.forecast_fit(s), horizon=3).orderBy("date").collect()
    assert [r.revenue for r in fc] == [1210.0, 1220.0, 1230.0]
    assert all(r.lower_bound == r.upper_bound == r.revenue for r in fc)


def test_forecast_single_day_series(spark):
    s = spark.createDataFrame([(dt.datetime(2024, 1, 1), 500)], "time_bucket timestamp, net_revenue long")
    fc = FC.forecast(FC.forecast_fit(s), horizon=2).collect()
    assert [r.revenue for r in fc] == [500.0, 500.0]


def test_cart_state_latest_wins(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("S1", "P1", 1, t, "e1"), ("S1", "P1", 3, t + dt.timedelta(seconds=5), "e2"),
                                ("S1", "P1", 0, t + dt.timedelta(seconds=9), "e3"), ("S1", "P2", 2, t, "e4")],
                               "session_id string, product_id string, cart_quantity_after long, event_ts timestamp, "
                               "event_id string")
    got = {(r.product_id): r.quantity for r in C.cart_state(ev).collect()}
    assert got == {"P1": 0, "P2": 2}


def _half_up(fr):
    from fractions import Fraction
    sign = -1 if fr < 0 else 1
    a = abs(fr)
    return sign * int(a + Fraction(1, 2)) if a.denominator != 1 else int(fr)


def test_money_matches_exact_fractions(spark):
    """Integer HALF_UP allocation and percentages equal exact rational
    arithmetic on random rows (including negatives and zero denominators)."""
    import random
    from fractions import Fraction
    rnd = random.Random(7)
    rows = [(rnd.randint(-10**9, 10**9), rnd.choice([0, rnd.randint(-10**6, 10**6)]) or 0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "n long, d long").repartition(5)
    got = df.select("n", "d", div_half_up("n", "d").alias("q"), pct_half_up("n", "d").alias("p")).collect()
    for r in got:
        if r.d == 0:
            assert r.q is None and r.p is None
            continue
        assert r.q == _half_up(Fraction(r.n, r.d))
        assert r.p == _half_up(Fraction(r.n * 10000, r.d)) / 100.0


def test_line_ids_never_collide(spark):
    """250 lines of one order with two line numbers, and a two-digit line
    number beside the next order: 252 + 1 ids, all different."""
    import tempfile

    from tidemart.sources.adapters import inventory_logs, numbered_lines, order_items
    row = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    import datetime as dt
    base = (1.0, 10.0, 0.0, 0.0, "R", "F", dt.date(1996, 1, 1))
    lines = [(7, 1, 1, 1 + i % 2, *base) for i in range(250)] + [(7, 1, 1, 10, *base), (8, 1, 1, 1, *base), (200000, 2, 1, 1, *base)]
    df = spark.createDataFrame(lines, row)
    numbered = numbered_lines(df, tempfile.mkdtemp() + "/lines")
    ids = [r.item_id for r in order_items(numbered).select("item_id").collect()]
    assert sorted(ids) == list(range(1, 254))
    part = spark.createDataFrame([(1,), (2,)], "p_partkey long")
    logs = [r.log_id for r in inventory_logs(numbered, part).select("log_id").collect()]
    assert len(set(logs)) == len(logs) == 253 * 2 + 2


def test_allocation_of_amounts_beyond_long_products(spark):
    from fractions import Fraction

    from tidemart.functions.economics import allocated_discount
    rows = [(3 * 10**9, 4 * 10**9, 5 * 10**9), (10**18, 10**18, 3 * 10**18), (7, 3, 2), (10**12, 999_999_999_999, 1_000_000_000_001), (-(10**12), 10**12, 3), (1, 1, 2)]
    got = spark.createDataFrame(rows, "d long, g long, s long").select("d", "g", "s", allocated_discount("d", "g", "s").alias("a"))
    import math
    for r in got.filter("d > 0").collect():
        assert r.a == math.floor(Fraction(r.d * r.g, r.s) + Fraction(1, 2))


def test_orders_beyond_int_are_valid_events(spark):
    from tidemart.operators import stream_topics as ST
    from tidemart.schemas import RAW_EVENT_SCHEMA, TOPIC_ORDER
    msg = '{"event_id": "E1", "event_type": "order_created", "timestamp": "2024-01-05 10:00:00", "user_id": "U1", "order_id": "O1", "subtotal": 3000000000, "total_amount": 3000000000, "items": [{"product_id": "P1", "quantity": 1, "unit_price": 3000000000, "unit_cost": 2000000000}]}'
    raw = spark.createDataFrame([(TOPIC_ORDER, 0, 1, None, msg)], RAW_EVENT_SCHEMA)
    fr = ST.process_static(raw, TOPIC_ORDER)
    assert fr.quarantine.count() == 0
    assert fr.gold["fact_orders_stream"].first().total_amount == 3_000_000_000


def test_fit_of_long_series_of_large_amounts(spark):
    """2,400 days at 5e9 a day: the sums of the fit pass a LONG."""
    import datetime as dt

    from tidemart.plans.forecasting import forecast_fit
    rows = [(dt.datetime(1995, 1, 1) + dt.timedelta(days=i), 5_000_000_000 + 1000 * i) for i in range(2400)]
    fit = forecast_fit(spark.createDataFrame(rows, "time_bucket timestamp, net_revenue long")).first()
    assert fit.n == 2400 and abs(fit.slope - 1000) < 1e-6 and abs(fit.intercept - 5e9) < 1


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    import pytest

    from tidemart import session

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else None

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_percent_of_amounts_beyond_a_long_product(spark):
    """10,000 times the amount passes a LONG: the division is exact still."""
    from fractions import Fraction
    rows = [(10**15, 2 * 10**15), (2**62, 3 * 2**40), (-(10**17), 7 * 10**16), (10**15, -3 * 10**15), (10**18, 10**18 - 1), (1, 2**63 - 1), (10**15 + 1, 8 * 10**15), (5, 0), (None, 2)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", pct_half_up("n", "d").alias("p")).collect()
    for r in got:
        if r.n is None or not r.d:
            assert r.p is None
            continue
        f = Fraction(r.n, r.d) * 10000
        want = (1 if f > 0 else -1) * int(abs(f) + Fraction(1, 2)) / 100.0
        assert r.p == want


def _brute_split(rows):
    """rows: (key, amount, weight, tie) -> {(key, tie): part}."""
    out, keys = {}, {}
    for r in rows:
        keys.setdefault(r[0], []).append(r)
    for key, lines in keys.items():
        amount = lines[0][1] or 0
        weight = [max(w or 0, 0) for _, _, w, _ in lines]
        total = sum(weight)
        if key is None or not total:
            out.update({(key, t): 0 for *_, t in lines})
            continue
        whole = [abs(amount) * w // total for w in weight]
        left = abs(amount) - sum(whole)
        order = sorted(range(len(lines)), key=lambda i: (-(abs(amount) * weight[i] % total), lines[i][3]))
        for place, i in enumerate(order):
            out[key, lines[i][3]] = (whole[i] + (place < left)) * (1 if amount >= 0 else -1)
    return out


def test_parts_of_an_amount_add_up(spark):
    """Orders of 1 to 10,000 lines, by one window and by counts alike."""
    import random

    from tidemart.functions.apportion import apportion
    rng, rows, tie = random.Random(5), [], 0
    for order, n in enumerate([1, 2, 3, 7, 50, 400, 3000, 10_000]):
        same = order % 2                       # every other order has lines that are all alike, or nearly
        amount = rng.randint(0, 10**9) if order != 4 else 10**15
        for _ in range(n):
            tie += 1
            rows.append((f"o{order}", amount, 10 if same else rng.randint(1, 10**6) * (10**9 if order == 4 else 1), tie))
    rows += [("neg", -101, 1, 1), ("neg", -101, 1, 2), ("zero", 50, 0, 3), ("null", None, 5, 4), ("some", 7, None, 5), ("some", 7, 3, 6), ("some", 7, -9, 7), (None, 5, 5, 8)]
    want = _brute_split(rows)
    df = spark.createDataFrame(rows, "k string, amount long, w long, tie long").repartition(3).withColumn("bucket", F.lit("own")).withColumn("m", F.lit("own"))
    for hot, bucket in ((10**6, 10), (20, 16), (0, 1)):
        got = apportion(df, "k", "amount", "w", "tie", "part", hot, bucket)
        assert got.columns == [*df.columns, "part"]
        assert {(r.k, r.tie): r.part for r in got.collect()} == want
    for o, a in {r[0]: r[1] for r in rows if r[0] and r[0].startswith("o")}.items():
        assert sum(p for (k, _), p in want.items() if k == o) == a
    assert apportion(df.limit(0), "k", "amount", "w", "tie").count() == 0


def test_a_hot_order_is_spread(spark):
    """No window of the counted path gathers a whole order."""
    from tidemart.functions.apportion import apportion
    df = spark.range(5000).select(F.lit("one").alias("k"), F.lit(777).cast("long").alias("amount"), (F.col("id") % 3).alias("w"), F.col("id").alias("tie"))
    got = apportion(df, "k", "amount", "w", "tie", "part", hot_lines=100, bucket_lines=64)
    assert got.agg(F.sum("part")).first()[0] == 777
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "row_number" in x]
    assert any("__bucket" in x for x in windows)


def test_top_lists_are_exact_by_proof_or_by_full_count(spark):
    import datetime as dt
    import random

    from tidemart.plans.heavy import summaries, top_items
    rng, start = random.Random(9), dt.datetime(2024, 1, 1)

    def events(weights, n=3000):
        names = [f"i{k}" for k in range(len(weights))]
        rows = [(start + dt.timedelta(minutes=rng.randrange(600)), x if rng.random() > .02 else None) for x in rng.choices(names, weights, k=n)]
        return spark.createDataFrame(rows, "event_ts timestamp, x string"), rows

    skewed, even = [1000 / (k + 1) ** 2 for k in range(60)], [1] * 60
    for weights, sure in ((skewed, True), (even, False)):
        df, rows = events(weights)
        for hours in (5, 24):
            got, proven = top_items(summaries(df, "x", keep=12), df, "x", hours, 4, start + dt.timedelta(hours=10, minutes=13))
            since = start + dt.timedelta(hours=10, minutes=13) - dt.timedelta(hours=hours)
            counts = {}
            for t, x in rows:
                if x is not None and t >= since:
                    counts[x] = counts.get(x, 0) + 1
            assert [(r["item"], r["n"]) for r in got.collect()] == sorted(counts.items(), key=lambda r: (-r[1], r[0]))[:4]
            assert proven == sure
    none = df.limit(0)
    assert top_items(summaries(none, "x"), none, "x", 5, 4, start)[0].count() == 0


def test_autoregression_finds_its_terms_and_forecasts_better(spark):
    """An AR(2) around a trend and a weekly pattern, and white noise beside it."""
    import datetime as dt
    import random

    from tidemart.plans import autoregression as A
    from tidemart.plans import forecasting as M
    rng, n, hold, day0 = random.Random(4), 600, 14, dt.date(2020, 1, 1)
    rows = []
    for name, (p1, p2) in {"ar": (0.9, -0.4), "noise": (0.0, 0.0), "slow": (0.95, 0.0)}.items():
        e = [0.0, 0.0]
        for i in range(n):
            e.append(p1 * e[-1] + p2 * e[-2] + rng.gauss(0, 1000))
            rows.append((name, day0 + dt.timedelta(days=i), int(100_000 + 20 * i + 3000 * (i % 7) + e[-1])))
    df = spark.createDataFrame(rows, "series string, date date, y long")
    train = df.filter(F.col("date") < day0 + dt.timedelta(days=n - hold))
    fit = A.fit_ar(train)
    got = {r.series: r for r in fit.collect()}
    assert got["noise"].ar_order <= 2 and got["ar"].ar_order >= 2
    assert abs(got["ar"].phi[0] - 0.9) < 0.12 and abs(got["ar"].phi[1] + 0.4) < 0.12
    assert 900 < got["ar"].innovation_sigma < 1100 < got["ar"].sigma
    errors = {}
    for name, fc in (("with", A.forecast_ar(fit, hold)), ("without", M.forecast(M.fit_buckets(train), hold))):
        j = fc.join(df, ["series", "date"]).groupBy("series").agg(F.sqrt(F.avg((F.col("revenue") - F.col("y")) ** 2)).alias("e"))
        errors[name] = {r.series: r.e for r in j.collect()}
    assert errors["with"]["slow"] < errors["without"]["slow"]
    short = A.fit_ar(df.filter(F.col("date") < day0 + dt.timedelta(days=3))).collect()
    assert {r.ar_order for r in short} == {0}
    # runs cut anywhere give the same sums
    rest = A.residuals(train, M.fit_buckets(train))
    a, b = ({(r.series, r.k): r.s for r in A.lag_products(rest, 5, block).collect()} for block in (4096, 37))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-9 * abs(a[k]) + 1e-3 for k in a)
