"""Sources, sinks and cleaning."""

from __future__ import annotations

import datetime
import uuid

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.functions.dates import parse_mixed_date
from ratepanel.operators import clean, metrics, prep
from ratepanel.operators.models import assemble
from ratepanel.plans import panels
from ratepanel.plans.catalog.registry import BASE, PANEL, RAW, base_preds, base_rows, query, r, rounded, rs, with_sql
from ratepanel.session import settle, shared_folder
from ratepanel.sources import bars, rates, sinks, symbols


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_read_rates", with_sql(PANEL) + f"SELECT key, date, {rs(['rate'])} FROM panel")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "rates")
    raw = panels.order_rates(spark, sf)
    sinks.write(raw.select("date", F.col("key").alias("currency_code"), F.col("rate").alias("exchange_rate")), path, "csv")
    return rounded(rates.read_rates(spark, path, "csv"))


# text dates in five forms; one order in fifty has no readable date
MIXED_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "d.M.yyyy", "MMM d, yyyy", "d MMM yyyy")


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("o_orderkey") % len(MIXED_FORMS)
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(MIXED_FORMS):
        text = F.when(form == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    unreadable = F.col("o_orderkey") % 50 == 0
    return panels.table(spark, sf, "orders").select(
        "o_orderkey", F.when(unreadable, F.lit("no date")).otherwise(text).alias("text")
    )


@query(
    "a2_parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders",
)
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return text_dates(spark, sf).select("o_orderkey", parse_mixed_date("text").alias("date"))


@query("a3_required_columns", with_sql(PANEL) + "SELECT key, count(*) AS n_rows FROM panel GROUP BY key")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    df = rates.require(panels.panel_orders(spark, sf), ["key", "date", "rate"])
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))


# rows with holes: every 50th order lacks its key, date or rate in turn, and
# every 77th has a rate of zero
def holed(spark: SparkSession, sf: str) -> DataFrame:
    order = F.col("o_orderkey")
    gone = lambda i: (order % 50 == 0) & (F.floor(order / 50) % 3 == i)
    rate = F.when(order % 77 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / panels.PRICE_UNIT)
    return panels.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(~gone(0), F.col("o_orderpriority")).alias("key"),
        F.when(~gone(1), F.col("o_orderdate").cast("date")).alias("date"),
        F.when(~gone(2), rate).alias("rate"),
        F.col("o_orderstatus").alias("currency"),
    )


HOLED = """holed AS (
  SELECT o_orderkey,
    CASE WHEN NOT (o_orderkey % 50 = 0 AND (o_orderkey // 50) % 3 = 0) THEN o_orderpriority END AS key,
    CASE WHEN NOT (o_orderkey % 50 = 0 AND (o_orderkey // 50) % 3 = 1) THEN CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN NOT (o_orderkey % 50 = 0 AND (o_orderkey // 50) % 3 = 2)
      THEN CASE WHEN o_orderkey % 77 = 0 THEN 0e0 ELSE o_totalprice / 100003e0 END END AS rate
  FROM orders
)"""


@query(
    "a4_drop_incomplete",
    with_sql(HOLED)
    + f"SELECT o_orderkey, key, date, {rs(['rate'])} FROM holed WHERE key IS NOT NULL AND date IS NOT NULL AND rate IS NOT NULL",
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.drop_incomplete(holed(spark, sf)))


@query("a5_load_summary", with_sql(RAW) + "SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM raw")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return rates.load_summary(panels.order_rates(spark, sf))


@query(
    "a6_row_validation",
    with_sql(HOLED)
    + """SELECT o_orderkey, CASE WHEN date IS NULL THEN 'missing date' WHEN key IS NULL THEN 'missing key'
      WHEN rate IS NULL THEN 'missing rate' WHEN rate <= 0 THEN 'rate not positive' ELSE 'ok' END AS reason FROM holed""",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = rates.split_valid(holed(spark, sf))
    return good.select("o_orderkey", F.lit("ok").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))


# Event types of the test tables, as wide-table labels.
LABELS = ("click", "error", "purchase", "signup", "view")
FIELDS = ("open", "high", "low", "close", "volume")
WIDE = [f"{label}_{field}" for label in LABELS for field in FIELDS]


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.bars(panels.ticks(spark, sf), "hour")


def bars_table(spark: SparkSession, sf: str) -> DataFrame:
    """The bars written once, for operators that read them several times."""
    return settle(bars_hourly(spark, sf))


BARS = """bars AS (
  SELECT event_type AS key, date_trunc('hour', ts) AS date, arg_min(value, (ts, value)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, value)) AS close, count(value) AS volume
  FROM events GROUP BY 1, 2
)"""
WIDE_SQL = (
    BARS
    + ", wide AS (SELECT date, "
    + ", ".join(f"max({f}) FILTER (WHERE key = '{k}') AS {k}_{f}" for k in LABELS for f in FIELDS)
    + f" FROM bars WHERE key IN ({', '.join(repr(k) for k in LABELS)}) GROUP BY date)"
)


@query("a7_align_wide", with_sql(WIDE_SQL) + "SELECT * FROM wide")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return bars.align_wide(bars_hourly(spark, sf), LABELS, FIELDS)


def _filled(c: str) -> str:
    ahead = "ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({ahead})) AS {c}"


@query("a8_fill_gaps", with_sql(WIDE_SQL) + f"SELECT date, {', '.join(_filled(c) for c in WIDE)} FROM wide")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return bars.fill_gaps(settle(bars.align_wide(bars_hourly(spark, sf), LABELS, FIELDS)), WIDE)


@query("a9_close_only", with_sql(WIDE_SQL) + f"SELECT date, {', '.join(f'{k}_close' for k in LABELS)} FROM wide")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return bars.close_only(bars.align_wide(bars_hourly(spark, sf), LABELS, FIELDS))


@query(
    "a10_symbol_labels",
    """WITH dim AS (
      SELECT CAST(n_nationkey AS VARCHAR) AS symbol, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey
      WHERE r_name IN (SELECT min(r_name) FROM region UNION SELECT max(r_name) FROM region)
    ) SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS symbol, coalesce(label, CAST(c_nationkey AS VARCHAR)) AS label
    FROM customer LEFT JOIN dim ON symbol = CAST(c_nationkey AS VARCHAR)""",
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    # labels exist for the first and the last region only, so that the others fall back
    region, nation = panels.table(spark, sf, "region"), panels.table(spark, sf, "nation")
    ends = region.agg(F.array(F.min("r_name"), F.max("r_name")).alias("names")).select(F.explode("names").alias("r_name"))
    dim = (
        nation.join(region.join(ends, "r_name", "left_semi"), nation.n_regionkey == region.r_regionkey)
        .select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_name").alias("label"))
    )
    rows = panels.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("symbol"))
    return symbols.label(rows, dim).select("c_custkey", "symbol", "label")


@query(
    "a11_bars_daily",
    """SELECT event_type AS key, CAST(ts AS DATE) AS date, arg_min(value, (ts, value)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, value)) AS close, count(value) AS volume FROM events GROUP BY 1, 2""",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return bars.bars(panels.ticks(spark, sf), "day")


@query("a11_bars_hourly", with_sql(BARS) + "SELECT * FROM bars")
def a11_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars_hourly(spark, sf)


@query(
    "a12_predictions_sink",
    with_sql(BASE) + f"SELECT key, CAST(date AS VARCHAR) AS date, {r('rate')}, {r('SMA_5', 'predicted_rate')} FROM placed",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "predictions")
    sinks.write_predictions(base_rows(spark, sf).withColumn("predicted_rate", F.col("SMA_5")), path)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("key", "date", *[F.col(c).cast("double").alias(c) for c in ("rate", "predicted_rate")]))


METRICS_SQL = (
    BASE
    + """, steps AS (
  SELECT *, sign(y - lag(y) OVER w) AS dy, sign(pred - lag(pred) OVER w) AS dp FROM preds
  WINDOW w AS (PARTITION BY model ORDER BY pos)
), metrics AS (
  SELECT model, avg((y - pred) * (y - pred)) AS MSE, avg(abs(y - pred)) AS MAE, sqrt(avg((y - pred) * (y - pred))) AS RMSE,
    100 * avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) AS MAPE,
    1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y) + 1e-10) AS R2,
    100 * coalesce(avg(CASE WHEN dy IS NOT NULL THEN CASE WHEN dy = dp THEN 1e0 ELSE 0e0 END END), 0) AS DA
  FROM steps GROUP BY model
)"""
)


@query("a13_results_sink", with_sql(METRICS_SQL) + f"SELECT model, {rs(metrics.METRICS)} FROM metrics")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, "results")
    sinks.write_results(metrics.compare(base_preds(spark, sf)), base)
    back = spark.read.option("header", True).csv(f"{base}/{sinks.RESULTS}")
    return rounded(back.select("model", *[F.col(m).cast("double").alias(m) for m in metrics.METRICS]))


@query(
    "a14_scaler_params",
    with_sql(PANEL)
    + f"""SELECT key, 'rate' AS feature, {r('quantile_cont(rate, 0.5)', 'center')},
    {r('CASE WHEN quantile_cont(rate, 0.75) = quantile_cont(rate, 0.25) THEN 1 ELSE quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25) END', 'scale')}
    FROM panel GROUP BY key""",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, "params")
    sinks.save_params(prep.fit_robust(panels.panel_orders(spark, sf), ["rate"]), base)
    return rounded(sinks.load_params(spark, base))


OLS = """sums AS (
  SELECT var_pop(lag_1) AS a, covar_pop(lag_1, SMA_5) AS b, var_pop(SMA_5) AS c, covar_pop(lag_1, rate) AS t1,
    covar_pop(SMA_5, rate) AS t2 FROM placed
), ols AS (SELECT (c * t1 - b * t2) / (a * c - b * b) AS w1, (a * t2 - b * t1) / (a * c - b * b) AS w2 FROM sums)"""


@query(
    "a15_versioned_runs",
    with_sql(BASE, OLS)
    + f"SELECT 'run_20240101_120001' AS run_id, '0.0' AS reg, {r('w1', 'w_lag_1')}, {r('w2', 'w_sma_5')} FROM ols",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a small linear model; the newer one is the latest."""
    store = sinks.RunStore(spark, scratch(spark, "runs"))
    rows = settle(assemble(base_rows(spark, sf), ["lag_1", "SMA_5"]).select("rate", "features"))
    for second, reg in enumerate((0.1, 0.0)):
        when = datetime.datetime(2024, 1, 1, 12, 0, second)
        run_id = sinks.make_run_id(when)
        model = LinearRegression(labelCol="rate", regParam=reg, solver="normal").fit(rows)
        store.save_model(model, "linear", run_id)
        store.write_manifest(run_id, {"reg": reg, "columns": ["lag_1", "SMA_5"]})
        store.publish(run_id, when)
    newest = store.latest()
    weights = store.load_model("linear", newest).coefficients
    found = (newest, str(store.manifest(newest)["reg"]), float(weights[0]), float(weights[1]))
    return rounded(spark.createDataFrame([found], "run_id string, reg string, w_lag_1 double, w_sma_5 double"))


@query(
    "a16_metric_log",
    with_sql(METRICS_SQL)
    + " UNION ALL ".join(
        f"SELECT 'run_20240101_120000' AS run_id, model, '{m}' AS metric, {r(m, 'value')} FROM metrics" for m in metrics.METRICS
    ),
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    store = sinks.RunStore(spark, scratch(spark, "log"))
    store.log_metrics("run_20240101_120000", metrics.compare(base_preds(spark, sf)))
    return rounded(spark.read.parquet(f"{store.base}/metrics"))


# --- cleaning ---------------------------------------------------------------


def _fences(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    pick = f"{by}, " if by else ""
    return f"""fences AS (
  SELECT {pick}q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
    SELECT {pick}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM sizes {group})
)"""


# event values have a long tail, so that rows fall beyond the fences
SIZES = "sizes AS (SELECT event_id, event_type AS key, value AS x FROM events)"


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return panels.table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), F.col("value").alias("x"))


@query(
    "b1_iqr_filter",
    with_sql(SIZES, _fences("key"))
    + f"SELECT event_id, key, {rs(['x'])} FROM sizes JOIN fences USING (key) WHERE x BETWEEN low AND high",
)
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.iqr_filter(sizes(spark, sf), rate="x"))


@query(
    "b2_iqr_global",
    with_sql(SIZES, _fences(""))
    + f"SELECT event_id, key, {rs(['x'])} FROM sizes, fences WHERE x BETWEEN low AND high",
)
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.iqr_filter(sizes(spark, sf), by_key=False, rate="x"))


@query(
    "b3_iqr_report",
    with_sql(SIZES, _fences("key"))
    + """SELECT key, count(*) FILTER (WHERE x BETWEEN low AND high) AS kept,
    count(*) FILTER (WHERE NOT (x BETWEEN low AND high)) AS dropped FROM sizes JOIN fences USING (key) GROUP BY key""",
)
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return clean.iqr_report(sizes(spark, sf), rate="x")


@query("b4_in_order", with_sql(PANEL) + f"SELECT key, date, {rs(['rate'])} FROM panel ORDER BY key, date")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    return clean.in_order(rounded(panels.panel_orders(spark, sf)))
