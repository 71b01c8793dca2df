"""The lead table: one row per contact, derived from orders, customer and lineitem.

Each source is read only when a requested column needs it: most profiles touch
orders alone, and the per-customer history is ordered only when asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.functions.hashing import hex_int
from dialwise.operators.ordering import running
from dialwise.scale import is_small
from dialwise.sources.tables import table

NUMERIC = ["age", "campaign", "pdays", "previous", "euribor3m"]
CATEGORICAL = ["job", "marital", "education", "default", "housing", "loan",
               "contact", "month", "day_of_week", "poutcome"]
FEATURES = ["age", "job", "marital", "education", "default", "housing", "loan", "contact",
            "month", "day_of_week", "campaign", "pdays", "previous", "poutcome", "euribor3m"]
COLUMNS = ["lead_id", "cust_id", "contact_ts", *FEATURES, "duration", "y",
           "h", "h2", "score", "prob_short", "prob_long"]

FROM_LINES = {"housing", "loan", "campaign", "y", "score", "poutcome"}
FROM_HISTORY = {"previous", "pdays", "poutcome"}

# Calendar names, in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

NEVER_CONTACTED = 999


def build_leads(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None,
                strategy: str = "auto") -> DataFrame:
    """Leads with ``lead_id`` and the requested ``columns`` (all by default)."""
    columns = list(dict.fromkeys(["lead_id", *(columns or COLUMNS)]))
    wanted = set(columns)
    orders = table(spark, sf_dir, "orders")
    if strategy == "auto":
        strategy = "plain" if is_small(orders) else "bucketed"
    df = orders.select(F.col("o_orderkey").alias("lead_id"), "o_custkey", "o_orderdate",
                       "o_orderstatus", "o_orderpriority", "o_totalprice")

    if wanted & FROM_LINES:
        df = df.join(_line_flags(spark, sf_dir), F.col("lead_id") == F.col("l_orderkey"), "left") \
               .withColumn("y", F.coalesce("any_hit", F.lit(0)))
    if wanted & FROM_HISTORY:
        df = _with_history(df, wanted, strategy)
    if "job" in wanted:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")

    exprs = _expressions()
    if wanted & {"h", "h2", "score", "prob_short", "prob_long"}:
        hashes = {name: exprs.pop(name) for name in ("h", "h2")}
        df = df.withColumns(hashes)
    return df.select(*[exprs.get(c, F.col(c)).alias(c) for c in columns])


def _line_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    hit = returned & (F.col("l_discount") >= 0.085) & (F.col("l_quantity") >= 20)
    return lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max(returned.cast("int")).alias("any_returned"),
        F.max((F.col("l_tax") >= 0.075).cast("int")).alias("any_taxed"),
        F.max(hit.cast("int")).alias("any_hit"))


def _with_history(df, wanted, strategy):
    prior = {}
    if "pdays" in wanted:
        prior["prev_ts"] = "o_orderdate"
    if "poutcome" in wanted:
        prior["prev_y"] = "y"
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86_400
    second = F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.second("o_orderdate")
    return running(df, day + second, "lead_id", group=["o_custkey"], prior=prior,
                   rank="visit", strategy=strategy)


def _expressions():
    customer, status, key = F.col("o_custkey"), F.col("o_orderstatus"), F.col("lead_id")
    priority = F.substring("o_orderpriority", 1, 1)
    ts = F.col("o_orderdate")
    months = (F.year(ts) - 1995) * 12 + F.month(ts) - 1
    gap = F.date_diff(F.col("o_orderdate").cast("date"), F.col("prev_ts").cast("date"))
    duration = F.floor(F.col("o_totalprice") / 1400.0).cast("int")
    key_text = key.cast("string")
    boosted = (F.col("y") == 1) | (F.col("h2") % 8 == 0)
    s = F.shiftright(F.col("h") * 700_000, 32) + F.when(boosted, 300_000).otherwise(0)
    pl = F.shiftright(F.col("h2") * 550_000, 32) + F.when(duration > 180, 450_000).otherwise(0)
    return {
        "cust_id": customer,
        "contact_ts": ts,
        "age": (18 + customer % 70).cast("int"),
        "job": F.col("c_mktsegment"),
        "marital": F.when(status == "F", "married").when(status == "O", "single").otherwise("divorced"),
        "education": F.when(priority == "1", "university.degree").when(priority == "2", "professional.course")
                      .when(priority == "3", "high.school").when(priority == "5", "basic.9y")
                      .otherwise("unknown"),
        "default": F.when(key % 50 == 0, "yes").when(key % 5 == 0, "unknown").otherwise("no"),
        "housing": F.when(F.col("any_returned").isNull(), "unknown")
                    .when(F.col("any_returned") == 1, "yes").otherwise("no"),
        "loan": F.when(F.col("any_taxed") == 1, "yes").otherwise("no"),
        "contact": F.when(key % 3 == 0, "telephone").otherwise("cellular"),
        "month": F.lower(F.date_format(ts, "MMM")),
        "day_of_week": F.lower(F.date_format(ts, "E")),
        "duration": duration,
        "campaign": F.greatest(F.coalesce(F.col("n_lines"), F.lit(1)), F.lit(1)).cast("int"),
        "previous": (F.col("visit") - 1).cast("int"),
        "pdays": F.when(gap < NEVER_CONTACTED, gap).otherwise(NEVER_CONTACTED).cast("int"),
        "poutcome": F.when(F.col("prev_y").isNull(), "nonexistent")
                     .when(F.col("prev_y") == 1, "success").otherwise("failure"),
        "euribor3m": F.lit(5.0) - F.lit(0.05) * months,
        "y": F.col("y"),
        "h": hex_int(F.md5(key_text), 1, 8),
        "h2": hex_int(F.md5(F.concat(F.lit("d"), key_text)), 1, 8),
        "score": s / F.lit(1e6),
        "prob_long": pl / F.lit(1e6),
        "prob_short": 1 - pl / F.lit(1e6),
    }
