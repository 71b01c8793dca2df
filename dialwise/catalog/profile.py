"""Registered profiling queries."""

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.operators import profile
from dialwise.sources.leads import CATEGORICAL, COLUMNS, NUMERIC, build_leads
from dialwise.sources.tables import table

TYPES = {"lead_id": "bigint", "cust_id": "bigint", "contact_ts": "timestamp_ntz", "h": "bigint",
         "h2": "bigint", "score": "double", "prob_short": "double", "prob_long": "double",
         "euribor3m": "double", "age": "int", "campaign": "int", "pdays": "int", "previous": "int",
         "duration": "int", "y": "int"}


def each(columns, template):
    return " UNION ALL ".join(template.format(c=c, q=f'"{c}"', t=TYPES.get(c, "string")) for c in columns)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("p01_shape", lead_sql=f"SELECT count(*) AS n_rows, {len(COLUMNS)}::BIGINT AS n_columns FROM leads")
def p01(spark, sf):
    return profile.shape(build_leads(spark, sf))


@query("p02_head", lead_sql="SELECT * FROM leads ORDER BY lead_id LIMIT 5")
def p02(spark, sf):
    return profile.head(build_leads(spark, sf), "lead_id", 5)


@query("p03_info", lead_sql=each(
    COLUMNS, "SELECT '{c}' AS \"column\", '{t}' AS dtype, count({q}) AS non_null FROM leads"))
def p03(spark, sf):
    return profile.info(build_leads(spark, sf))


DESCRIBE = """count({q}) AS count, round(avg({q}), 6) AS mean, round(stddev_samp({q}), 6) AS std,
  min({q})::DOUBLE AS min, round(quantile_cont({q}::DOUBLE, 0.25), 6) AS q25,
  round(quantile_cont({q}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({q}::DOUBLE, 0.75), 6) AS q75,
  max({q})::DOUBLE AS max"""
STATS = ["mean", "std", "q25", "q50", "q75"]


@query("p04_describe_numeric", lead_sql=each(
    [*NUMERIC, "duration"], "SELECT '{c}' AS \"column\", " + DESCRIBE + " FROM leads"))
def p04(spark, sf):
    cols = [*NUMERIC, "duration"]
    return rounded(profile.describe_numeric(build_leads(spark, sf, cols), cols), *STATS)


@query("p05_describe_categorical", lead_sql=each(
    CATEGORICAL, """SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
      arg_min(v, (-n, v)) AS top, max(n) AS freq
      FROM (SELECT {q} AS v, count(*) AS n FROM leads WHERE {q} IS NOT NULL GROUP BY {q})"""))
def p05(spark, sf):
    return profile.describe_categorical(build_leads(spark, sf, CATEGORICAL), CATEGORICAL)


@query("p06_columns_by_type", lead_sql=each(
    [c for c in COLUMNS if c != "contact_ts"],
    "SELECT '{c}' AS \"column\", CASE WHEN '{t}' = 'string' THEN 'categorical' ELSE 'numeric' END AS kind, "
    "count({q}) AS n FROM leads"))
def p06(spark, sf):
    leads = build_leads(spark, sf)
    counted = profile.info(leads).select("column", F.col("non_null").alias("n"))
    return profile.column_types(leads).where("kind <> 'other'").join(counted, "column")


@query("p07_null_report", lead_sql="""
  SELECT * FROM (
    SELECT 'prev_gap' AS "column", count(*) - count(nullif(pdays, 999)) AS nulls,
           round(100.0 * (count(*) - count(nullif(pdays, 999))) / count(*), 6) AS pct FROM leads
    UNION ALL SELECT 'age', count(*) - count(age), round(100.0 * (count(*) - count(age)) / count(*), 6)
    FROM leads) WHERE nulls > 0""")
def p07(spark, sf):
    leads = build_leads(spark, sf, ["age", "pdays"]).withColumn("prev_gap", F.expr("nullif(pdays, 999)"))
    return rounded(profile.null_report(leads, ["prev_gap", "age"]), "pct")


@query("p08_sentinel_report", lead_sql="SELECT * FROM (" + each(
    CATEGORICAL, """SELECT '{c}' AS "column", count(*) FILTER ({q} = 'unknown') AS n,
      round(100.0 * count(*) FILTER ({q} = 'unknown') / count(*), 6) AS pct FROM leads""") + ") WHERE n > 0")
def p08(spark, sf):
    return rounded(profile.sentinel_report(build_leads(spark, sf, CATEGORICAL), CATEGORICAL), "pct")


@query("p09_value_counts", lead_sql="""
  SELECT job, count(*) AS n, round(count(*) / (SELECT count(*) FROM leads), 6) AS share
  FROM leads GROUP BY job""")
def p09(spark, sf):
    return rounded(profile.value_counts(build_leads(spark, sf, ["job"]), "job"), "share")


@query("p09_value_counts_events", sql="""
  SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share
  FROM events GROUP BY event_type""")
def p09_events(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "events"), "event_type"), "share")


@query("p10_distinct_counts", lead_sql=each(
    [*CATEGORICAL, "age"], 'SELECT \'{c}\' AS "column", count(DISTINCT {q}) AS "unique" FROM leads'))
def p10(spark, sf):
    cols = [*CATEGORICAL, "age"]
    return profile.distinct_counts(build_leads(spark, sf, cols), cols)


@query("p11_imbalance", lead_sql="""
  SELECT count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives,
    round(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0), 6) AS ratio FROM leads""")
def p11(spark, sf):
    return rounded(profile.imbalance(build_leads(spark, sf, ["y"])), "ratio")


HISTOGRAM = """, lim AS (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / {n} AS w FROM {t}),
  hits AS (SELECT {by} least(floor(({c}::DOUBLE - lo) / w), {n} - 1)::INTEGER AS bin, count(*) AS n
           FROM {t}, lim GROUP BY ALL),
  grid AS (SELECT {by} i::INTEGER AS bin FROM {classes} range({n}) r(i))
  SELECT grid.*, round(lo + grid.bin * w, 6) AS left_edge, coalesce(hits.n, 0) AS n
  FROM grid CROSS JOIN lim LEFT JOIN hits USING ({using} bin)"""


@query("p12_histogram", lead_sql=HISTOGRAM.format(c="duration", n=50, t="leads", by="", classes="", using=""))
def p12(spark, sf):
    return rounded(profile.histogram(build_leads(spark, sf, ["duration"]), "duration"), "left_edge")


@query("p12_histogram_by_class", lead_sql=HISTOGRAM.format(
    c="age", n=50, t="leads", by="y,", classes="(SELECT DISTINCT y FROM leads),", using="y,"))
def p12_by(spark, sf):
    return rounded(profile.histogram(build_leads(spark, sf, ["age", "y"]), "age", by="y"), "left_edge")


@query("p12_histogram_events", sql="WITH x AS (SELECT 1)" + HISTOGRAM.format(
    c="value", n=50, t="events", by="", classes="", using=""))
def p12_events(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "events"), "value"), "left_edge")


BOX = """, q AS (SELECT {key} quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50,
    quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM leads {group}),
  f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS low, q75 + 1.5 * (q75 - q25) AS high FROM q)
  SELECT {fkey} round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
    min({c}::DOUBLE) FILTER ({c} BETWEEN low AND high) AS whisker_low,
    max({c}::DOUBLE) FILTER ({c} BETWEEN low AND high) AS whisker_high,
    count(*) FILTER ({c} NOT BETWEEN low AND high) AS outliers, count(*) AS n
  FROM leads JOIN f ON {on} GROUP BY ALL"""


@query("p13_box_stats", lead_sql=BOX.format(c="campaign", key="", group="", fkey="", on="true"))
def p13(spark, sf):
    return rounded(profile.box_stats(build_leads(spark, sf, ["campaign"]), "campaign"), "q25", "q50", "q75")


@query("p13_box_stats_by_class", lead_sql=BOX.format(
    c="pdays", key="y,", group="GROUP BY y", fkey="f.y,", on="leads.y = f.y"))
def p13_by(spark, sf):
    return rounded(profile.box_stats(build_leads(spark, sf, ["pdays", "y"]), "pdays", by="y"),
                   "q25", "q50", "q75")


@query("p14_density_by_class", lead_sql=""", b AS (
    SELECT y, duration::DOUBLE AS b, count(*) AS c FROM leads WHERE duration < 2000 GROUP BY ALL),
  s AS (SELECT y, sum(c) AS n, min(b) AS lo, max(b) AS hi,
          sqrt((sum(b*b*c) - sum(b*c) * sum(b*c) / sum(c)) / (sum(c) - 1)) AS sd FROM b GROUP BY y),
  g AS (SELECT s.*, sd * pow(n::DOUBLE, -0.2) AS h, p::INTEGER AS point, lo + p * (hi - lo) / 199.0 AS x
        FROM s, range(200) r(p))
  SELECT y, point, round(x, 6) AS x,
    round(sum(c * exp(-pow((x - b) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
  FROM g JOIN b USING (y) GROUP BY ALL""")
def p14(spark, sf):
    leads = build_leads(spark, sf, ["duration", "y"]).where("duration < 2000")
    return rounded(rounded(profile.density(leads, "duration", "y"), "x"), "density", digits=9)
