"""Registered neighbour and rebalancing queries."""

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.profile import rounded
from dialwise.operators.neighbours import nearest_neighbours
from dialwise.operators.smote import smote
from dialwise.sources.leads import build_leads

SPACE = ["age", "campaign", "duration", "pdays", "previous"]

PAIRS = ", rare AS (SELECT * FROM leads WHERE y = 1), pairs AS (SELECT a.lead_id, b.lead_id AS neighbour, " + " + ".join(
    f"(a.{f} - b.{f})::BIGINT * (a.{f} - b.{f})" for f in SPACE) + """ AS distance
  FROM rare a JOIN rare b ON a.lead_id <> b.lead_id),
near AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY distance, neighbour) AS rank FROM pairs
  QUALIFY rank <= 5)
"""


@query("j06_minority_neighbours", lead_sql=PAIRS + """
  SELECT lead_id, rank::INTEGER AS rank, neighbour, distance::DOUBLE AS distance FROM near""")
def j06(spark, sf):
    rare = build_leads(spark, sf, [*SPACE, "y"]).where("y = 1")
    return nearest_neighbours(rare, "lead_id", SPACE, 5).drop("vector")


@query("r04_smote", lead_sql=PAIRS + """, sizes AS (SELECT count(*) FILTER (y = 1) AS few,
    count(*) FILTER (y = 0) - count(*) FILTER (y = 1) AS missing FROM leads),
  draws AS (SELECT j, floor(('0x' || substr(d, 1, 13))::BIGINT / pow(16, 13) * few)::BIGINT + 1 AS seed_rank,
      floor(('0x' || substr(d, 14, 6))::BIGINT / pow(16, 6) * 5)::INTEGER + 1 AS rank,
      ('0x' || substr(d, 20, 13))::BIGINT / pow(16, 13) AS u
    FROM (SELECT j, md5('42:' || j) AS d, few FROM sizes, range((SELECT missing FROM sizes)) r(j))),
  seeds AS (SELECT *, row_number() OVER (ORDER BY lead_id) AS seed_rank FROM rare)
  SELECT lead_id, y, age::DOUBLE AS age, campaign::DOUBLE AS campaign, duration::DOUBLE AS duration,
    pdays::DOUBLE AS pdays, previous::DOUBLE AS previous FROM leads
  UNION ALL SELECT -j - 1, 1, """ + ", ".join(f"round(s.{f} + u * (n.{f} - s.{f}), 6)" for f in SPACE) + """
  FROM draws JOIN seeds s USING (seed_rank) JOIN near ON near.lead_id = s.lead_id AND near.rank = draws.rank
  JOIN rare n ON n.lead_id = near.neighbour""")
def r04(spark, sf):
    return rounded(smote(build_leads(spark, sf, [*SPACE, "y"]), SPACE, "y", "lead_id"), *SPACE)


@query("a17_class_shares_after_smote", lead_sql="""
  SELECT y, (SELECT max(n) FROM (SELECT count(*) AS n FROM leads GROUP BY y)) AS n, 50.0::DOUBLE AS pct
  FROM leads GROUP BY y""")
def a17_smote(spark, sf):
    grown = smote(build_leads(spark, sf, [*SPACE, "y"]), SPACE, "y", "lead_id")
    counted = grown.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / counted.agg(F.sum("n")).scalar())
