"""Registered encoding, naive Bayes, voting and feature-score queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.profile import each, rounded

from dialwise.operators import encode, groups, selection
from dialwise.operators.information import neighbour_information
from dialwise.plans.bayes import fit_gaussian_bayes
from dialwise.plans.baselines import class_proportional, majority_class, soft_vote
from dialwise.scale import materialise
from dialwise.sources.leads import build_leads
from dialwise.sources.tables import table

CODED = ["job", "education", "month"]


@query("e01_label_encode", lead_sql="SELECT lead_id, " + ", ".join(
    f"(SELECT count(DISTINCT b.{c}) FROM leads b WHERE b.{c} < a.{c})::INTEGER AS {c}" for c in CODED)
    + " FROM leads a")
def e01(spark, sf):
    return encode.label_encode(build_leads(spark, sf, CODED), CODED)


@query("e01_label_encode_documents", sql="""
  SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS lang,
    (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS source FROM documents""")
def e01_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return encode.label_encode(docs, ["lang", "source"])


@query("e02_ordinal_encode", lead_sql="""
  SELECT lead_id, CASE education WHEN 'illiterate' THEN 0 WHEN 'basic.4y' THEN 1 WHEN 'basic.6y' THEN 2
    WHEN 'basic.9y' THEN 3 WHEN 'high.school' THEN 4 WHEN 'professional.course' THEN 5
    WHEN 'university.degree' THEN 6 ELSE -1 END AS education FROM leads""")
def e02(spark, sf):
    return encode.ordinal_encode(build_leads(spark, sf, ["education"]))


@query("e03_one_hot", lead_sql="""
  SELECT lead_id, (marital = 'married')::INTEGER AS marital_married, (marital = 'single')::INTEGER AS marital_single,
    (poutcome = 'nonexistent')::INTEGER AS poutcome_nonexistent, (poutcome = 'success')::INTEGER AS poutcome_success
  FROM leads""")
def e03(spark, sf):
    return encode.one_hot(build_leads(spark, sf, ["marital", "poutcome"]), ["marital", "poutcome"])


@query("e03_one_hot_vector", lead_sql="""
  SELECT marital, (marital = 'single')::INTEGER::DOUBLE AS v0, (marital = 'married')::INTEGER::DOUBLE AS v1,
    count(*) AS n FROM leads GROUP BY ALL""")
def e03_vector(spark, sf):
    coded = encode.one_hot_vector(build_leads(spark, sf, ["marital"]), ["marital"])
    flat = coded.withColumn("v", vector_to_array("marital__onehot"))
    return flat.groupBy("marital", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1")) \
               .agg(F.count(F.lit(1)).alias("n"))


@query("e04_standardise", lead_sql="SELECT lead_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM leads)) / (SELECT stddev_pop({c}) FROM leads), 6) AS {c}"
    for c in ("age", "campaign", "duration")) + " FROM leads")
def e04(spark, sf):
    cols = ["age", "campaign", "duration"]
    return rounded(encode.standardise(build_leads(spark, sf, cols), cols), *cols)


@query("e05_assemble", lead_sql="""
  SELECT lead_id, age::DOUBLE AS f0, campaign::DOUBLE AS f1, pdays::DOUBLE AS f2, previous::DOUBLE AS f3,
    round(euribor3m, 9) AS f4 FROM leads""")
def e05(spark, sf):
    cols = ["age", "campaign", "pdays", "previous", "euribor3m"]
    out = encode.assemble(build_leads(spark, sf, cols), cols)
    flat = out.select("lead_id", vector_to_array("features").alias("features"))
    return flat.select("lead_id", *[F.round(F.col("features")[i], 9).alias(f"f{i}") for i in range(len(cols))])


BAYES = ["age", "campaign", "duration", "pdays"]
SMOOTH = 1e-4


def bayes_sql():
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in BAYES)
    extra = f"{SMOOTH}::DOUBLE * greatest({', '.join(f'(SELECT var_pop({f}) FROM leads)' for f in BAYES)})"
    like = lambda c: f"ln({c}.prior) " + " ".join(
        f"- 0.5 * ln(2 * pi() * ({c}.v_{f} + e)) - pow(l.{f} - {c}.m_{f}, 2) / (2 * ({c}.v_{f} + e))" for f in BAYES)
    return f""", s AS (SELECT y, count(*) / (SELECT count(*) FROM leads) AS prior, {stats} FROM leads GROUP BY y),
      x AS (SELECT {extra} AS e),
      g AS (SELECT l.lead_id, ({like('n')}) - ({like('p')}) AS gap FROM leads l, x,
        (SELECT * FROM s WHERE y = 0) n, (SELECT * FROM s WHERE y = 1) p)
      SELECT lead_id, round(1 / (1 + exp(gap)), 6) AS prob FROM g"""


@query("l03_gaussian_bayes", lead_sql=bayes_sql())
def l03(spark, sf):
    leads = build_leads(spark, sf, [*BAYES, "y"])
    model = fit_gaussian_bayes(leads, BAYES, var_smoothing=SMOOTH)
    return rounded(model.transform(leads).select("lead_id", "prob"), "prob")


@query("l06_soft_voting", lead_sql="""
  SELECT lead_id, round((score + prob_long + h / 4294967296.0::DOUBLE) / 3, 9) AS prob FROM leads""")
def l06(spark, sf):
    one = lambda c, expr: build_leads(spark, sf, [c]).select("lead_id", expr.alias("prob"))
    members = [one("score", F.col("score")), one("prob_long", F.col("prob_long")),
               one("h", F.col("h") / F.lit(4294967296.0))]
    return rounded(soft_vote(members, "lead_id"), "prob", digits=9)


@query("l07_trivial_baselines", lead_sql="""
  SELECT lead_id, y, (SELECT mode(y) FROM leads) AS majority,
    (('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE
      < (SELECT avg(y) FROM leads))::INTEGER AS proportional FROM leads""")
def l07(spark, sf):
    leads = build_leads(spark, sf, ["y"])
    out = majority_class(leads, leads, "y", "majority")
    return class_proportional(out, leads, "y", "lead_id", "proportional")


DISCRETE, CONTINUOUS = ["job", "housing", "loan", "month", "campaign"], ["age", "euribor3m", "duration"]

MI_PARTS = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, {c}::VARCHAR AS bin, y FROM leads" for c in DISCRETE]
    + [f"""SELECT '{c}', floor((rank() OVER (ORDER BY {c}::DOUBLE) - 1) * 256 / (count(*) OVER ()))::VARCHAR, y
       FROM leads""" for c in CONTINUOUS])
MI_CTE = f""", parts AS ({MI_PARTS}),
  cells AS (SELECT feature, bin, y, count(*) AS n FROM parts GROUP BY ALL),
  margins AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny,
    sum(n) OVER (PARTITION BY feature) AS nn FROM cells),
  mi AS (SELECT feature, sum(n / nn * ln(n * nn / (nb * ny))) AS mutual_information FROM margins GROUP BY feature)
"""


def mi_scores(spark, sf):
    leads = build_leads(spark, sf, [*DISCRETE, *CONTINUOUS, "y"])
    return selection.mutual_information(leads, DISCRETE, CONTINUOUS)


@query("l13_mutual_information", lead_sql=MI_CTE + """
  SELECT feature, round(mutual_information, 8) AS mutual_information FROM mi""")
def l13(spark, sf):
    return rounded(mi_scores(spark, sf), "mutual_information", digits=8)


RANK_COLS = ["campaign", "age", "euribor3m", "duration"]
RANK_CTE = MI_CTE + ", sc AS (SELECT q.feature, abs_r, spread, mutual_information FROM (" + each(
    RANK_COLS, """SELECT '{c}' AS feature, abs(corr({q}, y)) AS abs_r,
      abs(avg({q}) FILTER (y = 1) - avg({q}) FILTER (y = 0)) / stddev_samp({q}) AS spread FROM leads""") + """) q
  JOIN mi USING (feature)),
  comb AS (SELECT feature, abs_r, spread, mutual_information, (
    (abs_r - min(abs_r) OVER ()) / (max(abs_r) OVER () - min(abs_r) OVER ())
    + (spread - min(spread) OVER ()) / (max(spread) OVER () - min(spread) OVER ())
    + (mutual_information - min(mutual_information) OVER ())
      / (max(mutual_information) OVER () - min(mutual_information) OVER ())) / 3 AS combined FROM sc)
"""


def three_scores(spark, sf):
    leads = build_leads(spark, sf, [*RANK_COLS, "y"])
    gap = lambda c: F.abs(F.avg(F.when(F.col("y") == 1, F.col(c))) - F.avg(F.when(F.col("y") == 0, F.col(c))))
    spread = leads.agg(*[(gap(c) / F.stddev_samp(c)).alias(c) for c in RANK_COLS]) \
                  .unpivot([], RANK_COLS, "feature", "spread")
    return (groups.target_correlations(leads, RANK_COLS).drop("r").join(spread, "feature")
            .join(mi_scores(spark, sf), "feature"))


@query("l14_combined_ranking", lead_sql=RANK_CTE + "SELECT feature, round(combined, 6) AS combined FROM comb")
def l14(spark, sf):
    ranked = selection.combined_ranking(three_scores(spark, sf), ["abs_r", "spread", "mutual_information"])
    return rounded(ranked.select("feature", "combined"), "combined")


@query("l17_selection_summary", lead_sql=RANK_CTE + """
  , t AS (SELECT feature, combined,
    feature IN (SELECT feature FROM comb ORDER BY combined DESC, feature LIMIT 2) AS by_topk,
    combined >= 0.2 AS by_threshold,
    feature IN (SELECT feature FROM comb ORDER BY mutual_information DESC, feature LIMIT 2) AS by_information FROM comb)
  SELECT feature, round(combined, 6) AS combined, by_topk, by_threshold, by_information,
    by_topk::INTEGER + by_threshold::INTEGER + by_information::INTEGER AS votes FROM t""")
def l17(spark, sf):
    # three selections read this table, which has one row per feature
    ranked = materialise(selection.combined_ranking(
        three_scores(spark, sf), ["abs_r", "spread", "mutual_information"]))
    top = lambda by: ranked.orderBy(F.desc(by), "feature").limit(2)
    out = selection.selection_summary(ranked.select("feature", "combined"), {
        "topk": top("combined"), "threshold": ranked.where("combined >= 0.2"),
        "information": top("mutual_information")})
    return rounded(out, "combined")


def digamma_sql(n):
    x = f"({n} + 6)::DOUBLE"
    series = f"ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} * {x}) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6))"
    return f"({series} - " + " - ".join(f"1 / ({n} + {i})::DOUBLE" for i in range(6)) + ")"


#: by comparing all pairs of distinct values
NEIGHBOUR_SQL = ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c}::DOUBLE AS v FROM leads" for c in CONTINUOUS) + f"""),
  counted AS (SELECT feature, y, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, y) AS n_class FROM long GROUP BY feature, y, v),
  pairs AS (SELECT a.feature, a.y, a.v, a.n, a.n_class, abs(b.v - a.v) AS far, least(3, a.n_class - 1) AS k,
      sum(b.n - (b.v = a.v)::INTEGER) OVER (PARTITION BY a.feature, a.y, a.v ORDER BY abs(b.v - a.v)) AS upto
    FROM counted a JOIN counted b ON a.feature = b.feature AND a.y = b.y WHERE a.n_class > 1),
  reached AS (SELECT feature, y, v, n, n_class, k, min(far) AS r FROM pairs WHERE upto >= k GROUP BY ALL),
  met AS (SELECT a.*, sum(b.n) AS m FROM reached a JOIN counted b ON a.feature = b.feature AND b.n_class > 1
    AND ((a.r = 0 AND b.v = a.v) OR (a.r > 0 AND b.v < a.v + a.r AND b.v > a.v - a.r)) GROUP BY ALL)
  SELECT feature, round(greatest({digamma_sql('sum(n)')} + sum(n * ({digamma_sql('k')} - {digamma_sql('n_class')} - {digamma_sql('m')})) / sum(n), 0), 8)
    AS mutual_information FROM met GROUP BY feature"""


@query("l13_mutual_information_neighbours", lead_sql=NEIGHBOUR_SQL)
def l13_neighbours(spark, sf):
    leads = build_leads(spark, sf, [*CONTINUOUS, "y"])
    return rounded(neighbour_information(leads, CONTINUOUS), "mutual_information", digits=8)
