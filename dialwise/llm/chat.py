"""Chat formatting: logged snapshots collapse to the longest conversation, which is then rendered.

A conversation's prefix hashes roll over its turns: each is the sum of hashes of
(place, role, text), so it is built by a running total and equal prefixes have
equal hashes. A conversation is dropped by an anti-join when a longer one has
its full hash as prefix hash at its length. Prefixes are made distinct before
the join, so a first turn that everybody shares is one row there.

Turns are numbered by position after sorting, and totals run in chunks of
``CHUNK`` turns, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialwise.llm.common import query, store, table

CHUNK = 4096
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def turn_hash() -> F.Column:
    """Decimal, so that sums over any number of turns neither wrap nor overflow."""
    return F.xxhash64("place", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()) \
        .cast("decimal(38,0)")


def placed(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, place``: places from 0 in order of turn; exact repeats of a row count once.

    Rows that share a turn number are ordered by role and text. Rows without a
    conversation id belong to no conversation and go. A null turn ranks first.
    """
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")) \
        .where("conv_id IS NOT NULL")
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1 << 40))
    rows = slim.groupBy("conv_id", chunk.alias("chunk"), "turn", "role", "text").agg(F.lit(1).alias("one"))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    local = rows.withColumn("at", F.row_number().over(inner) - 1)
    sizes = local.groupBy("conv_id", "chunk").agg(F.count("at").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv_id", "chunk", "first")
    return local.join(offsets, ["conv_id", "chunk"]) \
        .select("conv_id", "chunk", "turn", "role", "text", (F.col("at") + F.col("first")).cast("long").alias("place"))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """``conv_id, n, prefix``: the hash of a conversation's first ``n`` turns, for every n."""
    hashed = rows.select("conv_id", "chunk", "place", turn_hash().alias("h"))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = hashed.withColumn("local", F.sum("h").over(inner))
    sums = hashed.groupBy("conv_id", "chunk").agg(F.sum("h").alias("whole"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("base", F.coalesce(F.sum("whole").over(before), F.lit(0).cast("decimal(38,0)"))).select("conv_id", "chunk", "base")
    return parts.join(offsets, ["conv_id", "chunk"]) \
        .select("conv_id", (F.col("place") + 1).alias("n"), (F.col("local") + F.col("base")).alias("prefix"))


def maximal(turns: DataFrame) -> DataFrame:
    """Turns (``conv_id, place, role, text``) of the conversations that are no proper prefix of another.

    Of equal conversations the one with the smallest id stays.
    """
    rows = store(placed(turns))
    wide = rows.select("conv_id", "chunk", "place", "role", "text")
    hashes = store(prefix_hashes(wide))
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("n", "prefix")).alias("end")).select("conv_id", "end.n", "end.prefix")
    longest = ends.groupBy("n", "prefix").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.join(ends.select("conv_id", F.col("n").alias("size")), "conv_id").where("n < size") \
        .select("n", "prefix").distinct()
    kept = longest.join(inner, ["n", "prefix"], "left_anti").select("conv_id")
    return wide.join(kept, "conv_id").select("conv_id", "place", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered``: role headers and texts in order; null roles and texts render as empty."""
    opening, header, closing = TEMPLATE
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit(header), F.coalesce("text", F.lit("")), F.lit(closing))
    return turns.groupBy("conv_id").agg(F.count("place").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines")) \
        .select("conv_id", "n_turns", F.concat_ws("", F.col("lines.line")).alias("rendered"))


ORACLE = """
WITH rows AS (
  SELECT DISTINCT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text
  FROM rows),
pre AS (
  SELECT conv_id, place AS n, string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2))
    OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed),
size AS (SELECT conv_id, max(n) AS n FROM pre GROUP BY conv_id),
ends AS (SELECT min(pre.conv_id) AS conv_id, n, prefix FROM pre JOIN size USING (conv_id, n) GROUP BY n, prefix),
longer AS (SELECT DISTINCT pre.n, prefix FROM pre JOIN size USING (conv_id) WHERE pre.n < size.n),
kept AS (SELECT conv_id FROM ends ANTI JOIN longer USING (n, prefix))
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id
"""


@query("op2_chat_format", ORACLE)
def op2(spark, sf_dir):
    return render(maximal(table(spark, sf_dir, "conversations")))
