"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.llm.nearest_time import LEFT, RIGHT, default_buckets, events, replay
from vislake.operators.tsys import has_antenna, session_terms, usable
from vislake.session import bounded, ensure_utc, micros, table


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vis_id, antenna_no, rec_id, distance_us): the nearest usable reading for both ends of every dataset row."""
    ensure_utc(spark)
    terms = session_terms(table(spark, sf_dir, "sessions")).select("session", "tol_us", "ceiling")
    reach = terms.agg(F.max("tol_us")).first()[0] or 0.0
    numbers = table(spark, sf_dir, "antennas").where(F.col("name").isNotNull() & F.col("antenna_no").isNotNull()).select("name", "antenna_no").distinct()
    vis = table(spark, sf_dir, "dataset").select("vis_id", "session", micros(F.col("datetime")).alias("t_us"), F.explode(F.array_distinct(F.array("a1", "a2"))).alias("name"))
    left = vis.join(bounded(numbers), "name").join(bounded(terms), "session")
    rows = table(spark, sf_dir, "system_temperature").select("session", "rec_id", micros(F.col("time")).alias("t_us"), "antenna_no", "tsys_1")
    right = rows.join(bounded(terms), "session").where(has_antenna(F.col("antenna_no")) & usable(F.col("tsys_1"), F.col("ceiling")))
    buckets = default_buckets(vis)
    entity = ["session", "antenna_no"]
    both = events(left, LEFT, entity, "t_us", "vis_id", "antenna_no", "tol_us", buckets).unionByName(events(right, RIGHT, entity, "t_us", "rec_id", None, "tol_us", buckets))
    pairs = replay(both, float(reach))
    return pairs.select(F.col("left_id").alias("vis_id"), F.col("payload").cast("int").alias("antenna_no"), F.col("right_id").alias("rec_id"), F.abs(F.col("right_us") - F.col("left_us")).alias("distance_us"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs alone."""
    return p6_matches(spark, sf_dir).select("vis_id", "antenna_no", "rec_id").distinct()


QUERIES = {"p6_found": p6_found}

ORACLE = {
    "p6_found": """
WITH ends AS (
  SELECT DISTINCT d.vis_id, d.session, epoch_us(d.datetime) t, a.antenna_no, s.match_tol_s * 1e6 tol
  FROM (SELECT vis_id, session, datetime, a1 n FROM dataset UNION SELECT vis_id, session, datetime, a2 FROM dataset) d
  JOIN antennas a ON a.name = d.n JOIN sessions s USING (session)),
r AS (
  SELECT DISTINCT t.session, t.antenna_no, t.rec_id, epoch_us(t.time) rt FROM system_temperature t JOIN sessions s USING (session)
  WHERE t.antenna_no >= 1 AND isfinite(t.tsys_1) AND t.tsys_1 > 0 AND t.tsys_1 <= s.tsys_ceiling),
c AS (SELECT vis_id, antenna_no, rec_id, row_number() OVER (PARTITION BY vis_id, antenna_no ORDER BY abs(rt - t), rt, rec_id) n FROM ends JOIN r USING (session, antenna_no) WHERE abs(rt - t) <= tol)
SELECT vis_id, antenna_no, rec_id FROM c WHERE n = 1
""",
}
