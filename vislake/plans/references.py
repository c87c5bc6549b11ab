"""Queries of problem 4."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators.references import DIRECT_KIND, Child, Registry, cascade, text_key
from vislake.operators.tsys import has_antenna
from vislake.session import table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[dict[str, Child], dict[str, Registry]]:
    """Tables and links: bands of one record stand or fall together (rec_id: one orphaned band makes the record unusable), readings hang on the gain curve of their
    (session, antenna_no, band), visibilities on the observables of their (session, scan, source)."""
    antenna_key = F.when(has_antenna(F.col("antenna_no")), F.col("antenna_no"))
    registries = {
        "antennas": Registry(table(spark, sf_dir, "antennas"), [F.col("antenna_no")]),
        "sources": Registry(table(spark, sf_dir, "sources"), [text_key(F.col("name")), text_key(F.col("rfc_jname"))]),
    }
    band = ["session", "antenna_no", "band"]
    scan = ["session", "scan", "source"]
    children = {
        "system_temperature": Child(table(spark, sf_dir, "system_temperature"), "st_id", "time", "antennas", antenna_key, {"gain_curve": (band, band), "system_temperature": (["rec_id"], ["rec_id"])}),
        "gain_curve": Child(table(spark, sf_dir, "gain_curve"), "gc_id", "time", "antennas", antenna_key),
        "observables": Child(table(spark, sf_dir, "observables"), "obs_id", "datetime", "sources", text_key(F.col("source"))),
        "dataset": Child(table(spark, sf_dir, "dataset"), "vis_id", "datetime", None, None, {"observables": (scan, scan)}),
    }
    return children, registries


def _schema(spark: SparkSession, sf_dir: str) -> tuple[dict[str, Child], dict[str, Registry]]:
    """Every link of the schema: antenna numbers and names, sources, sessions; readings hang on the gain curve of their
    (session, antenna_no, band), tones on the session's gain curves of their antenna, visibilities on the observables of
    their (session, scan, source). Antenna names and sessions have no validity there."""
    children, registries = _graph(spark, sf_dir)
    number = F.when(has_antenna(F.col("antenna_no")), F.col("antenna_no"))
    source = text_key(F.col("source"))
    registries |= {"names": Registry(table(spark, sf_dir, "antennas"), [F.col("name")], None), "sessions": Registry(table(spark, sf_dir, "sessions"), [F.col("session")], None)}
    session = ("sessions", F.col("session"))
    ends = (("names", F.col("a1")), ("names", F.col("a2")))
    band, scan = ["session", "antenna_no", "band"], ["session", "scan", "source"]
    more = {
        "system_temperature": replace(children["system_temperature"], parents={"gain_curve": (band, band)}, more=(session,)),
        "gain_curve": replace(children["gain_curve"], more=(session,)),
        "tones": Child(table(spark, sf_dir, "tones"), "tone_id", "time", "antennas", number, {"gain_curve": (band[:2], band[:2])}, (session,)),
        "observables": replace(children["observables"], more=(session, *ends)),
        "dataset": Child(table(spark, sf_dir, "dataset"), "vis_id", "datetime", "sources", source, {"observables": (scan, scan)}, (session, *ends)),
    }
    return more, registries


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans of all four tables."""
    return cascade(*_graph(spark, sf_dir)).select("tab", "row_id", "kind", "reason", "depth")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans with their reasons, out of the finished fixpoint."""
    return cascade(*_graph(spark, sf_dir)).where(F.col("kind") == DIRECT_KIND).select("tab", "row_id", "reason")


def p4_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans over every link of the schema."""
    return cascade(*_schema(spark, sf_dir)).select("tab", "row_id", "kind", "reason", "depth")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    month = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM")
    return cascade(*_graph(spark, sf_dir)).groupBy("tab", month.alias("month"), "kind", "reason").agg(F.count("*").alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_cascade": p4_cascade, "p4_schema": p4_schema, "p4_report": p4_report}

_FOUND = """
WITH refs AS (
  SELECT 'system_temperature' tab, st_id row_id, time t, CAST(antenna_no AS VARCHAR) k, 'a' reg FROM system_temperature WHERE antenna_no >= 1
  UNION ALL SELECT 'gain_curve', gc_id, time, CAST(antenna_no AS VARCHAR), 'a' FROM gain_curve WHERE antenna_no >= 1
  UNION ALL SELECT 'observables', obs_id, datetime, upper(trim(source)), 's' FROM observables WHERE trim(source) <> ''),
keys AS (
  SELECT 'a' reg, CAST(antenna_no AS VARCHAR) k, added_at, removed_at FROM antennas
  UNION ALL SELECT 's', upper(trim(name)), added_at, removed_at FROM sources
  UNION ALL SELECT 's', upper(trim(rfc_jname)), added_at, removed_at FROM sources),
judged AS (
  SELECT tab, row_id, t, count(keys.k) n, bool_or(added_at <= t AND (removed_at IS NULL OR t < removed_at)) ok, bool_or(added_at <= t) before
  FROM refs LEFT JOIN keys USING (reg, k) GROUP BY ALL),
direct AS (SELECT tab, row_id, t, CASE WHEN n = 0 THEN 'missing' WHEN before THEN 'deleted' ELSE 'later' END reason FROM judged WHERE n = 0 OR NOT ok)
"""

_ALL = _FOUND.replace("WITH refs", "WITH RECURSIVE refs") + """,
st1 AS (
  SELECT DISTINCT c.st_id FROM system_temperature c JOIN gain_curve p USING (session, antenna_no, band) JOIN direct d ON d.tab = 'gain_curve' AND d.row_id = p.gc_id),
st2 AS (
  SELECT DISTINCT c.st_id FROM system_temperature c WHERE rec_id IN (SELECT rec_id FROM system_temperature JOIN direct ON tab = 'system_temperature' AND row_id = st_id)),
one AS (
  SELECT 'system_temperature' tab, st_id row_id FROM (FROM st1 UNION FROM st2) WHERE st_id NOT IN (SELECT row_id FROM direct WHERE tab = 'system_temperature')
  UNION ALL
  SELECT 'dataset', vis_id FROM dataset WHERE (session, scan, source) IN (SELECT (session, scan, source) FROM observables JOIN direct ON tab = 'observables' AND row_id = obs_id WHERE scan IS NOT NULL AND source IS NOT NULL)),
two AS (
  SELECT 'system_temperature' tab, st_id row_id FROM system_temperature
  WHERE rec_id IN (SELECT rec_id FROM system_temperature JOIN one ON tab = 'system_temperature' AND row_id = st_id)
    AND st_id NOT IN (SELECT row_id FROM direct WHERE tab = 'system_temperature') AND st_id NOT IN (SELECT row_id FROM one WHERE tab = 'system_temperature')),
everything AS (
  SELECT tab, row_id, 'direct' kind, reason, 0 depth FROM direct
  UNION ALL SELECT tab, row_id, 'inherited', 'inherited', 1 FROM one
  UNION ALL SELECT tab, row_id, 'inherited', 'inherited', 2 FROM two)
"""

_SCHEMA = """
WITH refs AS (
  SELECT 'system_temperature' tab, st_id row_id, time t, CAST(antenna_no AS VARCHAR) k, 'a' reg FROM system_temperature WHERE antenna_no >= 1
  UNION ALL SELECT 'gain_curve', gc_id, time, CAST(antenna_no AS VARCHAR), 'a' FROM gain_curve WHERE antenna_no >= 1
  UNION ALL SELECT 'tones', tone_id, time, CAST(antenna_no AS VARCHAR), 'a' FROM tones WHERE antenna_no >= 1
  UNION ALL SELECT 'observables', obs_id, datetime, upper(trim(source)), 's' FROM observables WHERE trim(source) <> ''
  UNION ALL SELECT 'dataset', vis_id, datetime, upper(trim(source)), 's' FROM dataset WHERE trim(source) <> ''
  UNION ALL SELECT 'observables', obs_id, datetime, unnest([a1, a2]), 'n' FROM observables
  UNION ALL SELECT 'dataset', vis_id, datetime, unnest([a1, a2]), 'n' FROM dataset
  UNION ALL SELECT 'system_temperature', st_id, time, session, 'o' FROM system_temperature UNION ALL SELECT 'gain_curve', gc_id, time, session, 'o' FROM gain_curve
  UNION ALL SELECT 'tones', tone_id, time, session, 'o' FROM tones UNION ALL SELECT 'observables', obs_id, datetime, session, 'o' FROM observables
  UNION ALL SELECT 'dataset', vis_id, datetime, session, 'o' FROM dataset),
keys AS (
  SELECT 'a' reg, CAST(antenna_no AS VARCHAR) k, added_at, removed_at FROM antennas
  UNION ALL SELECT 's', upper(trim(name)), added_at, removed_at FROM sources
  UNION ALL SELECT 's', upper(trim(rfc_jname)), added_at, removed_at FROM sources
  UNION ALL SELECT 'n', name, TIMESTAMP '1000-01-01', NULL FROM antennas UNION ALL SELECT 'o', session, TIMESTAMP '1000-01-01', NULL FROM sessions),
judged AS (
  SELECT tab, row_id, reg, refs.k, count(keys.k) n, bool_or(added_at <= t AND (removed_at IS NULL OR t < removed_at)) ok, bool_or(added_at <= t) before
  FROM refs LEFT JOIN keys USING (reg, k) WHERE refs.k IS NOT NULL GROUP BY ALL),
direct AS (
  SELECT tab, row_id, min(CASE WHEN n = 0 THEN 0 WHEN before THEN 1 ELSE 2 END) r FROM judged WHERE n = 0 OR NOT ok GROUP BY ALL),
gone AS (SELECT p.* FROM gain_curve p JOIN direct d ON d.tab = 'gain_curve' AND d.row_id = p.gc_id),
seen AS (SELECT p.* FROM observables p JOIN direct d ON d.tab = 'observables' AND d.row_id = p.obs_id),
reached AS (
  SELECT DISTINCT 'system_temperature' tab, st_id row_id FROM system_temperature JOIN gone USING (session, antenna_no, band)
  UNION ALL SELECT DISTINCT 'tones', tone_id FROM tones JOIN gone USING (session, antenna_no)
  UNION ALL SELECT DISTINCT 'dataset', vis_id FROM dataset JOIN seen USING (session, scan, source))
SELECT tab, row_id, 'direct' AS kind, ['missing', 'deleted', 'later'][r + 1] AS reason, 0 AS depth FROM direct
UNION ALL SELECT tab, row_id, 'inherited', 'inherited', 1 FROM reached ANTI JOIN direct USING (tab, row_id)
"""

ORACLE = {
    "p4_schema": _SCHEMA,
    "p4_found": _FOUND + "SELECT tab, row_id, reason FROM direct",
    "p4_cascade": _ALL + "SELECT tab, row_id, kind, reason, depth FROM everything",
    "p4_report": _ALL
    + """, times AS (
  SELECT 'system_temperature' tab, st_id row_id, time t FROM system_temperature UNION ALL SELECT 'gain_curve', gc_id, time FROM gain_curve
  UNION ALL SELECT 'observables', obs_id, datetime FROM observables UNION ALL SELECT 'dataset', vis_id, datetime FROM dataset)
SELECT tab, strftime(t, '%Y-%m') AS month, kind, reason, count(*) AS n_rows FROM everything JOIN times USING (tab, row_id) GROUP BY ALL""",
}
