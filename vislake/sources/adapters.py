"""A long visibility table built from the order tables, for queries over channels and receptor pairs.

One text serves both engines but for the difference of two dates. 8 antennas, 7 channels in two frequency windows, two
receptor slots; rows of returned items carry weight 0 (flagged).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vislake.session import table

#: Lowest channel, channel width and distance of the two frequency windows in Hz.
NU0, DNU, IF_STEP = 8.4e9, 4e6, 1e8

_VIS = """
SELECT row_id, least(p0, q0) AS p, greatest(p0, q0) AS q, source, scan, t, chan, CASE WHEN chan > 4 THEN 2 ELSE 1 END AS if_id,
       {nu0} + (chan - 1) * {dnu} + CASE WHEN chan > 4 THEN {step} ELSE 0e0 END AS nu, i, j, u, v, w,
       amp * cos(ph) AS re, (CASE WHEN p0 < q0 THEN 1e0 ELSE -1e0 END) * amp * sin(ph) AS im
FROM (SELECT l_orderkey AS row_id, CAST(1 + l_suppkey % 8 AS INT) AS p0, CAST(1 + (l_suppkey % 8 + 1 + l_partkey % 7) % 8 AS INT) AS q0,
             CAST(1 + o_custkey % 10 AS INT) AS source, year(l_shipdate) * 12 + month(l_shipdate) AS scan,
             CAST({days} AS DOUBLE) * 864e2 AS t, l_linenumber AS chan, CAST(1 + l_orderkey % 2 AS INT) AS i, CAST(1 + l_partkey % 2 AS INT) AS j,
             CAST(l_partkey % 2000 - 1000 AS DOUBLE) * 1e3 AS u, CAST(l_orderkey % 2000 - 1000 AS DOUBLE) * 1e3 AS v,
             CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE l_quantity END AS w, l_extendedprice / 1e4 AS amp, 6.283185307179586e0 * (l_discount * 1e1 + l_tax) AS ph
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) AS x
"""


def vis_sql(lineitem: str, orders: str, days: str) -> str:
    """The text for one engine."""
    return _VIS.format(nu0=f"{NU0:.0f}e0", dnu=f"{DNU:.0f}e0", step=f"{IF_STEP:.0f}e0", lineitem=lineitem, orders=orders, days=days)


#: For DuckDB, as a common table expression named vis.
VIS_CTE = "vis AS (" + vis_sql("lineitem", "orders", "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))") + ")"


def vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long visibilities: row_id, p, q, source, scan, t, chan, if_id, nu, i, j, u, v, w, re, im."""
    text = vis_sql("{lineitem}", "{orders}", "datediff(l_shipdate, timestamp'1995-01-01')")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def channels(spark: SparkSession) -> DataFrame:
    """(chan, nu, if_id) of the seven channels."""
    rows = [(c, NU0 + (c - 1) * DNU + (IF_STEP if c > 4 else 0.0), 1 + (c - 1) // 4) for c in range(1, 8)]
    return spark.createDataFrame(rows, "chan int, nu double, if_id int")


#: The same channels for DuckDB.
CHANNELS_CTE = f"channels AS (SELECT CAST(c AS INT) chan, {NU0} + (c - 1) * {DNU} + CASE WHEN c > 4 THEN {IF_STEP} ELSE 0 END nu, CAST(1 + (c - 1) // 4 AS INT) if_id FROM range(1, 8) r(c))"
