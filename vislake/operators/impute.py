"""Filling missing values from records of the same group or time (problem 2).

The posterior of a missing field comes from a Chow-Liu tree over the categorical and discretised fields; it is then
restricted by a message of what the row's group supports and decoded: a categorical field to its mode, a numeric field to
the median of its best bin. Support is kept as bit sets (numeric bins per group) and as counts per record and category
(antenna numbers), so both are plain hash aggregates with map-side combination, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.operators.chow_liu import Tree, pair_counts
from vislake.operators.tsys import has_antenna, readings, usable
from vislake.session import bounded, stored

#: Bins of a reading (a group's set of occupied bins is one BIGINT, so at most 63).
BINS = 63
#: Stretches of a session for the time field.
SLOTS = 8
#: Categories of registered antenna numbers, by remainder, whatever their count; unregistered numbers share one more.
ANTENNA_GROUPS = 500
#: Categories of bands, by remainder (bands that share one are told apart by their groups' support and level).
BAND_GROUPS = 64
#: Parts of a bin by which its median is found.
FINE = 64

RECORDED, FILLED, ABSENT = "recorded", "filled", "absent"


def _range(values: DataFrame, column: str) -> tuple[float, float]:
    """The 0.1 and 99.9 percentiles over all rows (approximate; two numbers)."""
    got = values.select(F.percentile_approx(column, [0.001, 0.999], 2000).alias("q")).first()["q"]
    return (got[0], got[1]) if got else (0.0, 0.0)


def _binned(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0..bins-1 of equal width between low and high; values outside go to the outer bins, NULL stays NULL."""
    width = (high - low) / bins or 1.0
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1))).cast("int")


def _medians(counts: np.ndarray, low: float, high: float) -> np.ndarray:
    """Median of each bin from counts of its parts (to 1/FINE of a bin; NaN for empty bins)."""
    bins, parts = counts.shape
    at = np.array([np.searchsorted(np.cumsum(c), (c.sum() + 1) // 2) if c.any() else np.nan for c in counts])
    width = (high - low) / bins or 1.0
    return np.exp(low + width * (np.arange(bins) + (at + 0.5) / parts))


def fill_readings(system_temperature: DataFrame, sessions: DataFrame, antennas: DataFrame, bins: int = BINS) -> DataFrame:
    """system_temperature with antenna_no and tsys_1 filled and marked.

    Returned: st_id, session, rec_id, band, t_us, antenna_no, antenna_mark, antenna_probability, tsys_1, tsys_mark,
    tsys_probability. Marks: recorded (the row's own value), filled, absent (nothing in its group to fill it from; the value
    is then NULL). Probabilities are posteriors of filled values, else NULL.

    antenna_no is taken as missing if NULL or below 1. Its posterior comes from the tree over band, stretch of the session
    and bins of both receptors, with the numbers of the record's (rec_id) other rows as the message of one more neighbour,
    which rules all other numbers out; of those left, one found in antennas goes first, then the largest. A NULL rec_id or
    a record without a number gives nothing. tsys_1 is missing if not usable; its posterior comes from the tree over
    antenna_no, band, stretch of the session, bin of tsys_2 and level of the group (session, band, antenna_no recorded or
    filled), with the bins that the group's usable readings occupy as a further message, decoded to the median of the most
    probable bin (bins of equal width in the logarithm). Rows of sessions without a row in sessions are left out. NULL bands form a group of their own.
    Repeated rows are filled alike; an empty table gives an empty result; extra columns are ignored.
    """
    known = antennas.where(F.col("antenna_no").isNotNull()).select(F.col("antenna_no").cast("int").alias("own"), F.lit(True).alias("listed")).distinct()
    code = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col("listed"), (F.pmod(c, F.lit(ANTENNA_GROUPS)) + 1)).otherwise(0)).cast("int")
    rows = readings(system_temperature, sessions, "t0_us", "stop_us")
    slot = F.floor((F.col("t_us") - F.col("t0_us")) * SLOTS / F.greatest(F.col("stop_us") - F.col("t0_us"), F.lit(1)))
    rows = rows.select(
        "st_id", "session", "rec_id", "band", "t_us",
        F.when(has_antenna(F.col("antenna_no")), F.col("antenna_no")).cast("int").alias("own"),
        *[F.when(usable(F.col(c), F.col("ceiling")), F.col(c)).alias(c) for c in ("tsys_1", "tsys_2")],
        F.least(F.greatest(slot, F.lit(0)), F.lit(SLOTS - 1)).cast("int").alias("slot"),
        F.when(F.col("band").isNotNull(), F.pmod("band", F.lit(BAND_GROUPS))).cast("int").alias("band_code"),
    )
    # The one scan of the input; everything below reads columns of this table.
    rows = stored(rows.join(bounded(known), "own", "left").withColumn("ant_code", code("own")))
    low, high = _range(rows.select(F.ln("tsys_1").alias("x")).where("x is not null"), "x")
    rows = rows.withColumn("b1", _binned(F.ln("tsys_1"), low, high, bins)).withColumn("b2", _binned(F.ln("tsys_2"), low, high, bins))

    # Support of the groups, and the tree over the rows with a reading.
    group = ["session", "band", "ant"]
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b1")))
    usable_rows = rows.where(F.col("b1").isNotNull())
    sums = lambda df: df.groupBy(*group).agg(bit.alias("bins"), F.sum(F.ln("tsys_1")).alias("logs"), F.count("*").alias("n"))
    recorded = sums(usable_rows.where(F.col("own").isNotNull()).withColumn("ant", F.col("own")))
    keyed = lambda df: df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], "bins", _binned(F.col("logs") / F.col("n"), low, high, bins).alias("level"), "logs", "n")
    same = F.col("session").eqNullSafe(F.col("g0")) & F.col("band").eqNullSafe(F.col("g1")) & F.col("ant").eqNullSafe(F.col("g2"))
    first = stored(keyed(recorded))
    fields = {"b1": bins, "b2": bins, "level": bins, "ant_code": ANTENNA_GROUPS + 1, "band_code": BAND_GROUPS, "slot": SLOTS}
    learning = usable_rows.withColumn("ant", F.col("own")).withColumn("fine", _binned(F.ln("tsys_1"), low, high, bins * FINE)).join(first.drop("logs", "n"), same, "left")
    counts = pair_counts(learning, fields, {"fine": bins * FINE})
    tree = Tree.of(counts, fields)
    middle = _medians(counts[("fine",)].reshape(bins, FINE), low, high)

    # antenna_no: the record's other rows are one more neighbour of the field in the tree.
    lacking = rows.where(F.col("own").isNull() & F.col("rec_id").isNotNull())
    numbers = (
        rows.where(F.col("own").isNotNull()).select("rec_id", "own", "listed", "ant_code").join(lacking.select("rec_id").distinct(), "rec_id", "left_semi")
        .groupBy("rec_id", "ant_code").agg(F.count("*").alias("n"), F.max(F.struct(F.coalesce("listed", F.lit(False)).alias("listed"), "own")).alias("best"))
        .groupBy("rec_id").agg(F.collect_list(F.struct(F.col("ant_code").alias("code"), "n", F.col("best.listed").alias("listed"), F.col("best.own").alias("own"))).alias("of_record"))  # at most ANTENNA_GROUPS + 1
    )
    kept = ["st_id", "session", "rec_id", "band", "t_us", "own", "b2", "band_code", "slot", "tsys_1", "b1"]
    types = "st_id bigint, session string, rec_id bigint, band int, t_us bigint, own int, b2 int, band_code int, slot int, tsys_1 double, b1 int"
    given = [f for f in fields if f != "b1"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            evidence = {f: batch.column(f).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for f in ("b1", "b2", "band_code", "slot")}
            lists = batch.column("of_record").to_pylist()
            extra = np.zeros((batch.num_rows, fields["ant_code"]))
            for i, held in enumerate(lists):
                for c in held or []:
                    extra[i, c["code"]] = c["n"]
            belief = tree.posterior("ant_code", evidence, extra)
            # What the posterior leaves possible, in the order the problem gives: registered first, then the largest.
            best = [max(((c["listed"], c["own"], c["code"]) for c in held or [] if belief[i, c["code"]] > 0), default=None) for i, held in enumerate(lists)]
            chance = [float(belief[i, b[2]]) if b else None for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([b[1] if b else None for b in best], pa.int32()), pa.array([b[2] if b else None for b in best], pa.int32()), pa.array(chance, pa.float64())], names=[*kept, "ant", "ant_code", "antenna_probability"])

    short = rows.where(F.col("own").isNull()).join(numbers, "rec_id", "left").select(*kept, "of_record").mapInArrow(name, f"{types}, ant int, ant_code int, antenna_probability double")
    short = stored(short)
    full = rows.where(F.col("own").isNotNull()).select(*kept, F.col("own").alias("ant"), "ant_code", F.lit(None).cast("double").alias("antenna_probability"))

    # tsys_1: groups with what rows of a given number add to them.
    added = keyed(sums(short.where(F.col("b1").isNotNull() & F.col("ant").isNotNull())))
    support = first.unionByName(added).groupBy("g0", "g1", "g2").agg(F.bit_or("bins").alias("bins"), _binned(F.sum("logs") / F.sum("n"), low, high, bins).alias("level"))
    last = ["st_id", "session", "rec_id", "band", "t_us", "ant", "own", "antenna_probability"]
    out = "st_id bigint, session string, rec_id bigint, band int, t_us bigint, ant int, own int, antenna_probability double, tsys_1 double, tsys_mark string, tsys_probability double"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            evidence = {f: batch.column(f).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for f in given}
            bits = batch.column("bins").fill_null(0).to_numpy(zero_copy_only=False)
            held = ((bits[:, None] >> np.arange(bins)[None, :]) & 1).astype(float)
            belief = tree.posterior("b1", evidence, held)
            best = belief.argmax(1)
            some = held.any(1)
            value = pa.array(np.where(some, middle[best], np.nan), mask=~some)
            chance = pa.array(belief[np.arange(n), best], mask=~some)
            mark = pa.array(np.where(some, FILLED, ABSENT))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in last], value, mark, chance], names=[*last, "tsys_1", "tsys_mark", "tsys_probability"])

    whole = lambda c: full.where(c).unionByName(short.where(c))
    filled = whole(F.col("b1").isNull()).join(support, same, "left").select(*last, "bins", *given).mapInArrow(decode, out)
    # Rows that need nothing go straight through.
    sound = whole(F.col("b1").isNotNull()).select(*last, "tsys_1", F.lit(RECORDED).alias("tsys_mark"), F.lit(None).cast("double").alias("tsys_probability"))
    antenna_mark = F.when(F.col("own").isNotNull(), RECORDED).when(F.col("ant").isNotNull(), FILLED).otherwise(ABSENT)
    return sound.unionByName(filled).select("st_id", "session", "rec_id", "band", "t_us", F.col("ant").alias("antenna_no"), antenna_mark.alias("antenna_mark"), "antenna_probability", "tsys_1", "tsys_mark", "tsys_probability")
