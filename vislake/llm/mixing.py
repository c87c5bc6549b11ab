"""Mixing sources to target shares (problem 8).

Complete epochs come first: a source whose budget is k times its size or more gives every document k times. The rest of
the budget is drawn by weighted sampling without replacement with exponential keys -ln(u) / weight (the smallest keys
win), u being a hash of document, mix and seed. Keys are cut into ranges on a logarithmic scale; their token sums decide
which ranges are in or out as a whole. The one range per source in which the budget ends is cut into parts in the same
way, and only the part in which it ends is sorted by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vislake.session import bounded

#: Ranges of keys per power of two, and parts of the one range in which a budget ends.
PER_OCTAVE = 64
PARTS = 4096


def quotas(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: share, cap, size, budget in tokens, complete epochs and the rest to be drawn.

    Without total_tokens a mix gets the largest size at which every source that has tokens reaches its share within its
    cap. A source without tokens has budget 0; a budget above the cap becomes the cap. Sources of several rows add up.
    """
    wanted = targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count_if(F.col("n_tokens") > 0).alias("n_docs"))
    each = wanted.join(have, "source", "left").fillna(0, ["size", "n_docs"])
    most = F.col("size") * F.col("max_repeats")
    own_total = F.min(F.when((F.col("size") > 0) & (F.col("target_share") > 0), most / F.col("target_share"))).over(Window.partitionBy("mix_id"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.coalesce(own_total, F.lit(0.0))
    # A relative 1e-12 against the last bit of the division above.
    each = each.withColumn("budget", F.least(F.floor(F.greatest(total * F.col("target_share"), F.lit(0.0)) * (1 + 1e-12)).cast("bigint"), most))
    epochs = F.when(F.col("size") > 0, F.floor(F.try_divide(F.col("budget"), F.col("size")))).otherwise(0).cast("bigint")
    return each.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("size") > 0, F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, times): documents of each mix and how often each is used (at least once).

    sizes: doc_id, source, n_tokens, weight. A document is drawn for the rest of its source's budget if all documents
    with smaller keys and itself fit; ties of keys go by doc_id. Documents without tokens, with a NULL source or of
    sources in no mix are not used. Weights that are NULL, NaN or not above 0 count as 1e-6. Empty tables: no rows.
    """
    plan = quotas(sizes, targets, total_tokens).select("mix_id", "source", "epochs", "rest")
    u = (F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.when(F.coalesce(~F.isnan("weight") & (F.col("weight") > 0), F.lit(False)), F.col("weight")).otherwise(1e-6)
    # Position of the key on a logarithmic scale: ranges are as fine for weights of 1e-6 as for weights of 1.
    rows = sizes.where(F.col("n_tokens") > 0).join(bounded(plan), "source").withColumn("key", -F.ln(u) / weight).withColumn("place", F.log2("key") * PER_OCTAVE)
    rows = rows.select("mix_id", "source", "doc_id", "n_tokens", "epochs", "rest", "key", "place", F.floor("place").alias("range"), F.lit(0).cast("bigint").alias("start"))
    kept = ["mix_id", "source", "doc_id", "n_tokens"]
    sure, edge = _split(rows, "range")
    # The one range in which the budget ends is split again, and only a part of a part is sorted by row.
    finer, edge = _split(edge.withColumn("part", F.floor((F.col("place") - F.col("range")) * PARTS)), "part")
    by_key = Window.partitionBy("mix_id", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = edge.withColumn("upto", F.col("start") + F.sum("n_tokens").over(by_key)).withColumn("drawn", (F.col("upto") <= F.col("rest")).cast("int"))
    whole = sure.select(*kept, "epochs", "drawn").unionByName(finer.select(*kept, "epochs", "drawn")).unionByName(last.select(*kept, "epochs", "drawn"))
    return whole.select(*kept, (F.col("epochs") + F.col("drawn")).alias("times")).where(F.col("times") > 0)


def _split(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ranges that are drawn or left as a whole (drawn: 1 or 0), and the rows of the range in which the rest ends.

    start: tokens of the source before all rows given here; in the second result, before the rows of their range. There are
    no more ranges than the scale has, whatever the number of rows.
    """
    order = Window.partitionBy("mix_id", "source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("mix_id", "source", by).agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    placed = rows.join(bounded(sums), ["mix_id", "source", by]).withColumn("before", F.col("start") + F.col("before"))
    within, out = F.col("before") + F.col("held") <= F.col("rest"), F.col("before") >= F.col("rest")
    sure = placed.where(within | out).withColumn("drawn", (within & ~out).cast("int"))
    return sure, placed.where(~within & ~out).withColumn("start", F.col("before")).drop("held", "before")


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, target_share, reached_share, budget, tokens, n_docs, most_times, max_repeats) of what was chosen."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("n_docs"), F.max("times").alias("most_times"))
    plan = quotas(sizes, targets, total_tokens).select("mix_id", "source", "target_share", "budget", "max_repeats")
    both = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "n_docs", "most_times"])
    return both.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0)))
