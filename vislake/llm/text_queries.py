"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vislake.llm.mixing import mix, shares
from vislake.llm.packing import MOST_SPECS, pack
from vislake.llm.tokens import TOKENIZER, measured
from vislake.session import cut, table


def p7_packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document's place for every container size of pack_specs."""
    specs = table(spark, sf_dir, "pack_specs").where("spec_id IS NOT NULL AND capacity_tokens IS NOT NULL").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    return pack(measured(table(spark, sf_dir, "documents"), tokenizer), {r[0]: r[1] for r in specs})


def p8_mix(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Chosen documents of every mix with their counts."""
    return mix(cut(measured(table(spark, sf_dir, "documents"), tokenizer)), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Shares that the mixes reach."""
    sizes, targets = cut(measured(table(spark, sf_dir, "documents"), tokenizer)), table(spark, sf_dir, "mix_targets")
    return shares(mix(sizes, targets), sizes, targets)


def p7_checks(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """What must hold of every packing, per container size: documents placed or without tokens, and violations found.

    tokens_lost: difference between the tokens of all documents and those placed; overfull: containers beyond capacity;
    overlaps: pieces that do not begin where the one before ends; needless_cuts: pieces of documents that would fit."""
    sizes = cut(measured(table(spark, sf_dir, "documents"), tokenizer))
    specs = {r[0]: r[1] for r in table(spark, sf_dir, "pack_specs").where("spec_id IS NOT NULL AND capacity_tokens IS NOT NULL").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()}
    placed = cut(pack(sizes, specs))
    capacity = F.create_map(*[F.lit(x) for item in specs.items() for x in item])[F.col("spec_id")]
    before = Window.partitionBy("spec_id", "container").orderBy("place")
    ends = F.lag(F.col("place") + F.col("n_tokens"), 1, 0).over(before)
    rows = placed.where(F.col("container").isNotNull()).withColumn("overlap", (F.col("place") != ends).cast("bigint"))
    by_box = rows.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("held"), F.sum("overlap").alias("overlap"))
    boxes = by_box.groupBy("spec_id").agg(F.count_if(F.col("held") > capacity).alias("overfull"), F.sum("overlap").alias("overlaps"))
    docs = placed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("pieces"))
    whole = docs.groupBy("spec_id").agg(F.count("*").alias("n_docs"), F.sum("total").alias("total"), F.sum(F.col("pieces") - F.greatest(F.ceil(F.col("total") / capacity), F.lit(1))).alias("needless_cuts"))
    all_tokens = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return whole.join(boxes, "spec_id").select("spec_id", "n_docs", (F.lit(all_tokens) - F.col("total")).alias("tokens_lost"), "overfull", "overlaps", "needless_cuts")


def p7_fill(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers used for every size, the least number possible, and the share of their room that is filled."""
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    boxes = p7_packed(spark, sf_dir, tokenizer).where(F.col("container").isNotNull()).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("held"))
    used = boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens")).join(specs, "spec_id")
    return used.select("spec_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def p8_checks(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """What must hold of every mix and source: no document twice or more often than its cap, documents of the source only,
    tokens within one document of the budget, and complete epochs before any fraction."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    sizes = cut(measured(documents, tokenizer))
    chosen = cut(mix(sizes, targets))
    report = shares(chosen, sizes, targets)
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"), F.count_if(F.col("n_tokens") > 0).alias("usable"))
    twice = chosen.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("rows")).groupBy("mix_id", "source").agg(F.count_if(F.col("rows") > 1).alias("repeated_rows"))
    spread = chosen.groupBy("mix_id", "source").agg(F.min("times").alias("least_times"), F.count("*").alias("used"))
    rows = report.join(longest, "source", "left").join(twice, ["mix_id", "source"], "left").join(spread, ["mix_id", "source"], "left")
    lowest = F.when(F.col("used") < F.col("usable"), F.lit(0)).otherwise(F.col("least_times"))
    return rows.select(
        "mix_id", "source", F.coalesce("usable", F.lit(0)).alias("usable"), (F.col("most_times") <= F.col("max_repeats")).alias("within_cap"), F.coalesce("repeated_rows", F.lit(0)).alias("repeated_rows"),
        ((F.col("tokens") <= F.col("budget")) & (F.col("budget") - F.col("tokens") <= F.coalesce("longest", F.lit(0)))).alias("within_a_document"), (F.coalesce(F.col("most_times") - lowest, F.lit(0)) <= 1).alias("epochs_first"),
    )


QUERIES = {"p7_packed": p7_packed, "p7_checks": p7_checks, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks}

#: Tokens are not known to SQL: it has the documents and specs, and every violation at 0.
ORACLE = {
    "p7_checks": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS tokens_lost, 0 AS overfull, 0 AS overlaps, 0 AS needless_cuts FROM pack_specs",
    "p8_checks": """
SELECT mix_id, source, count(doc_id) FILTER (text <> '') AS usable, true AS within_cap, 0 AS repeated_rows, true AS within_a_document, true AS epochs_first
FROM mix_targets LEFT JOIN documents USING (source) GROUP BY ALL
""",
}
