"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.llm.residue import find_residue
from vislake.session import table


def p9_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without real content, with the kind of evidence and its share of the residual. The host is the source."""
    return find_residue(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents alone."""
    return p9_judged(spark, sf_dir).select("doc_id").distinct()


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold per source: equal texts are judged alike, and texts without a letter or digit are no cases."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"), F.coalesce(F.regexp_like("text", F.lit("[A-Za-z0-9]")), F.lit(False)).alias("words"))
    found = documents.join(p9_found(spark, sf_dir).withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    texts = found.groupBy("source", "same").agg(F.count("*").alias("n"), F.countDistinct("found").alias("verdicts"), F.max((F.col("found") & ~F.col("words")).cast("int")).alias("empty"))
    return texts.groupBy("source").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"), F.count_if(F.col("verdicts") > 1).alias("split_texts"), F.sum("empty").alias("empty_cases"))


QUERIES = {"p9_found": p9_found, "p9_judged": p9_judged, "p9_checks": p9_checks}
ORACLE = {"p9_checks": "SELECT source, count(*) AS n_docs, count(DISTINCT coalesce(text, '')) AS n_texts, 0 AS split_texts, 0 AS empty_cases FROM documents GROUP BY source"}
