"""Queries of the problems about training text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, small_join, table
from . import canonical, leakage, neardup, packing, residue, sql


def _postings(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    text = F.concat_ws(" ", "title", F.coalesce("company_name", F.lit("")), "description")
    return neardup.near_duplicates(table(spark, d, "jobs"), "row_id", text, k=3, threshold=0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).pairs().select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each row's class of equal texts, its group of near duplicates and how many near duplicates it has."""
    return _postings(spark, d).groups().withColumnRenamed("id", "row_id")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return materialise(canonical.map_values(table(spark, d, "jobs"), "job_title_raw", table(spark, d, "core_titles"), "title_id", "core_job_title", "known_aliases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("row_id", F.col("job_title_raw").alias("value"))
    return small_join(jobs, _mapped(spark, d), ["value"], "left").select("row_id", F.coalesce("entry", F.lit(0).cast("long")).alias("title_id"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry and how many rows hold them."""
    counts = table(spark, d, "jobs").groupBy(F.col("job_title_raw").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(_mapped(spark, d).filter("entry is null").hint("merge"), "value").select("value", "n_rows")


#: Tokens in a container.
CAPACITY = 4096


def _byte_tokens(c: str):
    """Tokens of the byte-level tokenizer: one for each UTF-8 byte and one that ends the text; null counts as empty."""
    return F.coalesce(F.octet_length(c), F.lit(0)) + 1


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", _byte_tokens("text"), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter("piece > 0").select(F.col("id").alias("doc_id")).distinct()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container and position of each piece of each document."""
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each document the pieces and tokens that were packed, and how many pieces overlap another one or reach beyond their container: none may."""
    packed = _packed(spark, d).filter("size > 0").select("id", "size", "container", "offset", (F.col("offset") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("container").orderBy("offset", "id", "end").rowsBetween(Window.unboundedPreceding, -1))
    placed = packed.withColumn("over", F.coalesce(before > F.col("offset"), F.lit(False)))
    count = lambda c: F.count_if(c).alias
    return placed.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("n_tokens"), count(F.col("over"))("n_overlapping"), count((F.col("end") > CAPACITY) | (F.col("offset") < 0))("n_outside")
    )


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return packing.containers(_packed(spark, d), CAPACITY)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The words to remove from each document, and the item that they belong to."""
    return _leaks(spark, d).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """What was found in each document, by kind, and its share of the text."""
    found = residue.find_residue(table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.array_join("kinds", ",").alias("kinds"), F.array_join("passages", "\n").alias("passages"), "coverage")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without those found."""
    docs = table(spark, d, "documents")
    return docs.join(p9_found(spark, d), "doc_id", "left_anti")


QUERIES = {
    "p2_found": p2_found, "p2_groups": p2_groups,
    "p3_found": p3_found, "p3_unmatched": p3_unmatched,
    "p7_found": p7_found, "p7_packing": p7_packing, "p7_invariants": p7_invariants, "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_spans": p8_spans,
    "p9_found": p9_found, "p9_passages": p9_passages, "p9_clean": p9_clean,
}
ORACLE = {
    "p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) + 1 > {CAPACITY}",
    "p7_invariants": f"SELECT doc_id, CAST(ceil((coalesce(strlen(text), 0) + 1) / {CAPACITY}.0) AS BIGINT) AS n_pieces, coalesce(strlen(text), 0) + 1 AS n_tokens, 0::BIGINT AS n_overlapping, 0::BIGINT AS n_outside FROM documents",
} | sql.ORACLE
