"""Queries of the general problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, drift, profiling, shredding
from ..session import materialise, shared_folder, table
from . import problem_sql

BLOBS = problem_sql.BLOBS


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = shredding.found_objects(table(spark, d, "jobs"), "row_id", BLOBS)
    return found.select(F.col("id").alias("row_id"), "blob", "path")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every level of the three blobs as flat rows that name their parents."""
    tables = shredding.flat_tables(table(spark, d, "jobs"), "row_id", BLOBS)
    return tables.select(F.col("id").alias("row_id"), "blob", "level", "path", "parent_path", F.to_json("fields").alias("fields"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all levels and their parents, without their fields."""
    tables = shredding.flat_tables(table(spark, d, "jobs"), "row_id", BLOBS)
    return tables.select(F.col("id").alias("row_id"), "blob", "level", "path", "parent_path")


FIELD_PARENTS = ["job_information", "v5_processed_job_data"]
FIELD_TYPES = {
    "id": "string", "source": "string", "requisition_id": "string", "is_expired": "boolean", "board_token": "string",
    "job_information.title": "string", "job_information.job_title_raw": "string", "job_information.viewedByUsers": "string",
    "v5_processed_job_data.core_job_title": "string", "v5_processed_job_data.yearly_min_compensation": "double", "v5_processed_job_data.seniority_level": "string",
}
BIN_BYTES = 8 << 20


def _fields(spark: SparkSession, d: str, values: bool = False) -> DataFrame:
    return materialise(drift.load_fields(table(spark, d, "feed_records"), "record_id", "feed_id", "drop_no", "record_json", FIELD_PARENTS, values=values))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_fields(spark, d)).withColumnsRenamed({"feed": "feed_id", "drop": "drop_no"})


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one typed table, renamed fields under one name, with the casts that failed."""
    fields = _fields(spark, d, values=True)
    out = drift.consistent(fields, drift.unified_names(drift.changes(fields)), FIELD_TYPES)
    return out.withColumnsRenamed({"row": "record_id", "feed": "feed_id", "drop": "drop_no"}).withColumns({"other_fields": F.to_json("other_fields"), "failed_casts": F.to_json("failed_casts")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.redundant(materialise(compaction.digests(table(spark, d, "raw_files"))))


def p5_bins(spark: SparkSession, d: str) -> DataFrame:
    """The bin of each file that is kept."""
    files = table(spark, d, "raw_files")
    digested = materialise(compaction.digests(files))
    kept = files.select("file_id", "size_bytes").join(compaction.redundant(digested), "file_id", "left_anti")
    return compaction.plan_bins(kept, BIN_BYTES)


def p5_compact(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites all of raw_files into the shared folder and reads each bin of the committed version: rows, bytes and checksum."""
    out = shared_folder(spark, "compact")
    record = compaction.compact(table(spark, d, "raw_files"), out, BIN_BYTES)
    return compaction.written_bins(spark, out, record["version"])


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return profiling.with_validity(table(spark, d, "jobs"), table(spark, d, "country_codes"), "row_id", "load_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    checked = _checked(spark, d)
    moved = profiling.changed_loads(checked, table(spark, d, "ingest_runs").select("root_dir", "load_id"), "root_dir", "load_id")
    values = profiling.offending(checked, "row_id", "load_id")
    return values.unionByName(moved.select("load_id", F.lit(0).cast("long").alias("row_id"), "column_name")).distinct()


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls, distincts, range and most frequent value of each column in each load."""
    jobs = table(spark, d, "jobs")
    return profiling.profile(jobs, ["load_id"], [c for c in jobs.columns if c != "load_id"], profiling.numeric_columns(jobs))


def p6_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square, population stability index and half the sum of share differences between consecutive loads, of every column; numeric ones by tenths of the previous load."""
    jobs = table(spark, d, "jobs")
    columns = [c for c in jobs.columns if c != "load_id"]
    out = profiling.shifts(jobs, table(spark, d, "ingest_runs").select("root_dir", "load_id"), "root_dir", "load_id", columns, profiling.numeric_columns(jobs))
    return out.withColumns({c: F.round(c, 6) for c in ("half_abs", "chi_square", "psi")})


QUERIES = {
    "p1_found": p1_found, "p1_tables": p1_tables, "p1_links": p1_links,
    "p4_found": p4_found, "p4_table": p4_table,
    "p5_found": p5_found, "p5_bins": p5_bins, "p5_compact": p5_compact,
    "p6_found": p6_found, "p6_profile": p6_profile, "p6_shifts": p6_shifts,
}
_GOOD_PLACES = """regexp_full_match(workplace_countries, '[ \\t\\n\\r]*\\[[ \\t\\n\\r]*("([^"\\\\]|\\\\.)*"[ \\t\\n\\r]*(,[ \\t\\n\\r]*"([^"\\\\]|\\\\.)*"[ \\t\\n\\r]*)*)?\\][ \\t\\n\\r]*')"""
_LEVELS = ", ".join(f"'{x}'" for x in profiling.LEVELS)
ORACLE = {
    "p6_found": f"""
WITH j AS (
    SELECT load_id, row_id, yearly_min_compensation AS pay, yearly_max_compensation AS high, seniority_level AS level, workplace_countries AS place,
           CASE WHEN {_GOOD_PLACES} THEN from_json(workplace_countries, '["VARCHAR"]') END AS codes FROM jobs
), v AS (
    SELECT load_id, row_id, 'yearly_min_compensation' AS c, pay IS NULL AS missing, coalesce(NOT isnan(pay) AND pay BETWEEN 1000 AND 2000000 AND (high IS NULL OR isnan(high) OR pay <= high), false) AS good, pay AS num, NULL AS lab FROM j
    UNION ALL SELECT load_id, row_id, 'seniority_level', level IS NULL, coalesce(level IN ({_LEVELS}), false), NULL, level FROM j
    UNION ALL SELECT load_id, row_id, 'workplace_countries', place IS NULL, coalesce(len(list_distinct(codes)) = len(codes) AND list_has_all((SELECT list(country_code) FROM country_codes), codes), false), NULL, codes[1] FROM j
), pairs AS (
    SELECT load_id, lag(load_id) OVER (PARTITION BY root_dir ORDER BY load_id) AS prev FROM ingest_runs WHERE load_id IN (SELECT load_id FROM jobs)
), s AS (
    SELECT load_id, c, avg(missing::INT) AS nulls, median(num) FILTER (good) AS med FROM v GROUP BY 1, 2
), n AS (
    SELECT load_id, c, lab, count(*)::DOUBLE AS n FROM v WHERE good AND lab IS NOT NULL GROUP BY 1, 2, 3
), p AS (SELECT load_id, c, lab, n / sum(n) OVER (PARTITION BY load_id, c) AS p FROM n
), moved AS (
    SELECT d.load_id, d.c, sum(abs(d.p)) / 2 AS half FROM (
        SELECT load_id, c, lab, sum(p) AS p FROM (
            SELECT pairs.load_id, c, lab, p FROM pairs JOIN p USING (load_id) WHERE prev IS NOT NULL UNION ALL SELECT pairs.load_id, c, lab, -p FROM pairs JOIN p ON p.load_id = prev
        ) GROUP BY 1, 2, 3
    ) d JOIN pairs USING (load_id) WHERE EXISTS (SELECT 1 FROM p WHERE p.load_id = d.load_id AND p.c = d.c) AND EXISTS (SELECT 1 FROM p WHERE p.load_id = prev AND p.c = d.c) GROUP BY 1, 2
)
SELECT load_id, row_id, c AS column_name FROM v WHERE NOT missing AND NOT good
UNION
SELECT a.load_id, 0, a.c FROM pairs JOIN s a USING (load_id) JOIN s b ON b.load_id = prev AND b.c = a.c
WHERE abs(a.nulls - b.nulls) >= 0.2 - 1e-12 OR greatest(a.med, b.med) >= 1.4 * least(a.med, b.med) - 1e-12
UNION SELECT load_id, 0, c FROM moved WHERE half >= 0.25 - 1e-12""",
} | problem_sql.ORACLE
