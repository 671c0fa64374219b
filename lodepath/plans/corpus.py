"""Queries of the statistics and of ingest's relational steps, with equivalent SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import stats
from ..session import table

NOW = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
_jobs = lambda s, d: table(s, d, "jobs")
_A = "is_expired IS NOT TRUE"
_FILLED = "nullif(nullif(CAST({c} AS VARCHAR), ''), '[]')"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The log of loads folded into one row for each key: the last row wins."""
    from ..operators.upsert import last_wins

    return last_wins(_jobs(spark, d).select("requisition_id", "row_id", "load_id", "title", "is_expired"), ["requisition_id"], ["row_id"])


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first loads as the table, the last one as the delta."""
    from ..operators.upsert import last_wins, upsert

    rows = _jobs(spark, d).select("requisition_id", "row_id", "load_id", "title")
    base = last_wins(rows.filter("load_id % 2 = 1"), ["requisition_id"], ["row_id"])
    delta = rows.filter("load_id % 2 = 0")
    return upsert(base, delta, ["requisition_id"], ["row_id"])


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that an incremental run parses: new ones, and those whose time or size differs from the manifest."""
    from ..sources.files import changed

    files = table(spark, d, "raw_files").filter(F.col("file_name").endswith(".json.gz")).select("file_id", "root_dir", "file_name", F.expr("unix_micros(cast(modified_at as timestamp)) * 1000").alias("mtime_ns"), "size_bytes")
    return changed(files, table(spark, d, "manifest")).select("file_id", "root_dir", "file_name")


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """Files, readable ones and errors of each directory, by the strict validator."""
    from ..sources.files import parse_content

    parsed = parse_content(table(spark, d, "raw_files").filter(F.col("file_name").endswith(".json.gz")).select("root_dir", "file_name", "content"), ["root_dir", "file_name"])
    return parsed.groupBy("root_dir").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").startswith("gunzip:")).alias("gunzip_errors"))


def flatten_files(spark: SparkSession, d: str) -> DataFrame:
    """The 33 columns of every valid file, one row for each key, the last file name winning."""
    from ..operators.upsert import last_wins
    from ..sources.files import parse_content

    parsed = parse_content(table(spark, d, "raw_files").filter(F.col("file_name").endswith(".json.gz")).select("file_name", "content"), ["file_name"])
    return last_wins(parsed.filter("error is null").select("file_name", "row.*"), ["requisition_id"], ["file_name"]).drop("file_name")


def hits_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Search hits with a key, the first of each id."""
    hits = table(spark, d, "search_hits").filter("requisition_id is not null")
    first = F.min_by(F.struct("hit_id", "requisition_id", "source", "board_token", "page_no"), F.struct("hit_id"))
    return hits.groupBy("id").agg(first.alias("h")).select("id", "h.*")


def html_texts(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import html_text

    return _jobs(spark, d).select("row_id", html_text("description").alias("text"))


def raw_filenames(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import file_name

    return _jobs(spark, d).select("row_id", file_name("requisition_id").alias("file_name"))


def fill_rates_by_load(spark: SparkSession, d: str) -> DataFrame:
    """The share of filled salaries in each load and its rank among loads."""
    each = _jobs(spark, d).groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.count(expr.filled(F.col("seniority_level"))).alias("filled"))
    return each.withColumn("place", F.rank().over(Window.orderBy(F.col("filled").desc(), F.col("load_id"))))


QUERIES = {
    "overview_jobs": lambda s, d: stats.overview(_jobs(s, d)),
    "fill_rates_jobs": lambda s, d: _rounded(stats.fill_rates(_jobs(s, d))),
    "breakdown_seniority": lambda s, d: stats.breakdown(_jobs(s, d), "seniority_level"),
    "breakdown_min_compensation": lambda s, d: stats.breakdown(_jobs(s, d), "yearly_min_compensation", 20),
    "breakdown_total_seniority": lambda s, d: stats.breakdown_total(_jobs(s, d), "seniority_level"),
    "technical_tools": lambda s, d: stats.multi_breakdown(_jobs(s, d), "technical_tools"),
    "workplace_countries": lambda s, d: stats.multi_breakdown(_jobs(s, d), "workplace_countries", 15),
    "breakdown_company_all": lambda s, d: stats.breakdown(_jobs(s, d), "company_name", 40, include_expired=True),
    "technical_tools_totals": lambda s, d: stats.multi_breakdown_totals(_jobs(s, d), "technical_tools"),
    "compensation_by_currency": lambda s, d: _rounded(stats.compensation(_jobs(s, d))),
    "compensation_coverage": lambda s, d: stats.compensation_coverage(_jobs(s, d)),
    "recency_months": lambda s, d: stats.recency(_jobs(s, d), 24, now=NOW),
    "recency_totals": lambda s, d: stats.recency_totals(_jobs(s, d)),
    "search_page": lambda s, d: stats.search(_jobs(s, d), "manager", 50, 20),
    "search_literal_percent": lambda s, d: stats.search_total(_jobs(s, d), "%"),
    "search_description_total": lambda s, d: stats.search_total(_jobs(s, d), "kubernetes", include_description=True, include_expired=True),
    "upsert_last_wins": upsert_last_wins,
    "upsert_merge": upsert_merge,
    "changed_files": changed_files,
    "ingest_counters": ingest_counters,
    "flatten_files": flatten_files,
    "hits_deduplicated": hits_deduplicated,
    "html_texts": html_texts,
    "raw_filenames": raw_filenames,
    "fill_rates_by_load": fill_rates_by_load,
}
_PAY = "SELECT nullif(trim(listed_compensation_currency), '') AS currency, CASE WHEN yearly_min_compensation > 0 THEN yearly_min_compensation END AS lo, CASE WHEN yearly_max_compensation > 0 THEN yearly_max_compensation END AS hi FROM jobs WHERE " + _A
_MONTH = f"SELECT strftime(date_trunc('month', try_cast(estimated_publish_date AS TIMESTAMPTZ) AT TIME ZONE 'UTC'), '%Y-%m') AS month FROM jobs WHERE {_A}"
_FIND = "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{{q}}')" for c in ("title", "company_name", "formatted_workplace_location")) + ")"
ORACLE = {
    "overview_jobs": f"""SELECT count(*) AS total_rows, count(*) FILTER ({_A}) AS active_rows, count(*) FILTER (NOT ({_A})) AS expired_rows,
        count(DISTINCT nullif(trim(company_name), '')) FILTER ({_A}) AS active_companies, count(DISTINCT nullif(trim(source), '')) FILTER ({_A}) AS active_sources,
        strftime(min(try_cast(estimated_publish_date AS TIMESTAMP)) FILTER ({_A}), '%Y-%m-%d') AS earliest_active, strftime(max(try_cast(estimated_publish_date AS TIMESTAMP)) FILTER ({_A}), '%Y-%m-%d') AS latest_active FROM jobs""",
    "fill_rates_jobs": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({_FILLED.format(c=c)}) AS filled, count(*) AS total, round(100.0 * count({_FILLED.format(c=c)}) / count(*), 2)::DOUBLE AS pct FROM jobs WHERE {_A}" for c in stats.FILL_COLUMNS
    ),
    "breakdown_seniority": f"SELECT {_FILLED.format(c='seniority_level')} AS label, count(*) AS n FROM jobs WHERE {_A} AND {_FILLED.format(c='seniority_level')} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 15",
    "breakdown_min_compensation": f"SELECT {_FILLED.format(c='yearly_min_compensation')} AS label, count(*) AS n FROM jobs WHERE {_A} AND {_FILLED.format(c='yearly_min_compensation')} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 20",
    "breakdown_total_seniority": f"SELECT count({_FILLED.format(c='seniority_level')}) AS total FROM jobs WHERE {_A}",
    "technical_tools": f"SELECT u.value AS label, count(*) AS n FROM jobs, unnest(from_json(nullif(coalesce(technical_tools, '[]'), ''), '[\"VARCHAR\"]')) AS u(value) WHERE {_A} GROUP BY 1 ORDER BY n DESC, label LIMIT 25",
    "workplace_countries": f"SELECT u.value AS label, count(*) AS n FROM (SELECT * FROM jobs WHERE json_valid(workplace_countries) AND workplace_countries NOT LIKE '%,]%' AND json_type(workplace_countries::JSON) = 'ARRAY'), unnest(from_json(workplace_countries, '[\"VARCHAR\"]')) AS u(value) WHERE {_A} GROUP BY 1 ORDER BY n DESC, label NULLS LAST LIMIT 15",
    "breakdown_company_all": "SELECT nullif(nullif(company_name, ''), '[]') AS label, count(*) AS n FROM jobs WHERE nullif(nullif(company_name, ''), '[]') IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 40",
    "technical_tools_totals": f"SELECT count(*) AS mentions, count(DISTINCT requisition_id) AS jobs_with_value FROM jobs, unnest(from_json(nullif(coalesce(technical_tools, '[]'), ''), '[\"VARCHAR\"]')) AS u(value) WHERE {_A}",
    "compensation_by_currency": "SELECT currency, count(*) AS jobs, count(lo) AS min_jobs, "
    + ", ".join(f"round(quantile_cont(lo, {q}), 2) AS min_{n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
    + ", count(hi) AS max_jobs, "
    + ", ".join(f"round(quantile_cont(hi, {q}), 2) AS max_{n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
    + f" FROM ({_PAY}) WHERE currency IS NOT NULL AND (lo IS NOT NULL OR hi IS NOT NULL) GROUP BY 1",
    "compensation_coverage": f"SELECT count(*) FILTER (lo IS NOT NULL OR hi IS NOT NULL) AS jobs_with_compensation, count(*) AS active_jobs FROM ({_PAY})",
    "recency_months": f"WITH c AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(TIMESTAMP '2024-06-01', TIMESTAMP '2026-05-01', INTERVAL 1 MONTH) AS g(m)), n AS (SELECT month, count(*) AS n FROM ({_MONTH}) GROUP BY 1) SELECT c.month, coalesce(n.n, 0) AS n FROM c LEFT JOIN n USING (month)",
    "recency_totals": f"SELECT count(*) AS total, count(month) AS dated FROM ({_MONTH})",
    "search_page": f"SELECT {', '.join(stats.PAGE_COLUMNS)} FROM jobs WHERE {_A} AND {_FIND.format(q='manager')} ORDER BY try_cast(estimated_publish_date AS TIMESTAMP) DESC NULLS LAST, requisition_id LIMIT 50 OFFSET 20",
    "search_literal_percent": f"SELECT count(*) AS total FROM jobs WHERE {_A} AND {_FIND.format(q='%')}",
    "search_description_total": "SELECT count(*) AS total FROM jobs WHERE " + _FIND.format(q="kubernetes")[:-1] + " OR contains(lower(coalesce(description, '')), 'kubernetes'))",
    "upsert_last_wins": "SELECT requisition_id, row_id, load_id, title, is_expired FROM jobs QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1",
    "upsert_merge": "WITH b AS (SELECT requisition_id, row_id, load_id, title FROM jobs WHERE load_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1), e AS (SELECT requisition_id, row_id, load_id, title FROM jobs WHERE load_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1) SELECT * FROM e UNION ALL SELECT * FROM b WHERE requisition_id NOT IN (SELECT requisition_id FROM e)",
    "changed_files": "SELECT f.file_id, f.root_dir, f.file_name FROM (SELECT *, epoch_us(modified_at) * 1000 AS t FROM raw_files WHERE file_name LIKE '%.json.gz') f LEFT JOIN manifest m ON f.root_dir = m.root_dir AND f.file_name = m.file_name WHERE m.file_name IS NULL OR m.mtime_ns IS DISTINCT FROM f.t OR m.size_bytes IS DISTINCT FROM f.size_bytes",
    "hits_deduplicated": "SELECT id, hit_id, requisition_id, source, board_token, page_no FROM search_hits WHERE requisition_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY hit_id) = 1",
    "fill_rates_by_load": f"SELECT load_id, count(*) AS n, count({_FILLED.format(c='seniority_level')}) AS filled, rank() OVER (ORDER BY count({_FILLED.format(c='seniority_level')}) DESC, load_id) AS place FROM jobs GROUP BY 1",
}
