"""Statistics of the flat table. Each is one DataFrame; thin adaptors collect the few rows of a result.

Expired rows are left out unless asked for; a null is_expired counts as active. Every plan reads only the
columns that it names, and what is collected is bounded by the arguments, not by the data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatsUnavailable
from ..functions import expr
from ..schema import FILL_COLUMNS, JOBS, KEY, PAGE_COLUMNS, SEARCH_COLUMNS, check_column
from .profiling import quantiles

PAGE_SIZE = 200


def _positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive, got {value}")
    return value


def _not_negative(name: str, value: int) -> int:
    if value < 0:
        raise ValueError(f"{name} must not be negative, got {value}")
    return value


def _rows(jobs: DataFrame, include_expired: bool) -> DataFrame:
    return jobs if include_expired else jobs.filter(expr.active())


def _kind(jobs: DataFrame, column: str) -> str:
    return dict(jobs.dtypes)[column]


# --- DataFrames ----------------------------------------------------------------------------


def overview(jobs: DataFrame) -> DataFrame:
    """One row: total, active and expired rows, distinct companies and sources and the date range of active ones."""
    on = expr.active()
    when = lambda c: F.when(on, c)
    date = expr.wall_clock(F.col("estimated_publish_date"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(on).alias("active_rows"),
        F.count_if(~on).alias("expired_rows"),
        F.count_distinct(when(expr.label(F.col("company_name")))).alias("active_companies"),
        F.count_distinct(when(expr.label(F.col("source")))).alias("active_sources"),
        day(F.min(when(date))).alias("earliest_active"),
        day(F.max(when(date))).alias("latest_active"),
    )


def fill_rates(jobs: DataFrame, columns: list[str] | None = None, include_expired: bool = False) -> DataFrame:
    """(column_name, filled, total, pct) in the order asked, from one pass; pct is 0 if there are no rows."""
    names = [check_column(c) for c in (FILL_COLUMNS if columns is None else columns)]
    if not names:
        return jobs.sparkSession.createDataFrame([], "column_name string, filled bigint, total bigint, pct double")
    counted = _rows(jobs, include_expired).agg(F.count(F.lit(1)).alias("total"), *[F.count(expr.filled(F.col(c), _kind(jobs, c))).alias(f"_{i}") for i, c in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(names)]))
    pct = F.when(F.col("total") > 0, 100.0 * F.col("filled") / F.col("total")).otherwise(F.lit(0.0))
    return counted.select(each.alias("e"), "total").orderBy("e.i").select("e.column_name", "e.filled", "total", pct.alias("pct"))


def _top(values: DataFrame, limit: int) -> DataFrame:
    """(label, n) of the most frequent labels; ties by label, bytewise, null last."""
    return values.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("label").asc_nulls_last()).limit(_positive("limit", limit))


def breakdown(jobs: DataFrame, column: str, limit: int = 15, include_expired: bool = False) -> DataFrame:
    """(label, n) of the most frequent filled values of a column."""
    value = expr.filled(F.col(check_column(column)), _kind(jobs, column))
    return _top(_rows(jobs, include_expired).select(value.alias("label")).filter("label is not null"), limit)


def breakdown_total(jobs: DataFrame, column: str, include_expired: bool = False) -> DataFrame:
    return _rows(jobs, include_expired).agg(F.count(expr.filled(F.col(check_column(column)), _kind(jobs, column))).alias("total"))


def _mentioned(jobs: DataFrame, column: str, include_expired: bool) -> DataFrame:
    return _rows(jobs, include_expired).select(KEY, F.explode(expr.mentions(F.col(check_column(column)))).alias("label"))


def multi_breakdown(jobs: DataFrame, column: str, limit: int = 25, include_expired: bool = False) -> DataFrame:
    """(label, n) of the most frequent elements of a JSON array column; a null element is a label of its own."""
    return _top(_mentioned(jobs, column, include_expired), limit)


def multi_breakdown_totals(jobs: DataFrame, column: str, include_expired: bool = False) -> DataFrame:
    """(mentions, jobs_with_value) of a JSON array column."""
    return _mentioned(jobs, column, include_expired).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(KEY).alias("jobs_with_value"))


def compensation(jobs: DataFrame, include_expired: bool = False) -> DataFrame:
    """Per listed currency: rows and exact quartiles of each bound, by rows and currency; bounds of 0 or less count as absent.

    Quartiles come from counts of values, so that a currency of most rows moves one row for each of its values and task.
    """
    low, high = (F.when(F.col(c) > 0, F.col(c)) for c in ("yearly_min_compensation", "yearly_max_compensation"))
    paid = _rows(jobs, include_expired).select(expr.label(F.col("listed_compensation_currency")).alias("currency"), low.alias("lo"), high.alias("hi"))
    pairs = paid.filter("currency is not null and (lo is not null or hi is not null)").groupBy("currency", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.lit("min").alias("side"), F.col("lo").alias("pay")), F.struct(F.lit("max").alias("side"), F.col("hi").alias("pay"))))
    values = pairs.select("currency", "n", sides.alias("s")).filter("s.pay is not null").groupBy("currency", "s.side", "s.pay").agg(F.sum("n").alias("n"))
    quarters = quantiles(values, ["currency", "side"], "pay", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    both = pairs.groupBy("currency").agg(F.sum("n").alias("jobs"), *[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0)).alias(name) for c, name in (("lo", "min_jobs"), ("hi", "max_jobs"))])
    for side in ("min", "max"):
        own = quarters.filter(F.col("side") == side).select("currency", *[F.col(q).alias(f"{side}_{q}") for q in ("p25", "median", "p75")])
        both = both.join(own, "currency", "left")
    named = lambda side: [f"{side}_{q}" for q in ("p25", "median", "p75")]
    return both.select("currency", "jobs", "min_jobs", *named("min"), "max_jobs", *named("max")).orderBy(F.col("jobs").desc(), "currency")


def compensation_coverage(jobs: DataFrame, include_expired: bool = False) -> DataFrame:
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return _rows(jobs, include_expired).agg(F.count_if(positive("yearly_min_compensation") | positive("yearly_max_compensation")).alias("jobs_with_compensation"), F.count(F.lit(1)).alias("active_jobs"))


def month_labels(months: int, now: dt.datetime) -> list[str]:
    """The months up to that of now, oldest first."""
    last = now.year * 12 + now.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(last - _positive("months", months) + 1, last + 1)]


def _months(jobs: DataFrame, include_expired: bool) -> DataFrame:
    published = expr.instant(F.col("estimated_publish_date"))
    return _rows(jobs, include_expired).select(F.date_format(F.date_trunc("month", published), "yyyy-MM").alias("month"))


def recency(jobs: DataFrame, months: int = 24, include_expired: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """(month, n) of a window without gaps that ends in the current month, UTC; months without rows count 0."""
    labels = month_labels(months, now or dt.datetime.now(dt.timezone.utc))
    spark = jobs.sparkSession
    calendar = spark.createDataFrame([(m,) for m in labels], "month string")
    counted = _months(jobs, include_expired).filter(F.col("month").isin(labels) if months <= 240 else F.col("month").between(labels[0], labels[-1])).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("month")


def recency_totals(jobs: DataFrame, include_expired: bool = False) -> DataFrame:
    """(total, dated)."""
    return _months(jobs, include_expired).agg(F.count(F.lit(1)).alias("total"), F.count("month").alias("dated"))


def _matching(jobs: DataFrame, query: str, include_description: bool, include_expired: bool) -> DataFrame:
    columns = [*SEARCH_COLUMNS, *(["description"] if include_description else [])]
    rows = _rows(jobs, include_expired)
    return rows.filter(expr.contains_text(columns, query)) if query else rows


def search(jobs: DataFrame, query: str = "", limit: int = PAGE_SIZE, offset: int = 0, include_description: bool = False, include_expired: bool = False) -> DataFrame:
    """A page of the rows that contain the query, newest first, then by key; only the nine columns of a page are read."""
    _positive("limit", limit), _not_negative("offset", offset)
    found = _matching(jobs, query, include_description, include_expired)
    return found.orderBy(expr.wall_clock(F.col("estimated_publish_date")).desc_nulls_last(), F.col(KEY).asc_nulls_last()).offset(offset).limit(limit).select(*PAGE_COLUMNS)


def search_total(jobs: DataFrame, query: str = "", include_description: bool = False, include_expired: bool = False) -> DataFrame:
    return _matching(jobs, query, include_description, include_expired).agg(F.count(F.lit(1)).alias("total"))


def page_states(jobs: DataFrame, query: str = "", size: int = PAGE_SIZE) -> DataFrame:
    """(page_offset, next_offset, previous_offset) of each page of a search; the last page has no next one, the first is its own previous."""
    found = search_total(jobs, query)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(_positive("size", size)).cast("long")))
    paged = found.select("total", starts.alias("page_offset"))
    after = F.col("page_offset") + size
    return paged.select("page_offset", F.when(after < F.col("total"), after).alias("next_offset"), F.greatest(F.col("page_offset") - size, F.lit(0)).cast("long").alias("previous_offset"))


# --- values ----------------------------------------------------------------------------------


@dataclass(frozen=True, slots=True)
class Bucket:
    label: str | None
    count: int


@dataclass(frozen=True, slots=True)
class Breakdown:
    """total is the sum of the buckets and other."""

    column: str
    buckets: tuple[Bucket, ...]
    other: int
    total: int


@dataclass(frozen=True, slots=True)
class MultiBreakdown:
    """A row may mention several values, so mentions and rows are both given."""

    column: str
    buckets: tuple[Bucket, ...]
    other_mentions: int
    jobs_with_value: int
    total_mentions: int


@dataclass(frozen=True, slots=True)
class Recency:
    """older: dated rows outside the window, later months too."""

    buckets: tuple[Bucket, ...]
    older: int
    undated: int
    total: int


@dataclass(frozen=True, slots=True)
class Page:
    rows: tuple[dict, ...]
    total: int
    offset: int

    def next_offset(self, size: int = PAGE_SIZE) -> int | None:
        return self.offset + size if self.offset + size < self.total else None

    def previous_offset(self, size: int = PAGE_SIZE) -> int:
        return max(0, self.offset - size)


def _buckets(df: DataFrame) -> tuple[Bucket, ...]:
    return tuple(Bucket(r[0], r[1]) for r in df.collect())


def get_breakdown(jobs: DataFrame, column: str, limit: int = 15, include_expired: bool = False) -> Breakdown:
    buckets = _buckets(breakdown(jobs, column, limit, include_expired))
    total = breakdown_total(jobs, column, include_expired).first()[0]
    return Breakdown(column, buckets, total - sum(b.count for b in buckets), total)


def get_multi_breakdown(jobs: DataFrame, column: str, limit: int = 25, include_expired: bool = False) -> MultiBreakdown:
    buckets = _buckets(multi_breakdown(jobs, column, limit, include_expired))
    mentions, with_value = multi_breakdown_totals(jobs, column, include_expired).first()
    return MultiBreakdown(column, buckets, mentions - sum(b.count for b in buckets), with_value, mentions)


def technical_tools(jobs: DataFrame, limit: int = 25, include_expired: bool = False) -> MultiBreakdown:
    return get_multi_breakdown(jobs, "technical_tools", limit, include_expired)


def workplace_countries(jobs: DataFrame, limit: int = 15, include_expired: bool = False) -> MultiBreakdown:
    return get_multi_breakdown(jobs, "workplace_countries", limit, include_expired)


def get_recency(jobs: DataFrame, months: int = 24, include_expired: bool = False, now: dt.datetime | None = None) -> Recency:
    buckets = _buckets(recency(jobs, months, include_expired, now))
    total, dated = recency_totals(jobs, include_expired).first()
    return Recency(buckets, dated - sum(b.count for b in buckets), total - dated, total)


def get_page(jobs: DataFrame, query: str = "", limit: int = PAGE_SIZE, offset: int = 0, include_description: bool = False, include_expired: bool = False) -> Page:
    rows = search(jobs, query, limit, offset, include_description, include_expired).collect()
    return Page(tuple(r.asDict() for r in rows), search_total(jobs, query, include_description, include_expired).first()[0], offset)


def summary(jobs: DataFrame, now: dt.datetime | None = None) -> dict:
    """Everything a dashboard shows, from one cached projection without the description and the blobs."""
    wide = {"description", "job_information_json", "v5_processed_job_data_json", "enriched_company_data_json"}
    base = jobs.select(*[c for c in JOBS.names if c in jobs.columns and c not in wide]).persist()
    try:
        return {
            "overview": overview(base).first().asDict(),
            "fills": [r.asDict() for r in fill_rates(base).collect()],
            "tools": technical_tools(base, 15),
            "countries": workplace_countries(base, 8),
            "breakdowns": {c: get_breakdown(base, c, 8) for c in ("workplace_type", "seniority_level", "job_category", "role_type")},
            "compensation": [r.asDict() for r in compensation(base).collect()],
            "coverage": compensation_coverage(base).first().asDict(),
            "recency": get_recency(base, 24, now=now),
        }
    finally:
        base.unpersist()


def open_table(spark, path: str) -> DataFrame:
    """The flat table at a path, checked against the declared columns; every failure is StatsUnavailable."""
    try:
        df = spark.read.parquet(path)
        missing = [c for c in JOBS.names if c not in df.columns]
    except Exception as e:  # noqa: BLE001 - whatever the reader raises
        raise StatsUnavailable(f"{path} cannot be read: {e}") from e
    if missing:
        raise StatsUnavailable(f"{path} lacks columns: {', '.join(missing)}")
    return df


def bar(share: float, width: int = 20) -> str:
    """A share from 0 to 1 as text."""
    full = round(max(0.0, min(1.0, share)) * width)
    return "█" * full + "░" * (width - full)


def count_text(n: int | None) -> str:
    """A number with separators; a dash for none."""
    return "-" if n is None else f"{n:,}"


def megabytes(n: int | None) -> str:
    """Bytes in MB of 10^6; a dash for none."""
    return "-" if n is None else f"{n / 1e6:,.1f} MB"


def bars(buckets: tuple[Bucket, ...], width: int = 20) -> str:
    """Labels, counts and bars in proportion to the greatest count; no lines for no buckets."""
    most = max((b.count for b in buckets), default=0)
    longest = max((len(b.label or "-") for b in buckets), default=0)
    return "\n".join(f"{b.label or '-':<{longest}} {count_text(b.count):>10} {bar(b.count / most if most else 0, width)}" for b in buckets)
