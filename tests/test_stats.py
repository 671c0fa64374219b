import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodepath.errors import StatsUnavailable
from lodepath.functions import expr
from lodepath.operators import stats
from lodepath.schema import JOBS

#: id, key, expired, title, company, workplace, countries, tools, low, high, currency, published
ROWS = [
    ("p1", "k01", False, "Nurse, Night Shift", "Northwind Clinic", "Onsite", '["SE","NO"]', '["Excel"]', 40000.0, 44000.0, "SEK", "2025-11-03T08:30:00Z"),
    ("p2", "k02", False, "Welder", "Kiln & Co", "Onsite", '["NO"]', "[]", 60000.0, 66000.0, "NOK", "2025-10-30T23:59:59Z"),
    ("p3", "k03", False, "Welding Lead", "Kiln & Co", "Onsite", '["NO"]', '["CAD","Excel"]', 70000.0, None, "NOK", "2025-09-01T00:00:00Z"),
    ("p4", "k04", False, "Clerk 20% Evenings", None, "Hybrid", "[]", '["Excel"]', None, 31000.0, "NOK", "someday"),
    ("p5", "k05", False, "Gardener", "Parks", None, "[]", "[]", -5.0, 0.0, "SEK", "2018-02-11T12:00:00Z"),
    ("p6", "k06", True, "Closed Post", "Parks", "Remote", '["DK"]', '["Excel","CAD"]', 500000.0, 600000.0, "SEK", "2025-11-20T00:00:00Z"),
    ("p7", "k07", False, "Trainee", "Parks", "Hybrid", '["SE"]', "[]", None, None, "DKK", "2025-12-24T00:00:00Z"),
]
NAMES = "id requisition_id is_expired title company_name workplace_type workplace_countries technical_tools yearly_min_compensation yearly_max_compensation listed_compensation_currency estimated_publish_date".split()
NOW = dt.datetime(2025, 11, 15, tzinfo=dt.timezone.utc)


def make(spark, rows=ROWS):
    kinds = {f.name: f.dataType.simpleString() for f in JOBS}
    full = [tuple(dict(zip(NAMES, r, strict=True)).get(c) for c in JOBS.names) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"`{c}` {kinds[c]}" for c in JOBS.names))


@pytest.fixture(scope="module")
def jobs(spark):
    return make(spark).cache()


def test_overview(jobs):
    r = stats.overview(jobs).first()
    assert (r.total_rows, r.active_rows, r.expired_rows, r.active_companies, r.earliest_active, r.latest_active) == (7, 6, 1, 3, "2018-02-11", "2025-12-24")


def test_null_counts_as_active_and_blanks_are_trimmed(spark):
    more = [*ROWS, ("7", "req-g", None, "x", "\u00a0Parks ", None, None, None, None, None, "", "2026-01-03T00:00:00+05:00"), ("8", "req-h", None, "y", "\t", None, '[null,"NO"]', "", None, None, " NOK", "2026")]
    df = make(spark, more)
    r = stats.overview(df).first()
    assert (r.active_rows, r.active_companies, r.latest_active) == (8, 4, "2026-01-03")  # a tab is no blank to trim
    assert stats.get_multi_breakdown(df, "workplace_countries").buckets[0] == stats.Bucket("NO", 4)
    assert stats.Bucket(None, 1) in stats.get_multi_breakdown(df, "workplace_countries").buckets
    assert stats.get_recency(df, 3, now=NOW).undated == 2  # neither 2026 nor someday


def test_fill_rates(jobs, spark):
    got = {r.column_name: (r.filled, r.total) for r in stats.fill_rates(jobs).collect()}
    assert got["workplace_type"] == (5, 6) and got["workplace_countries"] == (4, 6) and got["technical_tools"] == (3, 6)
    assert stats.fill_rates(jobs, []).count() == 0
    assert stats.fill_rates(make(spark, []), ["title"]).first().pct == 0.0


def test_breakdowns(jobs):
    b = stats.get_breakdown(jobs, "workplace_type", 1)
    assert b.buckets == (stats.Bucket("Onsite", 3),) and b.other == 2 and b.total == 5
    m = stats.technical_tools(jobs)
    assert (m.buckets[0], m.total_mentions, m.jobs_with_value) == (stats.Bucket("Excel", 3), 4, 3)
    assert stats.workplace_countries(jobs).buckets == (stats.Bucket("NO", 3), stats.Bucket("SE", 2))


def test_numbers_as_text(spark):
    df = make(spark, [("1", f"k{i}", False, "t", None, None, None, None, v, None, None, None) for i, v in enumerate([1e7, 1e-5, 1e16, 123.25, float("nan")])])
    assert {r.label for r in stats.breakdown(df, "yearly_min_compensation").collect()} == {"10000000.0", "1e-05", "1e+16", "123.25", "nan"}


def test_compensation(jobs):
    nok, sek = stats.compensation(jobs).collect()
    assert (nok.currency, nok.jobs, nok.min_jobs, nok.min_p25, nok.min_median, nok.min_p75) == ("NOK", 3, 2, 62500.0, 65000.0, 67500.0)
    assert (nok.max_jobs, nok.max_p25, nok.max_median) == (2, 39750.0, 48500.0)
    assert (sek.currency, sek.jobs, sek.min_median, sek.max_p75) == ("SEK", 1, 40000.0, 44000.0)
    assert tuple(stats.compensation_coverage(jobs).first()) == (4, 6)


def test_recency(jobs):
    r = stats.get_recency(jobs, 3, now=NOW)
    assert [(b.label, b.count) for b in r.buckets] == [("2025-09", 1), ("2025-10", 1), ("2025-11", 1)]
    assert (r.older, r.undated, r.total) == (2, 1, 6)  # a later month counts as older
    assert stats.month_labels(14, dt.datetime(2026, 1, 1))[0] == "2024-12"


def test_search(jobs):
    rows = stats.get_page(jobs).rows
    assert [r["requisition_id"] for r in rows] == ["k07", "k01", "k02", "k03", "k05", "k04"]
    assert [stats.get_page(jobs, q).total for q in ("%", "_", "20%", "KILN")] == [1, 0, 1, 2]
    page = stats.get_page(jobs, limit=2, offset=2)
    assert [r["requisition_id"] for r in page.rows] == ["k02", "k03"] and page.next_offset(2) == 4 and page.previous_offset(3) == 0
    assert [tuple(r) for r in stats.page_states(jobs, size=4).collect()] == [(0, 4, 0), (4, None, 0)]
    assert set(rows[0]) == set(stats.PAGE_COLUMNS)


def test_plans_read_only_what_they_name(spark, tmp_path):
    make(spark).write.parquet(str(tmp_path / "t"))
    df = stats.open_table(spark, str(tmp_path / "t"))
    plan = stats.breakdown(df, "workplace_type")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<is_expired:boolean,workplace_type:string>" in plan and "Not(EqualNullSafe(is_expired,true))" in plan and "TakeOrdered" in plan


def test_arguments(jobs, spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown column"):
        stats.breakdown(jobs, "title; drop table jobs")
    with pytest.raises(ValueError, match="limit must be positive"):
        stats.breakdown(jobs, "title", 0)
    with pytest.raises(ValueError, match="offset must not be negative"):
        stats.search(jobs, offset=-1)
    with pytest.raises(ValueError, match="months must be positive"):
        stats.recency(jobs, 0)
    with pytest.raises(StatsUnavailable):
        stats.open_table(spark, str(tmp_path / "none"))


def test_summary(jobs):
    s = stats.summary(jobs, NOW)
    assert s["overview"]["active_rows"] == 6 and s["breakdowns"]["workplace_type"].total == 5
    assert stats.bars(s["breakdowns"]["workplace_type"].buckets, 6).splitlines()[0] == "Onsite          3 ██████" and stats.megabytes(2_500_000) == "2.5 MB" and stats.count_text(None) == "-"


def test_mentions_are_of_strict_json_arrays_only(spark):
    texts = ['["US", null]', " [] ", "['US']", '["US",]', '"US"', '{"a": "US"}', '["US"', "", None, '["DE", "\\u0055S"]']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, c string")
    got = {r.i: r.m for r in df.select("i", expr.mentions(F.col("c")).alias("m")).collect()}
    assert got == {0: ["US", None], 1: [], **dict.fromkeys(range(2, 9)), 9: ["DE", "US"]}
