import json

import pytest
from pages import gz, job, page

from lodepath.schema import ENRICHED, JOB_INFORMATION, JOBS, PROCESSED, fields
from lodepath.sources.validate import number_text, process, render_date


def ok(j, **k):
    row, error = process(gz(page(j, **k)))
    assert error is None, error
    assert list(row) == JOBS.names
    return row


def bad(value):
    row, error = process(value if isinstance(value, bytes) else gz(value))
    assert row is None
    return error


def test_counts_of_fields():
    assert [len(fields(x)) for x in (JOB_INFORMATION, PROCESSED, ENRICHED)] == [7, 91, 19] and len(JOBS) == 33


def test_whole_row():
    v5 = {"workplace_countries": ["US"], "technical_tools": None, "yearly_min_compensation": 415740, "estimated_publish_date": "2026-07-10T19:02:42.789Z", "401k_matching": True, "bi-weekly_min_compensation": 1e7, "unknown": {"x": 1}}
    row = ok(job(board_token=14459, v5_processed_job_data=v5, enriched_company_data={"status": "VALID", "nb_employees": 5000000000}, _geoloc=[{"lat": 37.3229978, "lon": 1}, {"lat": 0, "lon": 0}]))
    assert (row["board_token"], row["workplace_countries"], row["technical_tools"], row["yearly_min_compensation"]) == ("14459", '["US"]', "[]", 415740.0)
    assert (row["estimated_publish_date"], row["latitude"], row["longitude"], row["nb_employees"]) == ("2026-07-10T19:02:42.789+00:00", 37.3229978, 1.0, 5000000000)
    blob = row["v5_processed_job_data_json"]
    assert '"estimated_publish_date":"2026-07-10T19:02:42.789Z"' in blob and '"bi-weekly_min_compensation":10000000.0' in blob and '"unknown"' not in blob
    assert list(json.loads(blob)) == [n for n, _ in fields(PROCESSED)]
    assert "description" not in json.loads(row["job_information_json"]) and json.loads(row["job_information_json"])["viewedByUsers"] == []


def test_absent_parts():
    row = ok(job(), mark="__N_SSP")
    assert row["enriched_company_data_json"] is None and row["latitude"] is None and row["nb_employees"] is None


@pytest.mark.parametrize(
    ("change", "says"),
    [
        ({"id": 1}, "invalid type: number for field `id`"),
        ({"is_expired": None}, "is_expired"),
        ({"board_token": 1.5}, "board_token"),
        ({"board_token": True}, "board_token"),
        ({"_geoloc": None}, "_geoloc"),
        ({"_geoloc": [{"lat": 1}]}, "lat"),
        ({"v5_processed_job_data": {"technical_tools": ["a", None]}}, "technical_tools"),
        ({"v5_processed_job_data": {"num_language_requirements": 3.0}}, "num_language_requirements"),
        ({"v5_processed_job_data": {"estimated_publish_date": "2026-13-01T00:00:00Z"}}, "estimated_publish_date"),
        ({"enriched_company_data": []}, "enriched_company_data"),
    ],
)
def test_wrong_kinds(change, says):
    error = bad(page(job(**change)))
    assert error.startswith("parse/validate:") and says in error


def test_missing_and_repeated():
    j = job()
    del j["source_and_board_token"]
    assert bad(page(j)) == "parse/validate: missing field `source_and_board_token`"
    assert "missing field `__N_SSG`" in bad({"pageProps": {"job": job()}})
    both = page(job()) | {"__N_SSP": True}
    assert "duplicate field" in bad(both)
    text = json.dumps(page(job())).replace('"id": "id-k1"', '"id": "id-k1", "id": "x"').encode()
    assert "duplicate field `id`" in bad(gz(text))
    assert bad(gz(json.dumps(page(job())).encode() + b" x")).startswith("parse/validate:")


def test_gzip_errors():
    for data in (b"", None, b"not gzip", gz(page(job()))[:-12]):
        assert process(data)[1].startswith("gunzip:")
    assert process(gz(b"\xff\xfe"))[1].startswith("parse/validate:")


def test_number_and_date_text():
    assert [number_text(x) for x in (0.0, -0.0, 1e7, 1e15, 1e16, 1e-5, 1.5e-7, 123.456, -2.5)] == ["0.0", "-0.0", "10000000.0", "1000000000000000.0", "1e16", "0.00001", "1.5e-7", "123.456", "-2.5"]
    assert [render_date(x, False) for x in ("2026-01-02T03:04:05Z", "2026-01-02t03:04:05.1+05:30", "2026-01-02 03:04:05.123456789-0700")] == ["2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.100+05:30", "2026-01-02T03:04:05.123456789-07:00"]
