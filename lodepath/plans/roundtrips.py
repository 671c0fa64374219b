"""Queries of ingest, validation, sinks and acquisition, with equivalent SQL.

DuckDB cannot unzip a column, so the pages of these queries are built from the flat table (pages.py); what comes back
through listing, unzipping, strict validation, flattening and keyed writing is then what SQL finds in that table.
"""

from __future__ import annotations

import json
import os
import threading
import urllib.error

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Cancelled
from ..functions.text import job_summary
from ..operators import compaction, stats
from ..operators.upsert import last_wins
from ..schema import ENRICHED, JOB_INFORMATION, JOBS, PROCESSED, fields
from ..session import materialise, shared_folder, spread, table
from ..sources import acquire, sinks
from ..sources.files import list_inputs, parse_content
from ..sources.snapshot import Snapshots
from ..streaming.incremental import ingest_stream
from . import corpus
from .ingest import run_ingest
from .pages import COLUMNS, pages
from .problems import _GOOD_PLACES

_jobs = lambda s, d: table(s, d, "jobs")
_FLAT = [c for c in JOBS.names if c != "description"]


# --- pages: unzipped, validated, flattened ---------------------------------------------------


def _damaged(jobs: DataFrame) -> DataFrame:
    """(row_id, content): every page, some of them damaged in ways that the row's id tells."""
    kind, body = F.pmod("row_id", F.lit(13)), F.col("content")
    whole = pages(jobs, ["row_id"])
    cut = F.expr("substring(content, 1, length(content) - 12)")
    return whole.select("row_id", F.when(kind == 0, cut).when(kind == 1, F.lit(b"no gzip at all")).when(kind == 2, F.concat(body, F.lit(b"behind the end"))).when(kind == 3, F.lit(None)).otherwise(body).alias("content"))


def page_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each page, by its kind; null where nothing is. Text behind the first member of a gzip file is not read."""
    done = parse_content(_damaged(_jobs(spark, d)), ["row_id"])
    return done.select("row_id", F.substring_index("error", ":", 1).alias("kind"))


def flatten_pages(spark: SparkSession, d: str) -> DataFrame:
    """The flat columns of each valid page, blobs included; the description by its length."""
    done = parse_content(_damaged(_jobs(spark, d)), ["row_id"]).filter("error is null")
    return done.select("row_id", *[F.col("row")[c].alias(c) for c in _FLAT], F.length(F.col("row.description")).cast("long").alias("description_length"))


# --- ingest of directories ---------------------------------------------------------------------


def _deliver(spark: SparkSession, jobs: DataFrame, folder: str) -> None:
    """The last row of each key as a file of the folder."""
    last = last_wins(jobs.withColumn("key", F.col("requisition_id")), ["key"], ["row_id"])
    named = pages(last, ["requisition_id"]).select(F.concat("requisition_id", F.lit(".json.gz")).alias("file_name"), "content")
    sinks.write_files(named, folder)


def _two_deliveries(spark: SparkSession, d: str):
    """Ingest of the loads with odd numbers, then of the others into the same directory, then of no change: (results, folder)."""
    jobs, at = _jobs(spark, d), shared_folder(spark, "ingest")
    results = []
    for half in ("load_id % 2 = 1", "load_id % 2 = 0"):
        _deliver(spark, jobs.filter(half), f"{at}/in")
        results.append(run_ingest(spark, f"{at}/in", f"{at}/out"))
    results.append(run_ingest(spark, f"{at}/in", f"{at}/out"))
    return results, f"{at}/out"


def ingest_runs_counted(spark: SparkSession, d: str) -> DataFrame:
    """What the runs say of themselves, from their lines of JSON."""
    results, out = _two_deliveries(spark, d)
    held = Snapshots(spark, out).info()
    lines = [json.loads(r.line()) for r in results]
    rows = [(i, x["files"], x["skipped"], x["parsed"], x["ok"], x["errors"], x["full"], x["total_rows"], min(10, len(x["error_samples"])), held["manifest_entries"]) for i, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "step int, files long, skipped long, parsed long, ok long, errors long, is_full boolean, total_rows long, samples int, manifest_entries long")


def ingest_table(spark: SparkSession, d: str) -> DataFrame:
    """The table after these runs: what a file that is no longer valid once held stays."""
    return Snapshots(spark, _two_deliveries(spark, d)[1]).read("jobs").select(*_FLAT)


def ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after these runs: the key of each file that was read well."""
    return Snapshots(spark, _two_deliveries(spark, d)[1]).read("manifest").select("file_name", "requisition_id")


def ingest_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same table from the streaming query: one batch of what is there, started again after the second delivery."""
    jobs, at = _jobs(spark, d), shared_folder(spark, "stream")
    for half in ("load_id % 2 = 1", "load_id % 2 = 0"):
        _deliver(spark, jobs.filter(half), f"{at}/in")
        ingest_stream(spark, f"{at}/in", f"{at}/out", f"{at}/state", once=True).awaitTermination()
    return Snapshots(spark, f"{at}/out").read("jobs").select(*_FLAT)


def ingest_full(spark: SparkSession, d: str) -> DataFrame:
    """A full run forgets: only what is in the directory now, and valid, is in the table."""
    jobs, at = _jobs(spark, d), shared_folder(spark, "full")
    _deliver(spark, jobs.filter("load_id % 2 = 1"), f"{at}/a")
    run_ingest(spark, f"{at}/a", f"{at}/out")
    _deliver(spark, jobs.filter("load_id % 2 = 0"), f"{at}/b")
    run_ingest(spark, f"{at}/b", f"{at}/out", full=True)
    return Snapshots(spark, f"{at}/out").read("jobs").select(*_FLAT)


def ingest_cancelled(spark: SparkSession, d: str) -> DataFrame:
    """A run that is stopped ends as cancelled and commits nothing."""
    at, stop, ended = shared_folder(spark, "stopped"), threading.Event(), "done"
    _deliver(spark, _jobs(spark, d).filter("load_id % 2 = 1"), f"{at}/in")
    try:
        run_ingest(spark, f"{at}/in", f"{at}/out", on_event=lambda _m: stop.set(), stop=stop)
    except Cancelled:
        ended = "cancelled"
    return spark.createDataFrame([(ended, Snapshots(spark, f"{at}/out").current() is not None)], "ended string, committed boolean")


def _unpacked(spark: SparkSession, d: str) -> str:
    """All of raw_files as files, in the directories that it names."""
    at = shared_folder(spark, "files")
    files = table(spark, d, "raw_files").withColumn("name", F.concat_ws("/", F.regexp_replace("root_dir", "/", "_"), "file_name"))
    sinks.write_files(files, at, "name")
    return at


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Every input of every directory, with its size."""
    at = _unpacked(spark, d)
    roots = [r[0] for r in table(spark, d, "raw_files").select(F.regexp_replace("root_dir", "/", "_")).distinct().collect()]
    found = list_inputs(spark, [f"{at}/{r}" for r in roots])
    return found.select(F.element_at(F.split("path", "/"), -2).alias("directory"), "file_name", "size_bytes")


def first_files(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred inputs by name."""
    at = _unpacked(spark, d)
    roots = [r[0] for r in table(spark, d, "raw_files").select(F.regexp_replace("root_dir", "/", "_")).distinct().collect()]
    return list_inputs(spark, [f"{at}/{r}" for r in roots], 100).select("file_name")


# --- sinks -----------------------------------------------------------------------------------------


def sqlite_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A SQLite file of the odd loads, brought up to date with the even ones; the odd loads' expired keys are stale. SQLite holds no NaN: it comes back as null."""
    at = shared_folder(spark, "sqlite").removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    half = lambda n: _jobs(spark, d).filter(f"load_id % 2 = {n}").select("requisition_id", "row_id", "title", "yearly_min_compensation", "is_expired")
    old, new = (materialise(last_wins(half(n), ["requisition_id"], ["row_id"])) for n in (1, 0))
    sinks.write_sqlite(old, f"{at}/t.db")
    sinks.write_sqlite(new, f"{at}/t.db", replace=False, stale=old.filter("is_expired"))
    return sinks.read_sqlite(spark, f"{at}/t.db", "requisition_id string, row_id long, title string, yearly_min_compensation double")


def ipc_hand_off(spark: SparkSession, d: str) -> DataFrame:
    """Rows through an Arrow IPC file, counted at the other end."""
    at = shared_folder(spark, "ipc").removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    rows = _jobs(spark, d).select("row_id", "title", "is_expired", "nb_employees", "latitude")
    n = sinks.write_ipc(rows, f"{at}/t.arrow")
    back = sinks.read_ipc(f"{at}/t.arrow", n)
    return spark.createDataFrame(back)


def exports(spark: SparkSession, d: str) -> DataFrame:
    """Rows through one Parquet file and through JSON lines."""
    at, rows = shared_folder(spark, "exports"), _jobs(spark, d).select("row_id", "title", "company_name", "yearly_max_compensation")
    sinks.write_parquet(rows.select("row_id", "title"), f"{at}/p", 1)
    sinks.write_jsonl(rows.select("row_id", "company_name", "yearly_max_compensation"), f"{at}/j")
    lines = spark.read.schema("row_id long, company_name string, yearly_max_compensation double").json(f"{at}/j")
    return spark.read.parquet(f"{at}/p").join(lines, "row_id")


def compact_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page, some of them damaged, compacted into few files: the ids that stand in the committed version."""
    out = shared_folder(spark, "pages")
    files = _damaged(_jobs(spark, d)).select(F.col("row_id").alias("file_id"), F.concat(F.lit("page-"), "row_id").alias("file_name"), F.octet_length("content").cast("long").alias("size_bytes"), "content")
    record = compaction.compact(files, out, 1 << 20)
    return spark.read.parquet(f"{out}/{record['version']}").select("file_id", "file_name")


# --- acquisition -------------------------------------------------------------------------------------


def wanted_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each source's pages that have a key and an id of no earlier page."""
    return acquire.wanted_hits(table(spark, d, "search_hits"), "source", "page_no").select("hit_id", "id", "requisition_id", "page_no")


def identity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Each hit completed with the identity of its posting, and what it still lacks."""
    hits = table(spark, d, "search_hits").select("hit_id", "id", "requisition_id", "source", "board_token")
    last = last_wins(_jobs(spark, d).select("id", "requisition_id", "source", "board_token", "apply_url", "collapse_key", "is_expired", "row_id").withColumn("key", F.col("id")), ["key"], ["row_id"])
    both = hits.withColumn("key", F.col("id")).join(last.select("key", F.struct("id", "requisition_id", "source", "board_token", F.col("apply_url").alias("hc_apply_url"), "collapse_key", "is_expired").alias("other")), "key", "left")
    columns = ["id", "requisition_id", "source", "board_token", "apply_url", "collapse_key"]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                full = sinks.with_identity({k: r[k] for k in ("id", "requisition_id", "source", "board_token")}, r["other"])
                out.append({"hit_id": r["hit_id"], **{k: full.get(k) for k in columns}, "missing": ",".join(sinks.missing_keys(full))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("hit_id", pa.int64()), *((k, pa.string()) for k in columns), ("missing", pa.string())])
    return both.drop("key").mapInArrow(run, "hit_id long, " + ", ".join(f"{k} string" for k in columns) + ", missing string")


def job_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Title, company and readable text of each posting; rows of even id have no page of their own, only the hit."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = {"job_information": {"title": r["title"], "description": r["description"]}, "v5_processed_job_data": {"core_job_title": r["core_job_title"], "company_name": r["company_name"]}}
                title, company, text = job_summary(own, None if r["row_id"] % 2 == 0 else own)
                out.append({"row_id": r["row_id"], "title": title, "company": company, "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row_id", pa.int64()), ("title", pa.string()), ("company", pa.string()), ("text", pa.string())]))

    return spread(_jobs(spark, d).select("row_id", "title", "description", "core_job_title", "company_name")).mapInArrow(run, "row_id long, title string, company string, text string")


class _Answers:
    """A service of fixed answers: a stale build, one busy answer, a pinned hit, a hit without key, repeated hits, a page that has moved."""

    def __init__(self):
        self.asked, self.build = [], "B1"

    def __call__(self, url: str) -> str:
        self.asked.append(url)
        if url.endswith("/"):
            return f'<script>{{"buildId" : "{self.build}"}}</script>'
        if len(self.asked) == 2:  # the build that the start page named is gone
            self.build = "B2"
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        if len(self.asked) == 4:
            raise urllib.error.HTTPError(url, 429, "busy", None, None)
        hit = lambda n, **more: {"id": f"i{n}", "requisition_id": f"k{n}", "source": "s", "board_token": "b"} | more
        if "index.json" in url:
            number = int(url.rsplit("page=", 1)[1])
            hits = [[hit(1), hit(2, is_pinned=True), hit(3, requisition_id=None), hit(4), hit(4), "no object"], [hit(1), hit(5)]][number]
            return json.dumps({"pageProps": {"ssrHits": hits, "ssrTotalCount": 7, "ssrIsLastPage": number == 1}})
        key = url.rsplit("/", 1)[1].removesuffix(".json")
        if key == "k5":
            return json.dumps({"pageProps": {"__N_REDIRECT": "/viewjob/k5-new"}})
        text = "<p>" + "word " * (30 if key != "k4" else 3) + "</p>"
        return json.dumps({"pageProps": {"job": {"requisition_id": key, "job_information": {"title": f"T {key}", "description": text}}}})


def scrape_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of a run against the fixed answers above."""
    answers = _Answers()
    stop = threading.Event()
    stop.wait = lambda _seconds: False  # no delays
    warnings: list[str] = []
    client = acquire.HttpClient(0.0, stop, answers, warnings.append)
    events = list(acquire.scrape(acquire.ScrapeConfig("https://jobs.example"), client))
    rows = [(i, e.kind, (e.hit or {}).get("id"), ((e.detail or {}).get("job_information") or {}).get("title"), e.jobs, e.with_descriptions, len(warnings)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "n int, kind string, id string, title string, jobs int, with_descriptions int, warnings int")


_STATES = [("url", 'https://jobs.example/?searchState=%7B%22searchQuery%22%3A%22data%20team%22%2C%22n%22%3A2%7D&page=3'), ("url", '?searchState={"searchQuery":"x%26y"}'), ("url", '{"searchQuery": "plain"}'), ("url", "https://jobs.example/?page=3"), ("url", '["no object"]'), ("query", "nurse"), ("preset", "remote"), ("preset", "unknown")]


def search_states(spark: SparkSession, d: str) -> DataFrame:
    """What the ways to name a search come to; null where they name none."""
    rows = []
    for i, (kind, value) in enumerate(_STATES):
        try:
            state = acquire.resolve_search_state(**{kind: value}, presets={"remote": {"searchQuery": "", "workplaceTypes": ["Remote"]}})
        except ValueError:
            state = None
        rows.append((i, None if state is None else json.dumps(state, separators=(",", ":"))))
    return spark.createDataFrame(rows, "n int, state string")


# --- what is shown -----------------------------------------------------------------------------------


def page_states(spark: SparkSession, d: str) -> DataFrame:
    """The offset of each page of search results, and of the pages before and behind it."""
    return stats.page_states(_jobs(spark, d))


def breakdown_bars(spark: SparkSession, d: str) -> DataFrame:
    """A breakdown as it is shown: label, count and bar."""
    shown = stats.get_breakdown(_jobs(spark, d), "seniority_level", 8)
    most = max((b.count for b in shown.buckets), default=0)
    return spark.createDataFrame([(b.label, stats.count_text(b.count), stats.bar(b.count / most, 20)) for b in shown.buckets], "label string, n string, bar string")


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Everything that a dashboard shows, as rows of section, name and number."""
    s = stats.summary(_jobs(spark, d), corpus.NOW)
    rows = [("overview", k, v) for k, v in s["overview"].items() if isinstance(v, int)]
    rows += [("fill", r["column_name"], r["filled"]) for r in s["fills"]]
    rows += [(name, b.label, b.count) for name, x in (("tools", s["tools"]), ("countries", s["countries"])) for b in x.buckets]
    rows += [(c, b.label, b.count) for c, x in s["breakdowns"].items() for b in x.buckets]
    rows += [("pay", r["currency"], r["jobs"]) for r in s["compensation"]] + [("coverage", k, v) for k, v in s["coverage"].items()]
    rows += [("recency", b.label, b.count) for b in s["recency"].buckets] + [("recency", "undated", s["recency"].undated), ("recency", "older", s["recency"].older)]
    return spark.createDataFrame(rows, "section string, name string, n long")


QUERIES = {
    "page_errors": page_errors, "flatten_pages": flatten_pages, "ingest_runs_counted": ingest_runs_counted, "ingest_table": ingest_table, "ingest_manifest": ingest_manifest,
    "ingest_streamed": ingest_streamed, "ingest_full": ingest_full, "ingest_cancelled": ingest_cancelled, "listed_files": listed_files, "first_files": first_files,
    "sqlite_upsert": sqlite_upsert, "ipc_hand_off": ipc_hand_off, "exports": exports, "compact_pages": compact_pages,
    "wanted_hits": wanted_hits, "identity_backfill": identity_backfill, "job_summaries": job_summaries, "scrape_events": scrape_events, "search_states": search_states,
    "page_states": page_states, "breakdown_bars": breakdown_bars, "summary": summary,
}

# --- the same in SQL -----------------------------------------------------------------------------------

_LISTED = ("workplace_countries", "technical_tools")
_IS_LIST = lambda c: f"({c} IS NULL OR trim({c}, ' \t\n\r') = 'null' OR {_GOOD_PLACES.replace('workplace_countries', c)})"
_REQUIRED = [*"id source board_token apply_url requisition_id collapse_key is_expired title job_title_raw description".split()]
_FINITE = ["yearly_min_compensation", "yearly_max_compensation", "min_industry_and_role_yoe"]
#: Whether a row's page passes the strict validator.
_VALID = " AND ".join(
    [f"{c} IS NOT NULL" for c in _REQUIRED]
    + [_IS_LIST(c) for c in _LISTED]
    + [f"({c} IS NULL OR isfinite({c}))" for c in _FINITE]
    + ["(latitude IS NULL OR longitude IS NULL OR (isfinite(latitude) AND isfinite(longitude)))"]
    + [r"(estimated_publish_date IS NULL OR (regexp_full_match(estimated_publish_date, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})') AND try_cast(estimated_publish_date AS TIMESTAMPTZ) IS NOT NULL))"]
)
_TEXT_LIST = lambda c: f"""CASE WHEN {c} IS NULL OR trim({c}, ' \t\n\r') = 'null' THEN '[]' ELSE CAST(to_json(from_json({c}, '["VARCHAR"]')) AS VARCHAR) END"""
#: A date with as many digits of its fraction as it needs: 0, 3, 6 or 9.
_DATE = r"regexp_replace(regexp_replace(estimated_publish_date, '\.000([Z+-])', '\1'), 'Z$', '+00:00')"


def _sql_blob(spec: str, known: dict[str, str], skip: str = "") -> str:
    parts = [f"'{n}', {known.get(n, 'json(' + chr(39) + '[]' + chr(39) + ')' if k == 'l' else 'NULL')}" for n, k in fields(spec) if n != skip]
    return f"CAST(json_object({', '.join(parts)}) AS VARCHAR)"


_V5 = {c: c for c in "core_job_title job_category seniority_level role_type workplace_type formatted_workplace_location listed_compensation_currency company_name company_website min_industry_and_role_yoe yearly_min_compensation yearly_max_compensation".split()}
_V5 |= {c: f"json({_TEXT_LIST(c)})" for c in _LISTED} | {"estimated_publish_date": f"replace({_DATE}, '+00:00', 'Z')"}
_PLACED = lambda c: f"CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN {c} END"
_SHOWN = {c: c for c in _FLAT} | {c: _TEXT_LIST(c) for c in _LISTED} | {"estimated_publish_date": _DATE, "latitude": _PLACED("latitude"), "longitude": _PLACED("longitude")}
_SHOWN |= {
    "job_information_json": _sql_blob(JOB_INFORMATION, {"title": "title", "job_title_raw": "job_title_raw"}, "description"),
    "v5_processed_job_data_json": _sql_blob(PROCESSED, _V5),
    "enriched_company_data_json": _sql_blob(ENRICHED, {"status": "enriched_status", "nb_employees": "nb_employees", "year_founded": "year_founded"}),
}
_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in _SHOWN.items())
#: What pages are made of: two rows that agree in all of it have pages of one JSON value. A page with NaN is no JSON.
_VALUE = [c for c in COLUMNS if c not in (*_LISTED, "latitude", "longitude")]
_VALUE += [f"CASE WHEN {_GOOD_PLACES.replace('workplace_countries', c)} THEN json_normalize({c})::VARCHAR ELSE {c} END" for c in _LISTED] + [_PLACED(c) for c in ("latitude", "longitude")]
_WRITABLE = " AND ".join([f"({c} IS NULL OR isfinite({c}))" for c in _FINITE] + ["(latitude IS NULL OR longitude IS NULL OR (isfinite(latitude) AND isfinite(longitude)))"])
_LAST = lambda half: f"(SELECT *, ({_VALID}) AS valid FROM jobs WHERE load_id % 2 = {half} QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1)"
#: What stands under a key after both deliveries: the second file's row if it is valid, or else the first one's.
_BOTH = f"WITH a AS {_LAST(1)}, b AS {_LAST(0)}, t AS (SELECT * FROM b WHERE valid UNION ALL SELECT * FROM a WHERE valid AND requisition_id NOT IN (SELECT requisition_id FROM b WHERE valid))"
#: Readable lines of the markup that the descriptions are written in; the white space includes that of &nbsp;.
_WHITE = "[\\s\\x{00A0}]"
_LINES = "description"
for _from, _to in ((r"<li>", "\n- "), (r"</?(?:p|div|br|li|ul|ol|h[1-6])(?:\s[^>]*)?/?>", "\n"), (r"<[a-zA-Z/][^>]*>", ""), ("&nbsp;", " "), ("[ \\t]+", " "), (f"{_WHITE}*\n{_WHITE}*", "\n"), (f"^{_WHITE}+|{_WHITE}+$", "")):
    _LINES = f"regexp_replace({_LINES}, '{_from}', '{_to}', 'g')"
_WORDED = f"coalesce({_LINES}, '')"
_NOT_SEEN = "requisition_id IS NOT NULL AND (id IS NULL OR page_no = (SELECT min(page_no) FROM search_hits e WHERE e.requisition_id IS NOT NULL AND e.source IS NOT DISTINCT FROM h.source AND e.id = h.id))"
_OTHER = "(SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)"
_LACKS = ", ".join(f"CASE WHEN {e} IS NULL THEN '{k}' END" for k, e in sorted({k: "NULL" for k in ("objectID", "source_and_board_token", "job_information", "v5_processed_job_data")} .items() | {k: f"coalesce(h.{k}, o.{k})" for k in ("id", "requisition_id", "source", "board_token")}.items() | {k: f"o.{k}" for k in ("apply_url", "collapse_key", "is_expired")}.items()))
_SECTION = lambda name, label, n, query: f"SELECT '{name}' AS section, {label} AS name, {n} AS n FROM ({query})"


def _summary_sql() -> str:
    o = corpus.ORACLE
    top = lambda c, k: f"SELECT {corpus._FILLED.format(c=c)} AS label, count(*) AS n FROM jobs WHERE {corpus._A} AND {corpus._FILLED.format(c=c)} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT {k}"
    parts = [_SECTION("overview", f"'{k}'", k, o["overview_jobs"]) for k in ("total_rows", "active_rows", "expired_rows", "active_companies", "active_sources")]
    parts.append(_SECTION("fill", "column_name", "filled", o["fill_rates_jobs"]))
    parts.append(_SECTION("tools", "label", "n", o["technical_tools"].replace("LIMIT 25", "LIMIT 15")))
    parts.append(_SECTION("countries", "label", "n", o["workplace_countries"].replace("LIMIT 15", "LIMIT 8")))
    parts += [_SECTION(c, "label", "n", top(c, 8)) for c in ("workplace_type", "seniority_level", "job_category", "role_type")]
    parts.append(_SECTION("pay", "currency", "jobs", o["compensation_by_currency"]))
    parts += [_SECTION("coverage", f"'{k}'", k, o["compensation_coverage"]) for k in ("jobs_with_compensation", "active_jobs")]
    parts.append(_SECTION("recency", "month", "n", o["recency_months"]))
    parts.append(f"SELECT 'recency', 'undated', total - dated FROM ({o['recency_totals']})")
    parts.append(f"SELECT 'recency', 'older', (SELECT dated FROM ({o['recency_totals']})) - (SELECT sum(n) FROM ({o['recency_months']}))")
    return " UNION ALL ".join(f"SELECT section, name, CAST(n AS BIGINT) AS n FROM ({p}) AS x(section, name, n)" for p in parts)


ORACLE = {
    "page_errors": f"SELECT row_id, CASE WHEN row_id % 13 IN (0, 1, 3) THEN 'gunzip' WHEN NOT coalesce({_VALID}, false) THEN 'parse/validate' END AS kind FROM jobs",
    "flatten_pages": f"SELECT row_id, {_COLUMNS}, length(description) AS description_length FROM jobs WHERE row_id % 13 NOT IN (0, 1, 3) AND {_VALID}",
    "ingest_runs_counted": f"""{_BOTH}, n AS (SELECT (SELECT count(*) FROM a) AS f1, (SELECT count(*) FILTER (valid) FROM a) AS ok1, (SELECT count(*) FROM b) AS f2, (SELECT count(*) FILTER (valid) FROM b) AS ok2,
        (SELECT count(*) FROM (SELECT requisition_id FROM a UNION SELECT requisition_id FROM b)) AS fs, (SELECT count(*) FROM a WHERE NOT valid AND requisition_id NOT IN (SELECT requisition_id FROM b)) AS old_bad, (SELECT count(*) FROM t) AS total)
        SELECT 1::INTEGER AS step, f1 AS files, 0::BIGINT AS skipped, f1 AS parsed, ok1 AS ok, f1 - ok1 AS errors, true AS is_full, ok1 AS total_rows, least(10, f1 - ok1)::INTEGER AS samples, total AS manifest_entries FROM n
        UNION ALL SELECT 2, fs, fs - f2 - old_bad, f2 + old_bad, ok2, f2 - ok2 + old_bad, false, total, least(10, f2 - ok2 + old_bad), total FROM n
        UNION ALL SELECT 3, fs, fs - (f2 - ok2 + old_bad), f2 - ok2 + old_bad, 0, f2 - ok2 + old_bad, false, total, least(10, f2 - ok2 + old_bad), total FROM n""",
    "ingest_table": f"{_BOTH} SELECT {_COLUMNS} FROM t",
    "ingest_streamed": f"{_BOTH} SELECT {_COLUMNS} FROM t",
    "ingest_manifest": f"{_BOTH} SELECT requisition_id || '.json.gz' AS file_name, requisition_id FROM t",
    "ingest_full": f"SELECT {_COLUMNS} FROM {_LAST(0)} WHERE valid",
    "ingest_cancelled": "SELECT 'cancelled' AS ended, false AS committed",
    "listed_files": "SELECT replace(root_dir, '/', '_') AS directory, file_name, octet_length(content)::BIGINT AS size_bytes FROM raw_files WHERE file_name LIKE '%.json.gz'",
    "first_files": "SELECT file_name FROM raw_files WHERE file_name LIKE '%.json.gz' ORDER BY file_name LIMIT 100",
    "sqlite_upsert": """WITH a AS (SELECT * FROM jobs WHERE load_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1), b AS (SELECT * FROM jobs WHERE load_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY requisition_id ORDER BY row_id DESC) = 1)
        SELECT requisition_id, row_id, title, CASE WHEN NOT isnan(yearly_min_compensation) THEN yearly_min_compensation END AS yearly_min_compensation FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE is_expired IS NOT TRUE AND requisition_id NOT IN (SELECT requisition_id FROM b))""",
    "ipc_hand_off": "SELECT row_id, title, is_expired, nb_employees, latitude FROM jobs",
    "exports": "SELECT row_id, title, company_name, yearly_max_compensation FROM jobs",
    "compact_pages": f"SELECT min(row_id) AS file_id, 'page-' || min(row_id) AS file_name FROM jobs WHERE row_id % 13 NOT IN (0, 1, 3) AND {_WRITABLE} GROUP BY {', '.join(_VALUE)}",
    "wanted_hits": f"SELECT hit_id, id, requisition_id, page_no FROM search_hits h WHERE {_NOT_SEEN}",
    "identity_backfill": f"""SELECT h.hit_id, coalesce(h.id, o.id) AS id, coalesce(h.requisition_id, o.requisition_id) AS requisition_id, coalesce(h.source, o.source) AS source, coalesce(h.board_token, o.board_token) AS board_token,
        o.apply_url, o.collapse_key, concat_ws(',', {_LACKS}) AS missing FROM search_hits h LEFT JOIN {_OTHER} o ON o.id = h.id""",
    "job_summaries": f"SELECT row_id, coalesce(nullif(title, ''), nullif(core_job_title, ''), '') AS title, coalesce(company_name, '') AS company, {_WORDED} AS text FROM jobs",
    "scrape_events": """SELECT * FROM (VALUES (0, 'started', NULL, NULL, 0, 0, 1), (1, 'page', NULL, NULL, 0, 0, 1), (2, 'job', 'i1', 'T k1', 1, 1, 1), (3, 'job', 'i4', 'T k4', 2, 1, 1), (4, 'job', 'i4', 'T k4', 3, 1, 1),
        (5, 'page', NULL, NULL, 3, 0, 1), (6, 'job', 'i5', 'T k5-new', 4, 2, 1), (7, 'done', NULL, NULL, 4, 2, 1)) AS e(n, kind, id, title, jobs, with_descriptions, warnings)""",
    "search_states": """SELECT * FROM (VALUES (0, '{"searchQuery":"data team","n":2}'), (1, '{"searchQuery":"x&y"}'), (2, '{"searchQuery":"plain"}'), (3, NULL), (4, NULL), (5, '{"searchQuery":"nurse"}'), (6, '{"searchQuery":"","workplaceTypes":["Remote"]}'), (7, NULL)) AS s(n, state)""",
    "page_states": f"WITH t AS (SELECT count(*) AS n FROM jobs WHERE {corpus._A}) SELECT o AS page_offset, CASE WHEN o + 200 < n THEN o + 200 END AS next_offset, greatest(0, o - 200) AS previous_offset FROM t, generate_series(0::BIGINT, greatest(0, n - 1), 200) AS g(o)",
    "breakdown_bars": f"WITH b AS (SELECT {corpus._FILLED.format(c='seniority_level')} AS label, count(*) AS n FROM jobs WHERE {corpus._A} AND {corpus._FILLED.format(c='seniority_level')} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 8) SELECT label, format('{{:,}}', n) AS n, repeat('█', round_even(20.0 * n / max(n) OVER (), 0)::INTEGER) || repeat('░', 20 - round_even(20.0 * n / max(n) OVER (), 0)::INTEGER) AS bar FROM b",
    "summary": _summary_sql(),
}
corpus.ORACLE |= {
    "html_texts": f"SELECT row_id, {_WORDED} AS text FROM jobs",
    # every key of these tables is a safe name as it is; another would make the two sides differ
    "raw_filenames": "SELECT row_id, CASE WHEN regexp_full_match(requisition_id, '[a-z0-9]+([._-][a-z0-9]+)*') AND length(requisition_id) <= 64 THEN requisition_id || '.json.gz' END AS file_name FROM jobs",
}
