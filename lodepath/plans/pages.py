"""Pages built from the flat table, as the service would have sent them: what ingest reads, made from what SQL can see."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.jsontext import parse
from ..sources.sinks import page_bytes

_TEXTS = "core_job_title job_category seniority_level role_type workplace_type formatted_workplace_location listed_compensation_currency company_name company_website estimated_publish_date".split()
_NUMBERS = ["min_industry_and_role_yoe", "yearly_min_compensation", "yearly_max_compensation"]
_LISTS = ["workplace_countries", "technical_tools"]
COLUMNS = [
    *"id source board_token apply_url requisition_id collapse_key is_expired title job_title_raw description".split(), *_TEXTS, *_NUMBERS, *_LISTS, "enriched_status", "nb_employees", "year_founded", "latitude", "longitude"
]


def _held(text: str | None):
    """What a JSON text holds; a text that is no JSON is put into the page as it is, where it is an error."""
    try:
        return None if text is None else parse(text)
    except ValueError:
        return text


def posting(r: dict) -> dict:
    """The posting of a flat row. A board token of digits is sent as a number, as services do."""
    token = r["board_token"]
    job = {k: r[k] for k in ("id", "source", "apply_url", "requisition_id", "collapse_key", "is_expired")}
    job |= {"board_token": int(token) if token and token.isascii() and token.isdigit() and token[0] != "0" else token, "source_and_board_token": f"{r['source']}_{token}", "objectID": r["id"]}
    job["job_information"] = {k: r[k] for k in ("title", "job_title_raw", "description")}
    job["v5_processed_job_data"] = {k: r[k] for k in (*_TEXTS, *_NUMBERS)} | {k: _held(r[k]) for k in _LISTS}
    job["enriched_company_data"] = {"status": r["enriched_status"], "nb_employees": r["nb_employees"], "year_founded": r["year_founded"]}
    if r["latitude"] is not None and r["longitude"] is not None:
        job["_geoloc"] = [{"lat": r["latitude"], "lon": r["longitude"]}, {"lat": 0.0, "lon": 0.0}]
    return job


def pages(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., content): each row's page, gzipped."""
    kinds = dict(jobs.dtypes)
    need = list(dict.fromkeys([*keys, *COLUMNS]))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = pd.DataFrame({k: [r[k] for r in rows] for k in keys}, dtype=object)
            out["content"] = [page_bytes(posting(r)) for r in rows]
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    schema = to_arrow_schema(jobs.select(*keys).schema).append(pa.field("content", pa.binary()))
    return jobs.select(*need).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "content binary"]))
