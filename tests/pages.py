"""Input pages for tests."""

import gzip
import json


def job(key="k1", **more):
    return {
        "id": f"id-{key}", "board_token": "b", "source": "s", "apply_url": "u", "source_and_board_token": "s_b", "requisition_id": key, "collapse_key": "c", "is_expired": False, "objectID": "o",
        "job_information": {"title": "T", "job_title_raw": "Raw", "description": "<p>D</p>"}, "v5_processed_job_data": {},
    } | more


def page(j, mark="__N_SSG"):
    return {"pageProps": {"job": j}, mark: True}


def gz(value):
    return gzip.compress(value if isinstance(value, bytes) else json.dumps(value).encode(), mtime=0)
