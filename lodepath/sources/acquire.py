"""Paged acquisition of postings from a remote search service, behind a client that tests can replace.

The rate limit is global, so there is one reader: a generator of events on the driver. PageSource offers the
same as a Spark data source of one partition.
"""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ScrapeCancelled, ScrapeError
from ..functions.text import job_summary
from .sinks import write_raw_page
from .storage import read_bytes

TRIES, FIRST_WAIT = 3, 5.0
#: A description counts as there from so many characters.
DESCRIBED = 100
_BUILD = re.compile(r'"buildId"\s*:\s*"([^"]+)"')


class StaleBuild(ScrapeError):
    """The service has a new build; its id must be read again."""


class Client(Protocol):
    def get(self, url: str) -> str: ...


class HttpClient:
    """GET with a delay before each request, and waits of 5, 10, 20 ... seconds after 403, 429 and server errors."""

    def __init__(self, delay: float = 1.0, stop: threading.Event | None = None, opener: Callable[[str], str] | None = None, on_warning: Callable[[str], None] = lambda _m: None):
        self.delay, self.stop, self.on_warning = delay, stop or threading.Event(), on_warning
        self.opener = opener or self._open

    @staticmethod
    def _open(url: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json, text/html"}), timeout=30) as r:
            return r.read().decode("utf-8")

    def _wait(self, seconds: float) -> None:
        if self.stop.wait(seconds):
            raise ScrapeCancelled("cancelled")

    def get(self, url: str) -> str:
        for n in range(TRIES):
            self._wait(self.delay)
            try:
                return self.opener(url)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    raise StaleBuild(url) from e
                if e.code not in (403, 429) and e.code < 500:
                    raise ScrapeError(f"{url}: status {e.code}") from e
                self.on_warning(f"status {e.code}, try {n + 1} of {TRIES}")
            except OSError as e:
                self.on_warning(f"{e}, try {n + 1} of {TRIES}")
            if n + 1 < TRIES:
                self._wait(FIRST_WAIT * 2**n)
        raise ScrapeError(f"{url}: no answer after {TRIES} tries")


def parse_search_state(text: str) -> dict:
    """A search state: JSON, or a URL whose query holds it as searchState."""
    if "://" in text or text.startswith("?"):
        found = urllib.parse.parse_qs(urllib.parse.urlsplit(text).query).get("searchState")
        if not found:
            raise ValueError("the URL holds no searchState")
        text = found[0]
    try:
        state = json.loads(text)
    except ValueError as e:
        raise ValueError(f"searchState is not JSON: {e}") from e
    if not isinstance(state, dict):
        raise ValueError("searchState is not an object")
    return state


def load_presets(path: str) -> dict[str, dict]:
    """Saved searches by name: a JSON object whose members are search states; ValueError for anything else."""
    found = json.loads(read_bytes(path))
    if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
        raise ValueError(f"{path} is not an object of search states")
    return found


def resolve_search_state(query: str | None = None, url: str | None = None, preset: str | None = None, presets: dict[str, dict] | None = None) -> dict:
    """The state of one of: a free query, a URL, a saved search by name. At most one may be given."""
    if sum(x is not None for x in (query, url, preset)) > 1:
        raise ValueError("query, url and preset exclude one another")
    if url is not None:
        return parse_search_state(url)
    if preset is not None:
        if preset not in (presets or {}):
            raise ValueError(f"unknown preset {preset!r}; known: {', '.join(sorted(presets or {})) or 'none'}")
        return dict(presets[preset])
    return {"searchQuery": query} if query else {}


@dataclass(frozen=True)
class ScrapeConfig:
    base_url: str
    state: dict = field(default_factory=dict)
    max_jobs: int | None = None
    max_pages: int | None = None
    descriptions: bool = True
    raw_dir: str | None = None

    def check(self) -> None:
        for name in ("max_jobs", "max_pages"):
            v = getattr(self, name)
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be positive, got {v}")
        if self.raw_dir and not self.descriptions:
            raise ValueError("raw_dir needs descriptions")


@dataclass(frozen=True)
class ScrapeEvent:
    """kind: started, page, job, warning or done."""

    kind: str
    message: str = ""
    hit: dict | None = None
    detail: dict | None = None
    jobs: int = 0
    with_descriptions: int = 0
    path: str | None = None


class _Service:
    def __init__(self, client: Client, base_url: str):
        self.client, self.base, self.build = client, base_url.rstrip("/"), None

    def bootstrap(self) -> None:
        found = _BUILD.search(self.client.get(self.base + "/"))
        if not found:
            raise ScrapeError("the start page names no build")
        self.build = found[1]

    def _json(self, path: str) -> dict:
        for n in range(2):  # a stale build is read anew once
            if self.build is None:
                self.bootstrap()
            try:
                return json.loads(self.client.get(f"{self.base}/_next/data/{self.build}/{path}"))
            except StaleBuild:
                self.build = None
                if n:
                    raise
            except ValueError as e:
                raise ScrapeError(f"{path} is not JSON: {e}") from e
        raise ScrapeError(path)

    def page(self, state: dict, number: int) -> dict:
        query = urllib.parse.urlencode({"searchState": json.dumps(state, separators=(",", ":")), "page": number})
        return self._json(f"index.json?{query}").get("pageProps") or {}

    def detail(self, key: str) -> dict | None:
        props = self._json(f"viewjob/{urllib.parse.quote(key, safe='')}.json").get("pageProps") or {}
        moved = props.get("__N_REDIRECT")
        if moved:
            slug = str(moved).rstrip("/").rsplit("/", 1)[-1]
            props = self._json(f"viewjob/{urllib.parse.quote(slug, safe='')}.json").get("pageProps") or {}
        job = props.get("job")
        return job if isinstance(job, dict) else None


def wanted(hits: list[Any], seen: set[str]) -> list[dict]:
    """The hits of a page that are objects, not pinned, have a key and an id not seen on earlier pages."""
    return [h for h in hits if isinstance(h, dict) and not h.get("is_pinned") and h.get("requisition_id") and h.get("id") not in seen]


def wanted_hits(hits: DataFrame, run: str, page: str) -> DataFrame:
    """wanted() over a log of hits: those with a key whose id stands on no earlier page of their run. is_pinned, if there, must not be true.

    Repeated hits of one page stay. A null id is never seen before. The earliest page of an id is a partially
    aggregated minimum, so a hit that stands on most pages is not gathered.
    """
    open_ = hits.filter("requisition_id is not null" + (" and is_pinned is not true" if "is_pinned" in hits.columns else ""))
    first = open_.filter("id is not null").groupBy(F.col(run).alias("_run"), F.col("id").alias("_id")).agg(F.min(page).alias("_first"))
    same = (F.col("_id") == F.col("id")) & F.col("_run").eqNullSafe(F.col(run))
    return open_.join(first, same, "left").filter(F.col("_first").isNull() | (F.col(page) == F.col("_first"))).select(*hits.columns)


def scrape(config: ScrapeConfig, client: Client, stop: threading.Event | None = None) -> Iterator[ScrapeEvent]:
    """Events of a run, pulled one by one; arguments are checked at the call. Cancelling takes effect after the current request."""
    config.check()
    return _scrape(config, _Service(client, config.base_url), stop or threading.Event())


def _scrape(config: ScrapeConfig, service: _Service, stop: threading.Event) -> Iterator[ScrapeEvent]:
    seen: set[str] = set()
    jobs = described = number = 0
    service.bootstrap()
    yield ScrapeEvent("started", service.build or "")
    while config.max_pages is None or number < config.max_pages:
        props = service.page(config.state, number)
        hits = wanted(props.get("ssrHits") or [], seen)
        yield ScrapeEvent("page", f"page {number}: {len(hits)} new of {props.get('ssrTotalCount')}", jobs=jobs)
        for hit in hits:
            if stop.is_set():
                raise ScrapeCancelled("cancelled")
            if config.max_jobs is not None and jobs >= config.max_jobs:
                yield ScrapeEvent("done", jobs=jobs, with_descriptions=described)
                return
            seen.add(hit.get("id"))
            detail, path = None, None
            if config.descriptions:
                detail = service.detail(str(hit["requisition_id"]))
                described += len(job_summary(hit, detail)[2]) > DESCRIBED
                if config.raw_dir and detail is not None:
                    path = write_raw_page(detail, config.raw_dir, hit)
                    if path is None:
                        yield ScrapeEvent("warning", f"{hit['requisition_id']}: incomplete page, not written")
            jobs += 1
            yield ScrapeEvent("job", hit=hit, detail=detail, jobs=jobs, with_descriptions=described, path=path)
        number += 1
        if props.get("ssrIsLastPage") or not props.get("ssrHits"):
            break
    yield ScrapeEvent("done", jobs=jobs, with_descriptions=described)


class PageSource(DataSource):
    """spark.read.format("postings") after spark.dataSource.register(PageSource): one row for each posting.

    Options: base_url, query or url, max_jobs, max_pages, delay.
    """

    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return "id string, requisition_id string, source string, board_token string, title string, company_name string, text string, hit string, detail string"

    def reader(self, schema):
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        return [InputPartition(0)]  # the rate limit is global

    def client(self) -> Client:
        return HttpClient(float(self.options.get("delay", "1")))

    def read(self, partition):
        o = self.options
        whole = lambda k: int(o[k]) if k in o else None
        config = ScrapeConfig(o["base_url"], resolve_search_state(o.get("query"), o.get("url")), whole("max_jobs"), whole("max_pages"))
        for e in scrape(config, self.client()):
            if e.kind == "job":
                text = lambda v: None if v is None else str(v)
                yield tuple(text(e.hit.get(k)) for k in ("id", "requisition_id", "source", "board_token")) + job_summary(e.hit, e.detail) + (json.dumps(e.hit), None if e.detail is None else json.dumps(e.detail))
