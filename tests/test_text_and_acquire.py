import json
import threading
import urllib.error

import pytest
from pages import job

from lodepath.errors import ScrapeCancelled, ScrapeError
from lodepath.functions.text import html_to_text, job_summary, raw_filename
from lodepath.sources import acquire


def test_html_to_text():
    assert html_to_text("<h1>A &amp; B</h1><ul><li>x</li><li>y</li></ul>c<br>d") == "A & B\n- x\n- y\nc\nd"
    assert html_to_text(None) == "" and html_to_text("a<script>b</script>") == "ab" and html_to_text("<p>x</p>end &am") == "x"


def test_raw_filename():
    assert raw_filename("abc123") == "abc123.json.gz" and raw_filename(" ") is None and raw_filename(None) is None
    names = [raw_filename(k) for k in ("ABC", "abc", "a/b", "a:b", "con", "ü" * 80, "日本", "a.")]
    assert len(set(names)) == len(names) and all(len(n) < 100 and n.endswith(".json.gz") for n in names)


def test_job_summary():
    assert job_summary({"v5_processed_job_data": {"core_job_title": "C", "company_name": "N"}}, None) == ("C", "N", "")
    assert job_summary({}, {"job_information": {"title": "T", "description": "<p>x</p>"}}) == ("T", "", "x")


class Stub:
    """Two pages of hits, details, and a build that goes stale once."""

    def __init__(self, stale=0):
        self.stale, self.builds, self.urls = stale, 0, []

    def get(self, url):
        self.urls.append(url)
        if "_next" not in url:
            self.builds += 1
            return f'x "buildId": "B{self.builds}" y'
        if self.stale and f"/B{self.stale}/" in url:
            raise acquire.StaleBuild(url)
        if "viewjob" in url:
            return json.dumps({"pageProps": {"job": job(url.rsplit("/", 1)[1][:-5], job_information={"title": "T", "job_title_raw": "r", "description": "d" * 200})}})
        n = int(url.rsplit("page=", 1)[1])
        hits = [{"id": f"i{n}{k}", "requisition_id": f"r{n}{k}", "source": "s", "board_token": "b"} for k in range(2)] + [{"id": "i00", "requisition_id": "r00"}, {"id": "p", "requisition_id": "p", "is_pinned": True}, "odd", {"id": "n"}]
        return json.dumps({"pageProps": {"ssrHits": hits, "ssrTotalCount": 9, "ssrIsLastPage": n == 1}})


def test_scrape(tmp_path):
    events = list(acquire.scrape(acquire.ScrapeConfig("https://x.example", raw_dir=str(tmp_path / "raw")), Stub()))
    jobs = [e for e in events if e.kind == "job"]
    assert [e.hit["requisition_id"] for e in jobs] == ["r00", "r01", "r00", "r10", "r11"]  # within one page repeats stay
    assert events[-1].kind == "done" and events[-1].with_descriptions == 5 and jobs[0].path.endswith("r00.json.gz")


def test_scrape_limits_and_stale_build():
    stub = Stub(stale=1)
    events = list(acquire.scrape(acquire.ScrapeConfig("https://x.example", max_jobs=1), stub))
    assert stub.builds == 2 and sum(e.kind == "job" for e in events) == 1
    assert sum(e.kind == "page" for e in acquire.scrape(acquire.ScrapeConfig("https://x.example", max_pages=1, descriptions=False), Stub())) == 1
    for wrong in ({"max_jobs": 0}, {"raw_dir": "d", "descriptions": False}):
        with pytest.raises(ValueError):
            acquire.scrape(acquire.ScrapeConfig("x", **wrong), Stub())
    stop = threading.Event()
    stop.set()
    with pytest.raises(ScrapeCancelled):
        list(acquire.scrape(acquire.ScrapeConfig("https://x.example"), Stub(), stop))


def test_client_waits_and_gives_up():
    waits, answers = [], [429, 503, "ok"]

    def opener(_url):
        a = answers.pop(0)
        if isinstance(a, int):
            raise urllib.error.HTTPError("u", a, "", {}, None)
        return a

    client = acquire.HttpClient(0, opener=opener)
    client._wait = waits.append
    assert client.get("u") == "ok" and waits == [0, 5.0, 0, 10.0, 0]
    answers[:] = [500, 500, 500]
    with pytest.raises(ScrapeError):
        client.get("u")
    answers[:] = [404]
    with pytest.raises(acquire.StaleBuild):
        client.get("u")


def test_search_state():
    assert acquire.resolve_search_state(url="https://x.example/?searchState=%7B%22a%22%3A1%7D") == {"a": 1}
    assert acquire.resolve_search_state(query="q") == {"searchQuery": "q"} and acquire.resolve_search_state(preset="p", presets={"p": {"b": 2}}) == {"b": 2}
    for wrong in ({"url": "https://x.example/"}, {"url": "[1]"}, {"preset": "none"}, {"query": "a", "url": "b"}):
        with pytest.raises(ValueError):
            acquire.resolve_search_state(**wrong)


def test_data_source(spark, monkeypatch):
    reader = acquire._PageReader({"base_url": "https://x.example", "max_jobs": "2"})
    monkeypatch.setattr(reader, "client", lambda: Stub())
    rows = list(reader.read(reader.partitions()[0]))
    assert len(rows) == 2 and len(rows[0]) == 9
    spark.dataSource.register(acquire.PageSource)


def test_presets_from_a_file(tmp_path):
    (tmp_path / "p.json").write_text('{"remote": {"searchQuery": "x"}}')
    assert acquire.resolve_search_state(preset="remote", presets=acquire.load_presets(str(tmp_path / "p.json"))) == {"searchQuery": "x"}
    (tmp_path / "p.json").write_text("[1]")
    with pytest.raises(ValueError):
        acquire.load_presets(str(tmp_path / "p.json"))
