"""Paged sources against a local service and a folder."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from siftwell.sources import paged

ROWS = [{"id": k, "text": f"row {k} é"} for k in range(257)]


@pytest.fixture
def service():
    asked, refused = Counter(), set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items() if k in ("offset", "limit")}
            asked[q["offset"]] += 1
            if q["offset"] in refused or (q["offset"] == 40 and asked[40] == 1):  # page 2 is busy the first time
                self.send_response(404 if q["offset"] in refused else 503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            body = json.dumps({"total": len(ROWS), "rows": ROWS[q["offset"] : q["offset"] + q["limit"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows?kind=x", asked, refused
    server.shutdown()


def test_pages_of_a_service(spark, service):
    url, asked, _ = service
    found = paged.read_pages(spark, url=url, limit="20", pagesatask="2")
    assert found.rdd.getNumPartitions() == 7
    rows = paged.rows_of(found, "id long, text string").orderBy("ord").collect()
    assert [(r.id, r.text) for r in rows] == [(r["id"], r["text"]) for r in ROWS] and asked[40] >= 2


def test_a_download_goes_on_where_it_stopped(spark, service, tmp_path):
    url, asked, refused = service
    refused.add(160)
    told = []
    with pytest.raises(Exception, match="404"):
        paged.download(spark, str(tmp_path / "d"), together=3, told=lambda *x: told.append(x), url=url, limit="20")
    assert told == [(3, 13), (6, 13)]
    refused.clear()
    before = dict(asked)
    kept = paged.download(spark, str(tmp_path / "d"), together=3, url=url, limit="20")
    assert sorted(json.loads(r.value)["id"] for r in kept.collect()) == list(range(257))
    assert all(asked[o] == before[o] for o in range(20, 120, 20))  # the first two rounds are not asked for again


def test_pages_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.jsonl").write_text("\n".join(json.dumps({"id": 10 * k + j}) for j in range(k)) + "\n\n")
    (tmp_path / "notes.txt").write_text("x")
    got = paged.rows_of(paged.read_pages(spark, folder=str(tmp_path)), "id long").orderBy("ord").collect()
    assert [r.id for r in got] == [10, 20, 21]
    (tmp_path / "empty").mkdir()
    assert paged.download(spark, str(tmp_path / "out"), folder=str(tmp_path / "empty")).collect() == []
    with pytest.raises(ValueError, match="an url or a folder"):
        paged.PagedReader({})
