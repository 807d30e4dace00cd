import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from factloom.sources import fetch


@pytest.fixture(scope="module")
def server():
    seen, times = Counter(), defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            times[self.headers["Host"]].append(time.monotonic())
            where = urlparse(self.path)
            status = 404 if where.path == "/none" else 503 if where.path == "/later" and seen[self.path] < 3 or where.path == "/never" else 200
            body = f"<p>é {self.path}</p>".encode("latin-1" if where.path == "/latin" else "utf-8")
            if where.path == "/api":
                title = parse_qs(where.query)["titles"][0]
                body = ('{"query":{"pages":{"7":{"extract":"== About ==\\n%s stands.\\n\\nMore"}}}}' % title if title != "Gone" else '{"query":{"pages":{"-1":{}}}}').encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=" + ("latin-1" if where.path == "/latin" else "utf-8"))
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1], seen, times
    s.shutdown()


def test_every_url_gives_a_row(spark, server, tmp_path):
    port, seen, times = server
    hosts = [f"127.0.0.1:{port}", f"localhost:{port}"]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("a", "b", "c", "d", "none", "latin")] + [f"http://{hosts[0]}/later", f"http://{hosts[1]}/never", "http://127.0.0.1:1/x", "//[bad", "http://[bad/", "no url", ""]
    df = spark.createDataFrame([(u,) for u in [*urls, *urls[:3], None]], "url string").repartition(3)
    got = {r["url"]: r for r in fetch.fetched_pages(df, str(tmp_path / "urls"), pause=0.1, attempts=3, timeout=5).collect()}
    assert set(got) == set(urls)
    assert {r["status"] for u, r in got.items() if u.endswith(("/a", "/latin", "/later"))} == {200} and got[f"http://{hosts[0]}/later"]["attempts"] == 3
    assert got[f"http://{hosts[0]}/latin"]["html"] == "<p>é /latin</p>"
    assert [(r["status"], r["html"], r["attempts"]) for u, r in got.items() if u.endswith("/none")] == [(404, None, 1)] * 2
    never = got[f"http://{hosts[1]}/never"]
    assert (never["status"], never["attempts"], never["error"]) == (503, 3, "503 Service Unavailable")
    assert all(got[u]["status"] is None and got[u]["error"] for u in urls[-5:])
    assert seen["/a"] == 2  # once from each host
    for h in hosts:  # no two requests to a host come closer than the pause
        at = sorted(times[h])
        assert min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.09


def test_hosts_take_turns_in_a_file(spark, tmp_path):
    df = spark.createDataFrame([(f"http://h{i % 3}.example/{i}",) for i in range(30)], "url string")
    folder = fetch.qualified(spark, str(tmp_path / "urls"))
    fetch.add_urls(df, folder, share=100)
    reading = fetch._Reading({"path": folder})
    [file] = reading.files(0, 1)
    hosts = [r["host"] for r in spark.read.parquet(file.path).collect()]
    assert [len(set(hosts[i : i + 3])) for i in range(0, 30, 3)] == [3] * 10


def test_stream_asks_for_what_was_added(spark, server, tmp_path):
    port, seen, _ = server
    folder, out, checkpoint = (str(tmp_path / n) for n in ("urls", "out", "checkpoint"))

    def run():
        stream = fetch.follow_pages(spark, folder, pause=0.01)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["url"].rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    url = lambda *names: spark.createDataFrame([(f"http://localhost:{port}/{n}",) for n in names], "url string")
    fetch.add_urls(url("s1", "s2"), fetch.qualified(spark, folder))
    assert run() == ["s1", "s2"]
    fetch.add_urls(url("s3"), fetch.qualified(spark, folder))
    assert run() == ["s1", "s2", "s3"] and run() == ["s1", "s2", "s3"]
    assert seen["/s1"] == seen["/s3"] == 1


def test_articles_online(spark, server, tmp_path):
    port, _, _ = server
    urls = ["https://en.wikipedia.org/wiki/Big_Ben%20x", "https://en.wikipedia.org/wiki/Gone", "https://other.example/wiki/A"]
    df = fetch.online_articles(spark.createDataFrame([(u,) for u in urls], "url string"), str(tmp_path / "urls"), f"http://localhost:{port}/api", pause=0.01)
    assert {r["url"]: r["text"] for r in df.collect()} == {urls[0]: "About Big_Ben x stands.\n\nMore", urls[1]: "", urls[2]: ""}
