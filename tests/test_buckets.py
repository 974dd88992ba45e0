"""Fetching and storing files behind addresses."""

import hashlib
import http.server
import threading

import pytest

from obsidia.sources import buckets


@pytest.fixture(scope="module")
def bucket():
    """A server that keeps what is put, and answers with the status that a path names."""
    kept = {"/a.txt": b"hola"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path in kept:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(kept[self.path])
            else:
                self.send_response(int(self.path.strip("/")))
                self.send_header("Location", "/a.txt")
                self.end_headers()

        def do_PUT(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path.startswith("/keep"):
                kept[self.path] = body + self.headers.get("x-mark", "").encode()
                self.send_response(201)
            else:
                self.send_response(int(self.path.strip("/")))
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", kept
    server.shutdown()


def test_fetched(spark, bucket, tmp_path):
    url, _ = bucket
    (tmp_path / "f.txt").write_bytes(b"local")
    rows = [(1, f"{url}/a.txt"), (2, f"{url}/404"), (3, f"{url}/503"), (4, f"{url}/302"), (5, "http://127.0.0.1:9/x"), (6, f"file://{tmp_path}/f.txt"), (7, "not an address"), (8, None)]
    got = {r.id: r for r in buckets.fetched(spark.createDataFrame(rows[:7], "id int, source_url string")).collect()}
    assert (bytes(got[1].content), got[1].outcome, got[1].sha256) == (b"hola", "done", hashlib.sha256(b"hola").hexdigest())
    assert {i: r.outcome for i, r in got.items()} == {1: "done", 2: "permanent", 3: "transient", 4: "transient", 5: "transient", 6: "done", 7: "transient"}
    assert got[2].error == "status 404" and got[2].content is None
    small = buckets.fetched(spark.createDataFrame(rows[:1], "id int, source_url string"), most=3).first()
    assert (small.outcome, small.error, small.content) == ("permanent", "TOO_LARGE", None)


def test_stored(spark, bucket):
    url, kept = bucket
    rows = [(1, f"{url}/keep1", {"x-mark": "!"}, b"abc"), (2, f"{url}/403", None, b"abc"), (3, f"{url}/500", {}, b"abc")]
    got = {r.id: r.outcome for r in buckets.stored_at(spark.createDataFrame(rows, "id int, target_url string, target_headers map<string,string>, content binary")).collect()}
    assert got == {1: "done", 2: "permanent", 3: "transient"} and kept["/keep1"] == b"abc!"
