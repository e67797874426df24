"""The register format over a local server: keys, pages, failures, streams that start again."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tieweave.sources import register_source, registers
from tieweave.streaming import ingest


class Server:
    """A register of ``n`` parliamentarians by pages and by key; keeps the paths it was asked."""

    def __init__(self, n):
        self.n, self.calls = n, []
        own = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                own.calls.append(self.path)
                status, found = 200, None
                if self.path == "/count":
                    found = {"total": own.n}
                elif self.path.startswith("/page"):
                    skip, take = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
                    found = [own.member(i) for i in range(skip, min(skip + take, own.n))]
                elif self.path.startswith("/member/") and self.path[8:].isdigit() and int(self.path[8:]) < own.n:
                    found = own.member(int(self.path[8:]))
                else:
                    status = 500 if "broken" in self.path else 404
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(found).encode() if status == 200 else b"")

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    @staticmethod
    def member(i):
        return {"id": str(i), "name": f"Member {i}", "party": f"Party {i % 3}", "posts": [], "committees": []}


@pytest.fixture
def server(spark):
    register_source.register(spark)
    own = Server(45)
    yield own
    own.server.shutdown()


def opened(reader, server, path, **options):
    return reader.format("register").options(url=server.base + path, pause=0, wait=0, **options).load()


def paged(reader, server, **options):
    return opened(reader, server, "/page?skip={skip}&take={take}", total_url=server.base + "/count", **options)


def test_each_key_is_asked_once(spark, server):
    keys = json.dumps(["7", "44", "a b", "broken", None, "7"])
    df = opened(spark.read, server, "/member/{key}", clients=2, keys=keys)
    found = {r.key: r for r in df.collect()}
    assert {k: r.status for k, r in found.items()} == {"7": 200, "44": 200, "a b": 404, "broken": 500}
    assert json.loads(found["7"].body)["name"] == "Member 7" and found["a b"].body is None and found["broken"].error
    assert sorted(server.calls) == ["/member/44", "/member/7", "/member/a%20b", "/member/broken"]
    assert df.rdd.getNumPartitions() == 2
    # What one query filters, the next one still has.
    assert [r.key for r in df.where("key = '44'").collect()] == ["44"]
    assert df.count() == 4 and df.where("key = '7'").unionByName(df.where("status = 404")).count() == 2
    assert opened(spark.read, server, "/member/{key}", keys="[]").collect() == []


def test_pages_of_a_range(spark, server):
    df = paged(spark.read, server, clients=3, take=10)
    assert sorted(r.skip for r in df.collect()) == [0, 10, 20, 30, 40]
    server.calls.clear()
    assert sorted(r.skip for r in paged(spark.read, server, take=10, rows_from=20, rows_to=35).collect()) == [20, 30]
    assert sorted(c for c in server.calls if "page" in c) == ["/page?skip=20&take=10", "/page?skip=30&take=5"]
    assert paged(spark.read, server, rows_from=45).collect() == []
    # A DataFrame asks the pages of its first reading; what is loaded anew asks how many there are.
    server.n = 0
    assert df.count() == 5 and paged(spark.read, server).collect() == []


def test_landed_pages_are_members(spark, server, tmp_path):
    paged(spark.read, server, clients=2).where("status = 200").write.parquet(str(tmp_path / "landed"))
    pages = spark.read.parquet(str(tmp_path / "landed"))
    rows = pages.select(F.explode(F.from_json("body", f"array<struct<{registers.MEMBERS}>>")).alias("m")).select("m.*")
    landed = registers.members(rows)
    assert landed.mentions.where("entity_type_hint = 'person'").count() == 45
    assert landed.assertions.count() == 45


def test_stream_goes_on_where_it_was(spark, server, tmp_path):
    def load():
        stream = paged(spark.readStream, server, take=10, clients=2, per_batch=25)
        ingest.into(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        bodies = [r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        return sorted(int(m["id"]) for body in bodies for m in json.loads(body))

    first = load()
    assert first == list(range(len(first))) and first
    server.n = 72
    for _ in range(4):
        found = load()
    assert found == list(range(72))
    server.calls.clear()
    assert load() == found and not any("page" in c for c in server.calls)


def test_settings_that_make_no_sense(spark, server):
    for path, options in (("/all", {}), ("/member/{key}", {}), ("/page?skip={skip}", {"take": 0}), ("/page?skip={skip}", {})):
        with pytest.raises(Exception, match="needs|or more|need total"):
            opened(spark.read, server, path, **options).collect()
