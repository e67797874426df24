import datetime

from pyspark.sql import functions as F

from tieweave.sources import registers, rest, sinks
from tieweave.streaming import ingest


def test_companies(spark):
    rows = [
        ("01", "Acme Ltd", "active",
         [("A One", "director", datetime.date(2020, 1, 1), None, "British", "Wales", "/o/1", False, (1, 1970)), ("B Corp", "corporate-director", None, None, None, None, None, True, None)],
         [("individual", "A One", datetime.date(2020, 2, 1), None, "British", "Wales", None, (1, 1970)), ("corporate-entity", "Big plc", None, None, None, None, "77", None), ("individual", None, None, None, None, None, None, None)]),
    ]
    landed = registers.companies(spark.createDataFrame(rows, registers.COMPANIES))
    assert landed.mentions.count() == 5
    assert sorted(r.statement_type for r in landed.assertions.collect()) == ["DIRECTOR_OF", "DIRECTOR_OF", "OWNS", "PSC_OF"]


def test_crawl_stops_at_the_bound(spark):
    appointments = spark.createDataFrame([("o1", "1"), ("o1", "2"), ("o2", "2"), ("o2", "3"), ("o3", "9")], "officer string, company_number string")
    profiles = appointments.select("company_number").distinct()
    reached = lambda n: {r.company_number for r in registers.crawl(profiles, appointments, "1", n).collect()}
    assert reached(8) == {"1", "2", "3"} and reached(2) == {"1", "2"} and reached(1) == {"1"}


def test_donations(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(
        "DonorName,DonorStatus,DonorId,CompanyRegistrationNumber,RegulatedEntityName,RegulatedEntityType,RegulatedEntityId,Value,AcceptedDate,ReportedDate\n"
        'Ann Able,Individual,7,,Blue Party,Political Party,2,"£1,500.00",31/12/2020,\nAcme Ltd,Company,8,123,Blue Party,Political Party,2,,,01/02/2021\n,Individual,9,,Blue Party,Political Party,2,£5,,\n'
    )
    landed = registers.donations(registers.donations_csv(spark, str(path)))
    assert {(r.raw_name, r.entity_type_hint) for r in landed.mentions.collect()} == {("Ann Able", "person"), ("Acme Ltd", "company"), ("Blue Party", "party")}
    assert sorted((float(r.amount_gbp), str(r.valid_from)) for r in landed.assertions.collect()) == [(0.0, "2021-02-01"), (1500.0, "2020-12-31")]


def test_members_and_interests(spark):
    members = registers.members(spark.createDataFrame([("1", "Ann", "Blue", None, [("Minister", None, None)], [("Rail", "Chair", None, None), ("Bus", None, None, None)])], registers.MEMBERS))
    assert sorted(r.statement_type for r in members.assertions.collect()) == ["CHAIR_OF", "MEMBER_OF", "MEMBER_OF", "MINISTERIAL_ROLE"]
    rows = [
        ("1", "Ann", "x", None, [("OrganisationName", "Acme Ltd")]), ("1", "Ann", "x", None, [("PayerName", "Pay plc"), ("IsPaidAsDirectorOfPayer", "True")]),
        ("1", "Ann", "x", None, [("PayerName", "Ed"), ("Value", "£9")]), ("1", "Ann", "Bob Giver - £500", None, [("DonationSource", "s"), ("Value", "500")]),
    ]
    landed = registers.interests(spark.createDataFrame(rows, registers.INTERESTS))
    assert sorted(r.statement_type for r in landed.assertions.collect()) == ["ADVISER_TO", "DIRECTOR_OF", "DONATED_TO", "OWNS"]
    assert "Bob Giver" in {r.raw_name for r in landed.mentions.collect()}


def test_lords(spark):
    rows = [
        ("1", "L", 1, "a", None, "Chair, Visio Limited (games)", False), ("1", "L", 1, "b", "a", "Adviser, Other", None), ("1", "L", 2, "c", None, "half of Land Ltd (UK)", False),
        ("1", "L", None, "g", "b", "Director, Deep Ltd", False), ("1", "L", None, "h", "e", "Director, Below Gone Ltd", False), ("2", "M", None, "i", "a", "Director, Not Theirs Ltd", False),
        ("1", "L", 2, "d", None, "some shares", False), ("1", "L", 1, "e", None, "Chair, Gone Ltd", True), ("1", "L", 3, "f", None, "Chair, Land", False),
    ]
    landed = registers.lords(spark.createDataFrame(rows, registers.LORDS))
    assert sorted(r.statement_type for r in landed.assertions.collect()) == ["ADVISER_TO", "DIRECTOR_OF", "DIRECTOR_OF", "OWNS"]
    assert {r.raw_name for r in landed.mentions.collect()} == {"L", "Visio Limited", "Other", "Land Ltd (UK)", "Deep Ltd"}


def test_contracts_need_the_strict_name(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("n1", "t", "Council", "ACME Ltd.", "100", day, None, None), ("n1", "t", "Council", "Acme Limited", "£200", None, day, None), ("n2", "t", "Council", "Acme Group Ltd", "5", day, None, None)]
    targets = spark.createDataFrame([("Acme Limited", "01")], "name string, company_number string")
    awards = spark.createDataFrame(rows, registers.AWARDS)
    landed = registers.contracts(awards, targets)
    assert [(float(r.amount_gbp), r.statement_type) for r in landed.assertions.collect()] == [(200.0, "CONTRACTED_WITH")]
    both = registers.contracts(awards, targets.unionByName(spark.createDataFrame([("ACME plc", "02")], "name string, company_number string")))
    assert {r.company_number for r in both.mentions.collect()} == {"01", "02", None} and both.assertions.count() == 2


def test_group_pages(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = f"<table>{row('Title', 'Rail &amp; Bus')}{row('Category', 'x')}</table><table>{row('Officers')}{row('Role', 'Name', 'Party')}{row('Chair', '<b>Ann</b> Able', 'Blue')}{row('Clerk', '', 'x')}</table>"
    html += f"<table>{row('Not yet', '£9,000', '01/02/2020', '')}{row('Financial Benefits')}{row('Source', 'Value £s', 'Received', 'Registered')}{row('Acme Ltd', '£1,500', '01/02/2020 to 3/3', '')}"
    html += f"{row('Small', '£5', '', '')}{row('Benefits in kind')}{row('Too late', '9000', '', '')}</table>"
    landed = registers.groups_html(spark.createDataFrame([(1, html), (2, None), (3, "<table></table>")], "page_id int, html string"))
    assert {r.raw_name for r in landed.mentions.collect()} == {"Rail & Bus", "Ann Able", "Acme Ltd"}
    assert sorted((r.statement_type, str(r.valid_from)) for r in landed.assertions.collect()) == [("CHAIR_OF", "None"), ("FUNDS", "2020-02-01")]


def test_group_editions():
    assert registers.group_editions("2026-05-18")[:2] == ["260518", "260406"] and registers.group_editions("2026-05-18").count("260518") == 1


def test_bridge_takes_one_active_hit(spark):
    declared = spark.createDataFrame([("Acme Ltd",), ("Beta",), ("Gamma Inc",), ("The Company",)], "name string")
    register = spark.createDataFrame([("1", "ACME LIMITED", "active"), ("2", "Acme plc", "active"), ("3", "Beta Ltd", "active"), ("4", "Beta plc", "active"), ("5", "Gamma Ltd", "active")], "company_number string, company_name string, company_status string")
    assert {tuple(r) for r in registers.bridge(declared, register).collect()} == {("Acme Ltd", "1", None), ("Beta", None, "ambiguous:2"), ("Gamma Inc", None, "no match"), ("The Company", None, "empty key")}


def test_offshore_and_news(spark):
    entities = spark.createDataFrame([("C1", "company", "Big Island Ltd"), ("C2", "company", "Island Ltd")], "entity_id string, entity_type string, name string")
    leaked = spark.createDataFrame([("n1", "BIG ISLAND LIMITED", "MT", "papers"), ("n2", "Island Limited", "MT", "papers"), ("n3", "Big Island Ltd", "MT", "A corporate registry"), ("n4", "Big Island plc", "MT", "p")], "node_id string, name string, jurisdiction string, leak string")
    assert [r.node_id for r in registers.offshore_matches(leaked, entities).collect()] == ["n1"]
    articles = spark.createDataFrame([("C1", f"u{i % 5}", "t", "d", f"2020010{i % 5 + 1}T") for i in range(8)], "entity_id string, url string, title string, domain string, seendate string")
    assert {r.seen for r in registers.coverage(articles).collect()} == {"2020-01-05", "2020-01-04", "2020-01-03"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "source_code string, k int, v string")
    sinks.replace_source(df, path)
    sinks.replace_source(df.where("source_code = 'a'").withColumn("v", F.lit("z")), path)
    assert {(r.source_code, r.v) for r in spark.read.parquet(path).collect()} == {("a", "z"), ("b", "y")}
    seeds = str(tmp_path / "s")
    sinks.insert_absent(df.select("k", "v"), seeds, ["v"])
    sinks.insert_absent(df.select("k", F.lit("x").alias("v")).unionByName(df.select("k", F.lit("w").alias("v"))), seeds, ["v"])
    assert sorted(r.v for r in spark.read.parquet(seeds).collect()) == ["w", "x", "y"]
    assert {r.v for r in sinks.update(df, spark.createDataFrame([("a", None)], "source_code string, v string"), "source_code", ["v"]).collect()} == {None, "y"}
    assert sinks.delete(df, df.where("v = 'x'"), "v").count() == 1
    assert sinks.read_if_there(spark, "no_such_table") is None and sinks.read_path(spark, str(tmp_path / "nowhere")) is None
    sinks.reset(spark, path, seeds, ("a",))
    assert {r.source_code for r in spark.read.parquet(path).collect()} == {"b"} and sinks.read_path(spark, seeds) is None


def test_leaked_archives(spark, tmp_path):
    import zipfile

    header = "node_id,name,sourceID,jurisdiction,jurisdiction_description,more\n"
    lines = "".join(f'n{i},"Island, No {i} Ltd",Papers,SAM,{"Samoa" if i % 2 else ""},x\n' for i in range(25)) + "n99,,Papers,SAM,,x\n"
    with zipfile.ZipFile(tmp_path / "leak.zip", "w") as archive:
        archive.writestr("nodes-entities.csv", header + lines)
    (tmp_path / "nodes.csv").write_text(header + lines)
    found = registers.leaked_zip(spark, str(tmp_path / "leak.zip"), rows=10)
    assert found.count() == 25 and {r.jurisdiction for r in found.collect()} == {"Samoa", "SAM"}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, registers.leaked_csv(spark, str(tmp_path / "nodes.csv")).collect()))


def test_donations_csv_by_names(spark, tmp_path):
    (tmp_path / "d.csv").write_text('\ufeffECRef,Value,DonorName\n"C1","£2,000.00","Ann, of X"\nC2,"£10,000.00",Bob\nC3,,Cy\n')
    rows = registers.donations_csv(spark, str(tmp_path / "d.csv"), most=2).collect()
    assert [(r.ECRef, r.DonorName, r.RegulatedEntityId) for r in rows] == [("C2", "Bob", None), ("C1", "Ann, of X", None)]


def test_rest_pages(spark):
    import http.server
    import threading

    calls = []

    class Register(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            calls.append((self.path, self.headers.get("Authorization")))
            status, body = 200, b'{"items": [1, 2]}'
            if "missing" in self.path:
                status = 404
            elif "busy" in self.path and sum(p == self.path for p, _ in calls) < 3:
                status = 429
            elif "broken" in self.path:
                status = 500
            elif "skip=" in self.path:
                skip = int(self.path.split("skip=")[1].split("&")[0])
                body = str(list(range(skip, min(skip + 20, 45)))).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body if status == 200 else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Register)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    keys = spark.createDataFrame([("a b",), ("missing",), ("busy",), ("broken",)], "key string")
    found = {r.key: r for r in rest.fetched(keys, base + "/company/{key}", user="me", pause=0, wait=0).collect()}
    assert {k: r.status for k, r in found.items()} == {"a b": 200, "missing": 404, "busy": 200, "broken": 500}
    assert found["a b"].body == '{"items": [1, 2]}' and found["missing"].body is None and found["broken"].error
    assert ("/company/a%20b", "Basic bWU6") in calls
    pages = rest.paged(spark, base + "/search?skip={skip}&take={take}", 45, take=20, pause=0, wait=0).orderBy("skip").collect()
    assert [(r.skip, r.status) for r in pages] == [(0, 200), (20, 200), (40, 200)] and pages[2].body == "[40, 41, 42, 43, 44]"
    server.shutdown()


def test_stream_loads_each_assertion_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"assertion_id": "%s", "statement_type": "OWNS", "source_code": "s", "from_mention_id": "a", "to_mention_id": "b", "loaded_at": "2020-01-01T00:00:00Z"}\n'
    (tmp_path / "in" / "1.json").write_text(line % "x" + line % "y" + line % "x")
    for _ in range(2):
        stream = ingest.once(ingest.landed(spark, str(tmp_path / "in")))
        ingest.into(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        (tmp_path / "in" / "2.json").write_text(line % "y" + line % "z")
    assert sorted(r.assertion_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]
