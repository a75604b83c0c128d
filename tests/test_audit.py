"""Origins, drift, configurations, model replies, sources and sinks on small tables."""

from pyspark.sql import functions as F

from auditgrove.operators import configs, drift, items, model, origins, results
from auditgrove.sources import readers, writers


def test_root_domains(spark):
    hosts = {"x.s1.com": "s1.com", "s2.com": "s2.com", "sub.e.org": "e.org", "localhost": "localhost", "10.0.0.1": "10.0.0.1"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["root"] for r in df.withColumn("root", origins.root_domain(F.col("host"))).collect()} == hosts


def test_urls_in_all_fields(spark):
    row = ("s", "tool", "1", "t", "https://d.one.com", "http://u.one.com", '{"https://k.one.com":1,"a":["ws://n.two.org","see http://no.com"],"e":"say \\"http://quoted.com\\""}')
    df = spark.createDataFrame([row], "server string, item_type string, item_id string, name string, description string, uri string, input_schema string")
    leaf = {r["url"] for r in origins.extract_urls(df).collect()}
    assert leaf == {"https://d.one.com", "http://u.one.com", "https://k.one.com", "ws://n.two.org"}
    facts = origins.url_facts(origins.extract_urls(df))
    assert origins.cross_domain_findings(facts).first()["n_domains"] == 2
    assert origins.domain_outliers(facts).first()["root_domain"] == "two.org"
    assert origins.mixed_schemes(facts).first()["n_hosts"] == 4
    assert "http://no.com" in {r["url"] for r in origins.extract_urls(df, mode="anywhere").collect()}


def test_urls_in_escaped_and_nested_json(spark):
    cases = {
        r'{"a":"https:\/\/esc.example\/v1"}': {"https://esc.example/v1"},
        r'[[[{"x":[{"y":"\u0068ttp://u.example"}]}]]]': {"http://u.example"},
        r'{"http:\/\/key.example":null}': {"http://key.example"},
        r'{"a":"tail\\","b":"http://b.example"}': {"http://b.example"},
        r'{"a":"say \"http://quoted.example\""}': set(),
        r'{"a":"\\\"http://quoted.example"}': set(),
        '"https://alone.example"': {"https://alone.example"},
        '{"a":"http://broken.example"': set(),
        '{"n":1,"t":true}': set(), "": set(), None: set(),
        '{"a":"' + r"\n\t\"" * 20_000 + '","b":"wss://long.example"}': {"wss://long.example"},
    }
    df = spark.createDataFrame([("s", "tool", str(i), "t", j) for i, j in enumerate(cases)], "server string, item_type string, item_id string, name string, raw_json string")
    got = {}
    for r in origins.extract_urls(df).collect():
        got.setdefault(int(r["item_id"]), set()).add(r["url"])
    assert [got.get(i, set()) for i in range(len(cases))] == list(cases.values())
    inside = origins.extract_urls(df, "anywhere").where("item_id = '4'").first()
    assert inside["url"] == "http://quoted.example"


def test_public_suffixes(spark):
    urls = spark.createDataFrame([(f"http://{h}/x",) for h in ("a.co.uk", "x.b.co.uk", "co.uk", "c.org.zz", "localhost", "10.0.0.1", "d.e.com")], "url string")
    roots = lambda *given: {r["host"]: r["root_domain"] for r in origins.url_facts(urls, *given).collect()}
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), (".Com",), (None,), ("co.uk",)], "suffix string")
    assert roots(suffixes) == {"a.co.uk": "a.co.uk", "x.b.co.uk": "b.co.uk", "co.uk": "co.uk", "c.org.zz": "org.zz", "localhost": "localhost", "10.0.0.1": "10.0.0.1", "d.e.com": "e.com"}
    assert roots()["a.co.uk"] == roots()["x.b.co.uk"] == "co.uk"


def test_a_snapshot_never_differs_from_itself(spark):
    twice = snapshot(spark, [("s", "a", "one", None), ("s", "a", "two", None), ("s", "b", None, "{}"), (None, None, None, None), (None, None, "x", None)])
    assert drift.snapshot_changes(twice, twice).count() == 0
    assert not any(r["changed"] for r in drift.snapshot_changed(twice, twice).collect())


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "server string, name string, description string, input_schema string")


def test_diff_laws(spark):
    a = snapshot(spark, [("s", "x", "d", '{"a":1,"b":2}'), ("s", "y", None, None), ("t", "z", "d", None)])
    b = snapshot(spark, [("s", "x", "e", '{"b":2,"a":1}'), ("s", "w", "d", None), ("t", "z", "d", None)])
    assert drift.snapshot_changes(a, a).count() == 0 and not any(r["changed"] for r in drift.snapshot_changed(a, a).collect())
    kinds = lambda x, y, k: {r["name"] for r in drift.snapshot_changes(x, y).where(F.col("change_type") == k).collect()}
    assert kinds(a, b, "added") == kinds(b, a, "removed") == {"w"} and kinds(a, b, "modified") == {"x"}
    assert {r["field"] for r in drift.snapshot_changes(a, b).where("change_type = 'modified'").collect()} == {"description"}


def config_rows(spark, rows):
    df = spark.createDataFrame(rows, "file string, server_id long, name string, url string, command string, args array<string>, env map<string,string>, auth_headers map<string,string>, description string")
    return df.withColumn("precedence", F.lit(0))


def test_validation(spark):
    rows = [
        ("f", 1, "a", "http://h:0/", None, None, None, None, None), ("f", 2, "a", None, "run", ["x" * 5000, "\0"], {"9K": "v", "B-D": "w"}, {"H": " "}, "d" * 1001),
        ("f", 3, " ", "http://h", "run", None, None, None, None), ("f", 4, None, None, None, None, None, None, None), ("f", 5, "ok", "https://H/", None, None, None, None, None), ("f", 6, "ok2", "https://h", None, None, None, None, None),
        ("g", 7, "é" * 200, "gopher://x", None, None, None, None, None),
    ]
    found = configs.validate_configs(config_rows(spark, rows))
    got = {}
    for r in found.collect():
        got.setdefault(r["server_id"], set()).add(r["rule"])
    assert got[1] == {"port_zero"} and got[3] >= {"url_and_command", "empty_name"} and got[4] == {"no_url_or_command"} and got[6] == {"duplicate_key"}
    assert got[2] == {"long_argument", "argument_characters", "variable_digit", "variable_characters", "empty_header_value", "long_description", "duplicate_name"}
    assert got[7] == {"url_scheme", "long_name"} and 5 not in got
    kept = lambda s: {r["server_id"] for r in configs.drop_invalid(config_rows(spark, rows), found, s).collect()}
    assert kept("server") == {5} and kept("file") == set()


def test_url_forms(spark):
    forms = {"HTTP://Localhost:80//": "http://localhost:80", " http://127.0.0.1/x/ ": "http://localhost/x", "http://": "http://", "https://0.0.0.0": "https://localhost"}
    df = spark.createDataFrame([(u,) for u in forms], "u string")
    assert {r[0]: r[1] for r in df.select("u", configs.normal_url(F.col("u"))).collect()} == forms


def test_last_source_tag(spark):
    df = spark.createDataFrame([("a [IDE:x] [IDE:y]",), ("none",), (None,)], "d string")
    assert [r[0] for r in df.select(configs.source_of(F.col("d"))).collect()] == ["y", "IDE Configs", "IDE Configs"]


def test_replies(spark):
    rows = [("1", 'x [{"tool_name":"t","found_issue":true,"details":"d","issues":[{"issue_type":"Jailbreak","severity":"odd","message":"m","details":"e"}]}] y'), ("2", "none []"), ("3", "oops"), ("4", '[{"name":"n","issue_type":"PIILeakage","severity":"low","message":"m","details":"e"}]'), ("5", None)]
    parsed = model.parse_responses(spark.createDataFrame(rows, "reply_id string, reply string"))
    assert sorted((r["reply_id"], r["kind"]) for r in parsed.collect()) == [("1", "details"), ("1", "issue"), ("3", "error"), ("4", "issue"), ("5", "error")]
    issues = {r["reply_id"]: r for r in model.normalise_issues(parsed).collect()}
    assert issues["1"]["severity"] == "MEDIUM" and issues["4"]["severity"] == "LOW" and issues["4"]["message"].endswith(": m")


def test_no_scorer_no_rows(spark):
    batches = spark.createDataFrame([("s", "tool", 0, "p")], "server string, item_type string, batch_index long, prompt string")
    assert model.score_batches(batches, None).count() == 0

    def fail(prompt):
        raise RuntimeError("down")

    assert model.score_batches(batches, fail, workers=2).first()["error"] == "down"


def test_one_client_per_task_and_retries(spark, tmp_path):
    """Clients and attempts are counted in files, as tasks share no memory with the test."""
    folder, batches = str(tmp_path), spark.range(40).selectExpr("'s' AS server", "'tool' AS item_type", "id AS batch_index", "concat('p', id) AS prompt").repartition(8)

    class Client:
        def __init__(self):
            import uuid

            self.name = uuid.uuid4().hex
            open(f"{folder}/client-{self.name}", "w").close()

        def __call__(self, prompt):
            with open(f"{folder}/asked-{prompt}", "a") as f:
                f.write("x")
            with open(f"{folder}/asked-{prompt}") as f:
                n = len(f.read())
            if prompt == "p7" or n < 1 + int(prompt[1:]) % 3:
                raise RuntimeError(f"busy {n}")
            return prompt.upper()

        def close(self):
            open(f"{folder}/closed-{self.name}", "w").close()

    got = {r["batch_index"]: r for r in model.score_with_clients(batches, Client, workers=2, attempts=3, wait=0.01).collect()}
    assert len(got) == 40 and got[7]["reply"] is None and got[7]["error"] == "busy 3"
    assert all(r["reply"] == f"P{i}" and r["error"] is None and r["attempts"] == 1 + i % 3 for i, r in got.items() if i != 7)
    names = [f.name for f in tmp_path.iterdir()]
    assert sum(n.startswith("client-") for n in names) == sum(n.startswith("closed-") for n in names) == 2


def test_command_objects_and_options(spark):
    files = [
        '{"context_servers":[{"a":{"command":{"args":["x"],"extra":[1],"path":"p"}}}]}', '{"context_servers":[{"b":{"command":{"path":"p","args":["a]b","\\"]"]}}}]}',
        '{"context_servers":[{"c":{"command":{"path":"p","env":{"K":"v"}}}},{"c2":{"command":"plain","args":["q"]}}]}', '{"global":{"timeout":9},"servers":{"d":{"command":"w","options":{"detailed":true}}}}',
        '{"context_servers":[{"e":{"command":{"args":["no path"]}}}]}', "[]", "", None, "null", '{"command":{"path":"solo"}}',
    ]
    got = {r["name"]: r for r in readers.client_servers(spark.createDataFrame([(str(i), c) for i, c in enumerate(files)], "file string, content string")).collect()}
    assert {n: (r["command"], r["args"]) for n, r in got.items()} == {"a": ("p", ["x"]), "b": ("p", ["a]b", '"]']), "c": ("p", None), "c2": ("plain", ["q"]), "d": ("w", None), "zencoder": ("solo", None)}
    assert (got["d"]["timeout"], got["d"]["detailed"], got["a"]["timeout"]) == (9, True, None)
    assert got["a"]["description"] == "Command: p x"


def test_documents_and_reports_larger_than_a_row(spark, tmp_path):
    import json

    table = spark.range(3000).selectExpr("'s' AS server", "'tool' AS item_type", "concat('t', id div 2) AS item_id", "'n' AS name").unionByName(spark.createDataFrame([("e", "tool", "x", "n"), ("f", "tool", "y", "n")], "server string, item_type string, item_id string, name string"))
    found = spark.range(700).selectExpr("'s' AS server", "'yara_rules' AS scan_type", "'tool' AS target_type", "concat('t', id) AS item_id", "'n' AS target_name", "'X' AS finding_type", "if(id % 2 = 0, 'HIGH', 'LOW') AS severity", "concat('m', id) AS message")
    writers.write_nested_lines(table, found, str(tmp_path / "nested"))
    written = lambda name: "\n".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")) if f.stat().st_size)
    decoder, text, documents = json.JSONDecoder(), written("nested"), []
    while text.strip():
        document, end = decoder.raw_decode(text.lstrip())
        documents, text = documents + [document], text.lstrip()[end:]
    assert [(d["server"], len(d["items"]), d["summary"]["total_issues"]) for d in documents] == [("e", 1, 0), ("f", 1, 0), ("s", 3000, 700)]
    writers.write_wrapped_lines(table, found, str(tmp_path / "wrapped"), 'a "quoted" type')
    whole = json.loads(written("wrapped"))
    assert (whole["scan_type"], whole["total_servers"]) == ('a "quoted" type', 3) and whole["results"] == documents
    scans = spark.createDataFrame([("e", "Failed", " down "), ("f", "Success", None), ("s", "Success", None)], "server string, status string, status_detail string")
    writers.write_reports(scans, table, found, str(tmp_path / "reports"))
    reports = "\n".join(x for x in written("reports").split("\n"))
    whole = {r["server"]: r["report"] for r in results.report_markdown(scans, table, found).collect()}
    squeezed = lambda t: [x for x in t.split("\n") if x]
    assert squeezed(reports) == [x for s in "efs" for x in squeezed(whole[s])]
    assert whole["s"].count("- **") == 700
    assert results.report_markdown(scans, table, found, lines=100).where("server = 's'").first()["report"].count("- **") == 100


def test_a_date_is_written_again(spark, tmp_path):
    rows = lambda *s: spark.createDataFrame([("s", x) for x in s], "server string, severity string")
    path = str(tmp_path / "dated")
    held = lambda: sorted((str(r["scan_date"]), r["severity"]) for r in spark.read.parquet(path).collect())
    writers.write_findings(rows("A", "B"), path, "2026-01-01")
    writers.write_findings(rows("C"), path, "2026-01-02")
    writers.write_findings(rows("A", "D"), path, "2026-01-01")
    assert held() == [("2026-01-01", "A"), ("2026-01-01", "D"), ("2026-01-02", "C")]
    writers.write_findings(rows("A").limit(0), path, "2026-01-01")
    assert held() == [("2026-01-02", "C")]
    writers.write_findings(rows("E"), path, "2026-01-02", mode="append")
    assert held() == [("2026-01-02", "C"), ("2026-01-02", "E")]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"result":{"tools":[{"name":"x","inputSchema":{"a":1}},{"description":"d"}]}}')
    (tmp_path / "b.json").write_text("not json")
    got = readers.read_manifests(spark, str(tmp_path), "tools").collect()
    assert sorted((r["name"] or "", r["error"] or "") for r in got) == [("", "no tools array"), ("unknown", ""), ("x", "")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "mcp.json").write_text('{"mcpServers":{"one":{"command":"npx","args":["y"]},"off":{"url":"http://x","disabled":true}}}')
    servers = readers.read_client_configs(spark, str(tmp_path / "c")).collect()
    assert [(r["name"], r["command"], r["args"]) for r in servers] == [("one", "npx", ["y"])]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "s.json").write_text('{"url":"u","snapshots":[{"timestamp":"2026-01-01T00:00:00Z","tools":[],"tool_count":0}]}')
    row = readers.read_snapshots(spark, str(tmp_path / "h")).first()
    assert row["version_hash"].startswith("e3b0c442") and row["tool_count"] == 0
    table = spark.createDataFrame([("s", "tool", "1", "n")], "server string, item_type string, item_id string, name string")
    found = spark.createDataFrame([("s", "yara_rules", "tool", "1", "n", "X", "HIGH", "m")], "server string, scan_type string, target_type string, item_id string, target_name string, finding_type string, severity string, message string")
    writers.write_findings(found, str(tmp_path / "out"), "2026-01-01")
    assert spark.read.parquet(str(tmp_path / "out")).first()["severity"] == "HIGH"
    writers.write_nested(table, found, str(tmp_path / "nested"))
    assert '"rule_issues":1' in spark.read.text(str(tmp_path / "nested")).first()[0]


def test_severity_order(spark):
    found = spark.createDataFrame([("a", s) for s in ("LOW", None, "CRITICAL", "MEDIUM", "HIGH")], "server string, severity string").withColumn("item_id", F.lit("i")).withColumn("finding_type", F.lit("f"))
    assert [r["severity"] for r in results.sort_by_severity(found).collect()][:3] == ["CRITICAL", "HIGH", "MEDIUM"]
    assert results.sort_by_severity(found, k=2).count() == 2
    assert items.filter_findings(found, "HIGH", type_column="finding_type").count() == 2
