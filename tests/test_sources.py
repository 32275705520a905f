import pandas as pd
from pyspark.sql import functions as F

from siltworks.operators import model as M
from siltworks.operators.activation import group_plan
from siltworks.sources.files import looks_binary, read_tree, with_text
from siltworks.sources.inventories import lock_entries, npm_tree
from siltworks.sources.reports import junit_totals, parse_reports


def test_trees(spark, tmp_path):
    root = tmp_path / "build" / "a+b"
    for name, data in {"x.py": "é = 1".encode(), "d/y": b"a\x00b", "d/z": b"ok", "node_modules/m.js": b"", "e.png": b"text", "latin": "é".encode("latin-1") * 9, "empty": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r["path"]: r["text"] for r in with_text(read_tree(spark, str(root))).collect()}
    assert got == {"x.py": "é = 1", "d/y": None, "d/z": "ok", "e.png": None, "latin": None}


def test_binary_texts(spark):
    df = spark.createDataFrame([("a\x00",), ("\x01" * 3 + "a" * 97,), ("\x01" + "a" * 99,), ("a\r\n\t",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(looks_binary(F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_inventories(spark):
    df = spark.createDataFrame([(1, "lockfile: 7\n  a-b@1.0:\n    x: y@2\n  c@2.1.0:\r\n"), (2, None), (3, "a@b.c")], "id int, t string")
    assert sorted(tuple(r) for r in lock_entries(df, "id", "t").collect()) == [(1, "a-b", "1.0"), (1, "c", "2.1.0")]
    tree = spark.createDataFrame([(1, '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": 2}}}, "c": null}}'), (2, "{"), (3, None), (4, "[]")], "report_id int, body string")
    assert sorted(tuple(r) for r in npm_tree(tree).collect()) == [(1, "a", "1", 1), (1, "b", "2", 2), (1, "c", None, 1)]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, None)], "id int, prompt string").withColumn("key", M.request_key(["prompt"]))
    recorded = asked.where("id = 1").select("key", F.lit("old").alias("answer"))
    got = {r["id"]: (r["answer"], r["source"]) for r in M.answer(asked, recorded, "key", lambda s: s.map(lambda p: None if p is None or pd.isna(p) else p.upper())).collect()}
    assert got == {1: ("old", "recorded"), 2: ("Q", "model"), 3: ("Q", "model"), 4: (None, "none")}
    assert {r["source"] for r in M.answer(asked, recorded, "key").collect()} == {"recorded", "none"}


def test_plan_defaults(spark):
    groups = spark.createDataFrame([("A", "A1"), ("A", "A2"), ("B", "B1")], "module_id string, group_id string")
    modules = spark.createDataFrame([("r", "A", True, 0.9), ("r", "B", None, None)], "repo string, module_id string, enabled boolean, confidence double")
    own = spark.createDataFrame([("r", "A", "A2", False, 0.1)], "repo string, module_id string, group_id string, enabled boolean, confidence double")
    assert sorted(tuple(r) for r in group_plan(groups, modules, own).collect()) == [("r", "A", "A1", True, 0.9, False), ("r", "A", "A2", False, 0.1, True), ("r", "B", "B1", True, 0.5, False)]


def test_more_report_formats(spark):
    rows = [
        (1, "gocyclo", "9 pkg f x.go:1\n\n"), (2, "dupl", "a\n" * 40), (3, "clang_tidy", "x.c:3:1: warning: bad [k-1]\nnoise"), (4, "clang_tidy", "only noise"),
        (5, "dart_analyze", "l.dart|7|1|ERROR|m|n|code\nshort|1"), (6, "cargo", '{"reason": "compiler-message", "message": {"level": "error", "code": {"code": "E1"}, "message": "m", "spans": [{"file_name": "s.rs", "line_start": 4}]}}\n{"reason": "other"}'),
        (7, "govulncheck", '{"osv": "GO-1"}\n{"config": 1}'), (8, "npm_audit", '{"vulnerabilities": {"p": {"severity": "HIGH", "via": [{"source": 5, "title": "t"}]}, "q": {"via": ["p"]}}, "advisories": {"9": {"module_name": "m", "id": 9}}}'),
        (9, "cppcheck", '<results><errors><error id="u" severity="error" msg="m"><location file="a.c" line="2"/></error></errors></results>'),
        (10, "phpcpd", '<pmd><duplication lines="9"><file path="a.php" line="1"/><file path="b.php" line="5"/></duplication></pmd>'),
        (11, "trx", '<TestRun xmlns="urn:x"><Results><UnitTestResult outcome="Failed" testName="T"/><UnitTestResult outcome="Passed" testName="U"/></Results></TestRun>'), (12, "cargo", "{"), (13, "npm_audit", "[]"),
    ]
    got = sorted(tuple(r) for r in parse_reports(spark.createDataFrame(rows, "report_id int, format string, body string")).collect())
    assert sum(r[0] == 2 for r in got) == 25
    assert [r for r in got if r[0] != 2] == [
        (1, "info", "cyclomatic", "", 0, "9 pkg f x.go:1"), (3, "warning", "k-1", "x.c", 3, "bad"), (4, "info", "clang-tidy", "", 0, "only noise"), (5, "error", "dart-analyze", "l.dart", 7, "m|n|code"),
        (6, "error", "E1", "s.rs", 4, "m"), (7, "high", "GO-1", "", 0, "Go vulnerability reported."), (8, "high", "5", "p", 0, "t"), (8, "unknown", "9", "m", 0, "npm advisory"), (8, "unknown", "p", "q", 0, "npm vulnerability"),
        (9, "error", "u", "a.c", 2, "m"), (10, "info", "duplication", "a.php", 1, "duplicated block lines=9"), (10, "info", "duplication", "b.php", 5, "duplicated block lines=9"), (11, "error", "test_failure", "", 0, "T"),
    ]


def test_complexity_reports(spark):
    items = [("f(a, b) at .\\\\p\\\\x.py:7", 4, 9), ("g at p/y.py:2", 8, 9), ("odd name", 1, 30), ("short", 1, None)]
    xml = '<cppncss><measure type="File"/><measure type="Function">' + "".join(f'<item name="{n}"><value>1</value><value>{s}</value>' + (f"<value>{c}</value>" if c else "") + "</item>" for n, s, c in items) + "</measure></cppncss>"
    df = spark.createDataFrame([(1, "lizard", xml), (2, "lizard", "<cppncss>"), (3, "lizard", None)], "report_id int, format string, body string")
    got = [tuple(r) for r in parse_reports(df).collect()]
    assert got == [(1, "info", "complexity_hotspot", f, n, m) for f, n, m in (("", 0, "CCN=30 NCSS=1 odd name"), ("p/y.py", 2, "CCN=9 NCSS=8 g"), ("p//x.py", 7, "CCN=9 NCSS=4 f(a, b)"))]


def test_totals_and_advisories(spark):
    df = spark.createDataFrame([(1, '<testsuite tests="4" failures="1"/>'), (2, None), (3, "<testsuites><testsuite/></testsuites>")], "report_id int, body string")
    assert sorted(tuple(r) for r in junit_totals(df).collect()) == [(1, 4, 1, 0, 0), (3, 0, 0, 0, 0)]
    rows = [(1, "composer_audit", '{"advisories": {"p/q": [{"link": "u"}, 7], "n": []}}'), (2, "composer_audit", '{"advisories": []}'), (3, "composer_audit", '{"issues": [{"file": "a"}], "advisories": {"p": [{"id": "i"}]}}')]
    got = sorted(tuple(r) for r in parse_reports(spark.createDataFrame(rows, "report_id int, format string, body string")).collect())
    assert got == [(1, "high", "u", "p/q", 0, "Composer advisory"), (3, "unknown", "unknown", "a", 0, "Finding.")]
