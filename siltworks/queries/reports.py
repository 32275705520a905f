"""Queries that write findings as tools' reports and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import plain
from siltworks.sources import reports as R
from siltworks.session import table, widen_first


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen_first(table(spark, sf_dir, "findings").select(F.col("finding_id").alias("report_id"), "severity", "rule_id", "file", "line", "message"))


def report_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    one = F.struct(F.col("rule_id").alias("check_id"), F.col("file").alias("path"), F.struct("line").alias("start"), F.struct("message", "severity").alias("extra"))
    return R.parse_json(f.select("report_id", F.to_json(F.struct(F.array(one).alias("results"), F.array().cast("array<string>").alias("errors"))).alias("body")), R.JSON_FORMATS["semgrep"])


def report_eslint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    m = F.struct(F.col("rule_id").alias("ruleId"), F.pmod("report_id", F.lit(4)).alias("severity"), "line", "message")
    return R.parse_json(f.select("report_id", F.to_json(F.array(F.struct(F.col("file").alias("filePath"), F.array(m).alias("messages")))).alias("body")), R.JSON_FORMATS["eslint"])


def report_generic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in four shapes, every seventh of which is cut off and gives nothing."""
    f = _findings(spark, sf_dir)
    k = F.pmod("report_id", F.lit(4))
    plain = F.to_json(F.array(F.struct("file", "line", F.col("rule_id").alias("rule"), "message", "severity")))
    issues = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("path"), F.col("line").alias("start_line"), F.col("rule_id").alias("code"), F.col("message").alias("msg"), F.col("severity").alias("level"))).alias("issues")))
    found = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("filename"), F.col("line").cast("string").alias("line"), F.col("rule_id").alias("id"), F.col("message").alias("text"))).alias("findings")))
    other = F.to_json(F.struct(F.array(F.struct("file")).alias("elsewhere")))
    body = F.when(k == 0, plain).when(k == 1, issues).when(k == 2, found).otherwise(other)
    cut = F.when(F.pmod("report_id", F.lit(7)) == 0, F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body"))
    return R.parse_json(f.select("report_id", body.alias("body")).select("report_id", cut.alias("body")), R.JSON_FORMATS["generic"])


def report_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    line = F.concat(F.lit("checked 1 file\n"), F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("line", F.lit(0)), F.lit(":1: E"), F.pmod("report_id", F.lit(900)), F.lit("  "), "message", F.lit("\r\n"))
    return R.parse_flake8(f.select("report_id", line.alias("body")))


def report_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attr = lambda n, c: F.concat(F.lit(f' {n}="'), safe(c), F.lit('"'))
    body = F.concat(F.lit("<checkstyle><file"), attr("name", F.col("file")), F.lit("><error"), attr("line", F.col("line").cast("string")), attr("severity", F.trim("severity")), attr("message", F.col("message")), attr("source", F.col("rule_id")), F.lit("/></file></checkstyle>"))
    return R.parse_checkstyle(f.select("report_id", body.alias("body")))


def report_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool runs as streams of test events."""
    runs = table(spark, sf_dir, "tool_results").select(F.col("run_id").alias("report_id"), "tool", "repo", "status", "reason")
    event = lambda action: F.to_json(F.struct(action.alias("Action"), F.col("repo").alias("Package"), F.col("tool").alias("Test"), F.col("reason").alias("Output")))
    last = F.when(F.col("status") == "tool_failed", F.lit("FAIL")).otherwise("pass")
    return R.parse_go_test(runs.select("report_id", F.concat_ws("\n", event(F.lit("run")), F.lit("no event"), event(last)).alias("body")))


#: the formats that no other query reads, by the rest of an id
FORMATS = (
    "gitleaks", "ruff", "golangci", "osv", "pip_audit", "gocyclo", "dupl", "clang_tidy", "dart_analyze", "cargo", "govulncheck", "npm_audit", "cppcheck", "phpcpd", "trx", "junit",
    "composer_audit", "lizard", "scalastyle", "bundler_audit",
)


def report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding as a report in one of twenty formats, all read in one go."""
    word = lambda c, keep: F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{keep}]", "")
    f = widen_first(table(spark, sf_dir, "findings").select("finding_id", "tool", "file", "line", "rule_id", "message", "severity")).select(
        F.col("finding_id").alias("report_id"), "tool", plain(F.col("file")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"), F.concat(F.lit("R"), word(F.col("rule_id"), "A-Za-z0-9._-")).alias("r"),
        F.concat(F.lit("m"), F.trim(word(F.col("message"), "A-Za-z0-9 "))).alias("m"), F.concat(F.lit("s"), F.lower(word(F.col("severity"), "A-Za-z"))).alias("s"),
    )
    c, lit, obj = F.col, F.lit, lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    js = lambda x: F.to_json(x)
    attr = lambda n, v: F.concat(lit(f' {n}="'), v.cast("string"), lit('"'))
    xml = lambda *parts: F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])
    ccn, ncss = F.pmod("report_id", lit(31)), F.pmod("report_id", lit(57))
    body = {
        "gitleaks": js(F.array(obj(File=c("f"), StartLine=c("l"), RuleID=c("r"), Description=c("m")))),
        "ruff": js(F.array(obj(filename=c("f"), location=obj(row=c("l")), code=c("r"), message=c("m")))),
        "golangci": js(obj(Issues=F.array(obj(FromLinter=c("r"), Text=c("m"), Severity=c("s"), Pos=obj(Filename=c("f"), Line=c("l")))))),
        "osv": js(obj(results=F.array(obj(source=obj(path=c("f")), vulnerabilities=F.array(obj(id=c("r"), summary=c("m"))))))),
        "pip_audit": js(obj(dependencies=F.array(obj(name=c("tool"), vulns=F.array(obj(id=c("r"), description=c("m"))))))),
        "gocyclo": xml(c("m"), "\n\n"), "dupl": xml(c("m"), "\r\n"),
        "clang_tidy": xml("noise\n", c("f"), ":", c("l"), ":1: warning: ", c("m"), " [", c("r"), "]\n"), "dart_analyze": xml("short|1\n", c("f"), "|", c("l"), "|1|", F.upper("s"), "|", c("m")),
        "cargo": xml('{"reason": "other"}\n', js(obj(reason=lit("compiler-message"), message=obj(level=lit("error"), code=obj(code=c("r")), message=c("m"), spans=F.array(obj(file_name=c("f"), line_start=c("l"))))))),
        "govulncheck": xml('{"config": 1}\n', js(obj(osv=c("r")))),
        "npm_audit": js(obj(advisories=F.create_map(lit("1"), obj(module_name=c("tool"), id=c("r"), title=c("m"), severity=c("s"))))),
        "cppcheck": xml("<results><errors><error", attr("id", c("r")), attr("severity", c("s")), attr("msg", c("m")), "><location", attr("file", c("f")), attr("line", c("l")), "/></error></errors></results>"),
        "phpcpd": xml("<pmd><duplication", attr("lines", c("l")), "><file", attr("path", c("f")), attr("line", c("l")), "/></duplication></pmd>"),
        "trx": xml('<TestRun xmlns="urn:x"><Results><UnitTestResult outcome="Failed"', attr("testName", c("m")), "/></Results></TestRun>"),
        "junit": xml("<testsuite><testcase", attr("classname", c("tool")), attr("name", c("r")), "><failure", attr("message", c("m")), "/></testcase></testsuite>"),
        "composer_audit": js(obj(advisories=F.create_map(c("tool"), F.array(obj(cve=c("r"), title=c("m"), severity=c("s")))))),
        "lizard": xml('<cppncss><measure type="Function"><item', attr("name", xml(c("m"), "() at ./", c("f"), ":", c("l"))), "><value>1</value><value>", ncss, "</value><value>", ccn, "</value></item></measure></cppncss>"),
        "scalastyle": xml("<checkstyle><file", attr("name", c("f")), "><error", attr("line", c("l")), attr("severity", c("s")), attr("message", c("m")), attr("source", c("r")), "/></file></checkstyle>"),
        "bundler_audit": js(F.array(obj(file=c("f"), line=c("l"), rule=c("r"), message=c("m"), severity=c("s")))),
    }
    k = F.pmod("report_id", lit(len(FORMATS))).cast("int")
    made, name = lit(None).cast("string"), lit(None).cast("string")
    for i, n in enumerate(FORMATS):
        made, name = F.when(k == i, body[n]).otherwise(made), F.when(k == i, n).otherwise(name)
    return R.parse_reports(f.select("report_id", name.alias("format"), made.alias("body")))


def report_test_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool runs as test reports of two suites, whose totals are summed."""
    runs = table(spark, sf_dir, "tool_results").select(F.col("run_id").alias("report_id"), F.coalesce("exit_code", F.lit(0)).alias("e"), F.pmod("run_id", F.lit(9)).alias("k"))
    suite = lambda *v: F.concat(F.lit("<testsuite"), *[x for n, c in zip(("tests", "failures", "errors", "skipped"), v, strict=True) for x in (F.lit(f' {n}="'), c.cast("string"), F.lit('"'))], F.lit("/>"))
    k, e = F.col("k"), F.col("e")
    body = F.concat(F.lit("<testsuites>"), suite(k + 5, k, F.lit("x"), F.lit(1)), suite(F.lit(3), e, F.lit(2), k), F.lit("</testsuites>"))
    return R.junit_totals(runs.select("report_id", body.alias("body")))


def report_go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool runs as module streams."""
    runs = table(spark, sf_dir, "tool_results").select(F.col("run_id").alias("report_id"), F.to_json(F.struct(F.col("tool").alias("Path"))).alias("t"), F.to_json(F.struct(F.col("evidence_class").alias("Path"))).alias("c"))
    return R.go_modules(runs.select("report_id", F.concat_ws("\n", "t", "c", F.lit("no object"), "t", F.lit("{}")).alias("body")))


def queries() -> dict:
    return {q.__name__: q for q in (report_json_parse, report_eslint_parse, report_generic_parse, report_text_parse, report_xml_parse, report_stream_parse, report_formats, report_test_totals, report_go_modules)}


def oracle_sql() -> dict:
    path = "coalesce(ltrim(replace(file, '\\', '/'), './'), '') AS file"
    e = lambda c, d: f"coalesce(nullif({c}, ''), '{d}')"
    base = f"SELECT finding_id AS report_id, lower({e('severity', 'unknown')}) AS severity, {e('rule_id', 'unknown')} AS rule_id, {path}, coalesce(line, 0)::INT AS line, {e('message', 'Finding.')} AS message FROM findings"
    word = lambda c, keep: f"regexp_replace(coalesce({c}, ''), '[^{keep}]', '', 'g')"
    at = {n: i for i, n in enumerate(FORMATS)}
    some = lambda *names: "k IN (" + ", ".join(str(at[n]) for n in names) + ")"
    high, fixed = some("gitleaks", "osv", "pip_audit", "govulncheck"), some("gocyclo", "dupl", "phpcpd", "lizard")
    formats = f"""WITH b AS (SELECT finding_id AS report_id, tool, finding_id % {len(FORMATS)} AS k, {path.replace(' AS file', ' AS f')}, coalesce(line, 0)::INT AS l, 'R' || {word('rule_id', 'A-Za-z0-9._-')} AS r, 'm' || trim({word('message', 'A-Za-z0-9 ')}) AS m, 's' || lower({word('severity', 'A-Za-z')}) AS s FROM findings)
        SELECT report_id, CASE WHEN {high} THEN 'high' WHEN {fixed} THEN 'info' WHEN {some('ruff', 'clang_tidy')} THEN 'warning' WHEN {some('cargo', 'trx', 'junit')} THEN 'error' ELSE s END AS severity,
          CASE WHEN {some('gocyclo')} THEN 'cyclomatic' WHEN {some('dupl')} THEN 'dup_block' WHEN {some('dart_analyze')} THEN 'dart-analyze' WHEN {some('phpcpd')} THEN 'duplication' WHEN {some('trx', 'junit')} THEN 'test_failure' WHEN {some('lizard')} THEN 'complexity_hotspot' ELSE r END AS rule_id,
          CASE WHEN {some('gocyclo', 'dupl', 'govulncheck', 'trx')} THEN '' WHEN {some('pip_audit', 'npm_audit', 'junit', 'composer_audit')} THEN tool ELSE f END AS file,
          CASE WHEN {some('osv', 'pip_audit', 'gocyclo', 'dupl', 'govulncheck', 'npm_audit', 'trx', 'junit', 'composer_audit')} THEN 0 ELSE l END AS line,
          CASE WHEN {some('govulncheck')} THEN 'Go vulnerability reported.' WHEN {some('phpcpd')} THEN 'duplicated block lines=' || l WHEN {some('junit')} THEN tool || '::' || r || ': ' || m WHEN {some('lizard')} THEN 'CCN=' || (report_id % 31) || ' NCSS=' || (report_id % 57) || ' ' || m || '()' ELSE m END AS message FROM b"""
    return {
        "report_formats": formats,
        "report_test_totals": "SELECT run_id AS report_id, (run_id % 9 + 8)::BIGINT AS tests, (run_id % 9 + coalesce(exit_code, 0))::BIGINT AS failures, 2::BIGINT AS errors, (run_id % 9 + 1)::BIGINT AS skipped FROM tool_results",
        "report_go_modules": "SELECT run_id AS report_id, tool AS path, 2 AS entries FROM tool_results UNION ALL SELECT run_id, evidence_class, 1 FROM tool_results",
        "report_json_parse": base,
        "report_eslint_parse": f"SELECT finding_id AS report_id, CASE finding_id % 4 WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 0 THEN 'info' ELSE '3' END AS severity, {e('rule_id', 'eslint')} AS rule_id, {path}, coalesce(line, 0)::INT AS line, {e('message', 'ESLint issue.')} AS message FROM findings",
        "report_generic_parse": f"""SELECT finding_id AS report_id, CASE WHEN finding_id % 4 = 2 THEN 'unknown' ELSE lower({e('severity', 'unknown')}) END AS severity, {e('rule_id', 'unknown')} AS rule_id, {path}, coalesce(line, 0)::INT AS line, {e('message', 'Finding.')} AS message
            FROM findings WHERE finding_id % 4 < 3 AND finding_id % 7 <> 0""",
        "report_text_parse": "SELECT finding_id AS report_id, 'warning' AS severity, 'E' || (finding_id % 900) AS rule_id, coalesce(ltrim(replace(file, '\\', '/'), './'), '') AS file, coalesce(line, 0)::INT AS line, trim(message) AS message FROM findings",
        "report_xml_parse": f"SELECT finding_id AS report_id, lower({e('trim(severity)', 'warning')}) AS severity, {e('rule_id', 'checkstyle')} AS rule_id, {path}, coalesce(line, 0)::INT AS line, {e('message', 'Checkstyle issue.')} AS message FROM findings",
        "report_stream_parse": "SELECT run_id AS report_id, 'error' AS severity, 'test_fail' AS rule_id, repo AS file, 0::INT AS line, trim(repo || '::' || tool || ' ' || trim(coalesce(reason, ''))) AS message FROM tool_results WHERE status = 'tool_failed'",
    }
