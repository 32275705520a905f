"""Tool reports in their own formats to one relation: report_id, severity, rule_id, file, line, message.

A report that can't be parsed gives no rows and fails no job. Elements without a message, rule or file get the
format's defaults; line is 0 where it is missing or no number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.paths import plain
from siltworks.functions.text import lines
from siltworks.session import scratch_path

#: Where reports of unknown tools keep their findings.
USUAL_KEYS = ("results", "issues", "findings", "warnings", "diagnostics", "problems", "vulnerabilities")


@dataclass(frozen=True)
class JsonFormat:
    """Where a JSON report keeps its elements and their parts: paths in order of preference.

    `inner` names a list within each element; paths beginning with ^ are then those of the outer element.
    """

    elements: tuple[str, ...] = ("$",)
    inner: str | None = None
    file: tuple[str, ...] = ("$.file", "$.path", "$.filename", "$.filePath")
    line: tuple[str, ...] = ("$.line", "$.start_line")
    rule: tuple[str, ...] = ("$.rule", "$.rule_id", "$.code", "$.check_id", "$.id")
    message: tuple[str, ...] = ("$.message", "$.msg", "$.text", "$.description")
    severity: tuple[str, ...] = ("$.severity", "$.level")
    no_severity: str = "unknown"
    no_rule: str = "unknown"
    no_message: str = "Finding."
    severity_words: tuple[tuple[str, str], ...] = ()


#: The shapes of public report formats.
JSON_FORMATS = {
    "generic": JsonFormat(elements=("$", *(f"$.{k}" for k in USUAL_KEYS))),
    "semgrep": JsonFormat(("$.results",), file=("$.path",), line=("$.start.line",), rule=("$.check_id",), message=("$.extra.message",), severity=("$.extra.severity",)),
    "gitleaks": JsonFormat(("$", "$.Leaks"), file=("$.File",), line=("$.StartLine", "$.Line"), rule=("$.RuleID",), message=("$.Description",), severity=("$.Severity",), no_severity="high", no_message="Potential secret."),
    "eslint": JsonFormat(("$",), "$.messages", file=("^$.filePath",), rule=("$.ruleId",), message=("$.message",), severity=("$.severity",), no_severity="info", no_rule="eslint", no_message="ESLint issue.", severity_words=(("1", "warning"), ("2", "error"), ("0", "info"))),
    "ruff": JsonFormat(("$",), file=("$.filename",), line=("$.location.row",), rule=("$.code",), message=("$.message",), severity=("$.severity",), no_severity="warning", no_rule="ruff"),
    "golangci": JsonFormat(("$.Issues",), file=("$.Pos.Filename",), line=("$.Pos.Line",), rule=("$.FromLinter",), message=("$.Text",), severity=("$.Severity",), no_severity="warning", no_rule="golangci"),
    "osv": JsonFormat(("$.results",), "$.vulnerabilities", file=("^$.source.path",), rule=("$.id",), message=("$.summary", "$.details"), severity=("$.none",), no_severity="high", no_rule="osv"),
    "pip_audit": JsonFormat(("$.dependencies", "$"), "$.vulns", file=("^$.name",), rule=("$.id",), message=("$.description",), severity=("$.none",), no_severity="high", no_rule="pip-audit"),
}


def parse_json(reports: DataFrame, fmt: JsonFormat, body: str = "body") -> DataFrame:
    """JSON reports (report_id and a text column) to findings."""
    get = F.try_variant_get
    first = lambda e, paths, kind="string": F.coalesce(*[get(e, p, kind) for p in paths])
    rows = reports.select("report_id", F.try_parse_json(body).alias("v")).where("v IS NOT NULL")
    rows = rows.select("report_id", F.explode(F.coalesce(*[get("v", p, "array<variant>") for p in fmt.elements])).alias("o"))
    rows = rows.select("report_id", "o", F.explode(get("o", fmt.inner, "array<variant>")).alias("e")) if fmt.inner else rows.withColumn("e", F.col("o"))
    rows = rows.where(F.schema_of_variant("e").startswith("OBJECT"))

    def part(paths: tuple[str, ...]) -> Column:
        found = [get("o" if p[0] == "^" else "e", p.lstrip("^"), "string") for p in paths]
        return F.coalesce(*[F.when(f != "", f) for f in found])

    word = F.lower(F.coalesce(part(fmt.severity), F.lit(fmt.no_severity)))
    severity = word
    for raw, meant in fmt.severity_words:
        severity = F.when(word == raw, meant).otherwise(severity)
    line = F.coalesce(*[get("e", p, "int") for p in fmt.line], F.lit(0))
    return rows.select("report_id", severity.alias("severity"), F.coalesce(part(fmt.rule), F.lit(fmt.no_rule)).alias("rule_id"), plain(part(fmt.file)).alias("file"), line.alias("line"), F.coalesce(part(fmt.message), F.lit(fmt.no_message)).alias("message"))


def parse_json_lines(reports: DataFrame, keep: Callable[[Column], Column], fields: dict[str, Callable[[Column], Column]], body: str = "body") -> DataFrame:
    """Reports of one JSON object a line: those that `keep` accepts, with the given fields; bad lines are passed over."""
    rows = reports.select("report_id", F.explode(lines(F.col(body))).alias("l")).select("report_id", F.try_parse_json("l").alias("e")).where("e IS NOT NULL")
    return rows.where(F.coalesce(keep(F.col("e")), F.lit(False))).select("report_id", *[f(F.col("e")).alias(n) for n, f in fields.items()])


def parse_go_test(reports: DataFrame, body: str = "body") -> DataFrame:
    """Failed tests of a stream of test events."""
    text = lambda e, p: F.coalesce(F.try_variant_get(e, p, "string"), F.lit(""))
    said = lambda e: F.trim(F.concat(text(e, "$.Package"), F.lit("::"), text(e, "$.Test"), F.lit(" "), F.trim(text(e, "$.Output"))))
    fields = {"severity": lambda e: F.lit("error"), "rule_id": lambda e: F.lit("test_fail"), "file": lambda e: text(e, "$.Package"), "line": lambda e: F.lit(0), "message": said}
    return parse_json_lines(reports, lambda e: F.lower(F.try_variant_get(e, "$.Action", "string")) == "fail", fields, body)


def parse_text(reports: DataFrame, pattern: str, parts: dict[str, int], severity: str, body: str = "body") -> DataFrame:
    """Text reports of a finding a line: `parts` gives the pattern's group of file, line, rule_id and message."""
    rows = reports.select("report_id", F.explode(lines(F.col(body))).alias("l")).select("report_id", F.trim("l").alias("l")).where(F.col("l").rlike(pattern))
    g = lambda n: F.regexp_extract("l", pattern, parts[n])
    return rows.select("report_id", F.lit(severity).alias("severity"), g("rule_id").alias("rule_id"), plain(g("file")).alias("file"), F.coalesce(g("line").try_cast("int"), F.lit(0)).alias("line"), g("message").alias("message"))


def parse_flake8(reports: DataFrame, body: str = "body") -> DataFrame:
    return parse_text(reports, r"^(.*?):(\d+):(\d+):\s*([A-Za-z]\d+)\s+(.*)$", {"file": 1, "line": 2, "rule_id": 4, "message": 5}, "warning", body)


def parse_checkstyle(reports: DataFrame, body: str = "body") -> DataFrame:
    """XML reports of files with errors."""
    schema = "file array<struct<_name string, error array<struct<_line string, _severity string, _message string, _source string>>>>"
    rows = reports.select("report_id", F.explode(F.from_xml(body, schema, {"mode": "PERMISSIVE"})["file"]).alias("f"))
    rows = rows.select("report_id", F.col("f._name").alias("file"), F.explode("f.error").alias("e"))
    or_else = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))
    return rows.select("report_id", F.lower(or_else("e._severity", "warning")).alias("severity"), or_else("e._source", "checkstyle").alias("rule_id"), plain(F.col("file")).alias("file"), F.coalesce(F.col("e._line").try_cast("int"), F.lit(0)).alias("line"), or_else("e._message", "Checkstyle issue.").alias("message"))


def parse_junit(reports: DataFrame, body: str = "body") -> DataFrame:
    """Failed and broken test cases of XML test reports, whether or not suites are nested in one more element."""
    case = "array<struct<_classname string, _name string, failure array<struct<_message string>>, error array<struct<_message string>>>>"
    suite = f"array<struct<testcase {case}>>"
    x = F.from_xml(body, f"testsuite {suite}, testcase {case}", {"mode": "PERMISSIVE"})
    cases = F.concat(F.coalesce(F.flatten(F.transform(x["testsuite"], lambda s: F.coalesce(s["testcase"], F.array().cast(case)))), F.array().cast(case)), F.coalesce(x["testcase"], F.array().cast(case)))
    rows = reports.select("report_id", F.explode(cases).alias("c")).select("report_id", "c", F.concat(F.coalesce("c.failure", F.array().cast("array<struct<_message string>>")), F.coalesce("c.error", F.array().cast("array<struct<_message string>>"))).alias("bad")).where(F.size("bad") > 0)
    name = F.concat_ws("::", F.col("c._classname"), F.col("c._name"))
    return rows.select("report_id", F.lit("error").alias("severity"), F.lit("test_failure").alias("rule_id"), F.coalesce("c._classname", F.lit("")).alias("file"), F.lit(0).alias("line"), F.concat_ws(": ", name, F.element_at("bad", 1)["_message"]).alias("message"))


def parse_lines(reports: DataFrame, rule: str, most: int | None = None, body: str = "body") -> DataFrame:
    """Each line with anything in it as a note; of each report the first `most`."""
    said = F.filter(F.transform(lines(F.col(body)), F.trim), lambda x: x != "")
    rows = reports.select("report_id", F.explode(said if most is None else F.slice(said, 1, most)).alias("message"))
    return rows.select("report_id", F.lit("info").alias("severity"), F.lit(rule).alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("line"), "message")


def parse_clang_tidy(reports: DataFrame, body: str = "body") -> DataFrame:
    """Compiler-style lines; a report without one gives its first 25 lines as notes."""
    pattern = r"(?i)^(.*?):(\d+):(\d+):\s*(warning|error|note):\s*(.*?)(?:\s*\[([^\]]*)\])?$"
    rows = reports.select("report_id", F.explode(lines(F.col(body))).alias("l")).select("report_id", F.trim("l").alias("l")).where(F.col("l").rlike(pattern))
    g = lambda i: F.regexp_extract("l", pattern, i)
    out = rows.select("report_id", F.lower(g(4)).alias("severity"), F.when(g(6) != "", g(6)).otherwise("clang-tidy").alias("rule_id"), plain(g(1)).alias("file"), F.coalesce(g(2).try_cast("int"), F.lit(0)).alias("line"), g(5).alias("message"))
    bare = reports.where(~F.exists(F.coalesce(lines(F.col(body)), F.array().cast("array<string>")), lambda l: F.trim(l).rlike(pattern)))
    return out.unionByName(parse_lines(bare, "clang-tidy", 25, body))


def parse_dart(reports: DataFrame, body: str = "body") -> DataFrame:
    """Lines file|line|column|severity|message|code."""
    rows = reports.select("report_id", F.explode(lines(F.col(body))).alias("l")).select("report_id", F.split("l", r"\|").alias("p")).where(F.size("p") >= 5)
    at = lambda i: F.get("p", F.lit(i))
    return rows.select("report_id", F.lower(F.when(at(3) != "", at(3)).otherwise("info")).alias("severity"), F.lit("dart-analyze").alias("rule_id"), plain(at(0)).alias("file"), F.coalesce(at(1).try_cast("int"), F.lit(0)).alias("line"), F.trim(F.array_join(F.slice("p", 5, 1_000), "|")).alias("message"))


def _text(e: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in (F.try_variant_get(e, p, "string") for p in paths)])


def parse_cargo(reports: DataFrame, body: str = "body") -> DataFrame:
    """Compiler messages of a build's stream of events, at their first span."""
    fields = {
        "severity": lambda e: F.when(F.lower(_text(e, "$.message.level")) == "error", "error").otherwise("warning"),
        "rule_id": lambda e: F.coalesce(_text(e, "$.message.code.code"), F.lit("rustc")),
        "file": lambda e: plain(_text(e, "$.message.spans[0].file_name")),
        "line": lambda e: F.coalesce(F.try_variant_get(e, "$.message.spans[0].line_start", "int"), F.lit(0)),
        "message": lambda e: F.coalesce(_text(e, "$.message.message"), F.lit("Rust compiler message.")),
    }
    return parse_json_lines(reports, lambda e: _text(e, "$.reason") == "compiler-message", fields, body)


def parse_govulncheck(reports: DataFrame, body: str = "body") -> DataFrame:
    """Vulnerabilities named in a stream of events."""
    keys = ("$.Vuln", "$.vuln", "$.OSV", "$.osv")
    held = lambda e: F.coalesce(*[F.try_variant_get(e, k, "variant") for k in keys]).isNotNull()
    fields = {"severity": lambda e: F.lit("high"), "rule_id": lambda e: F.coalesce(_text(e, *keys), F.lit("govuln")), "file": lambda e: F.lit(""), "line": lambda e: F.lit(0), "message": lambda e: F.lit("Go vulnerability reported.")}
    return parse_json_lines(reports, held, fields, body)


def parse_npm_audit(reports: DataFrame, body: str = "body") -> DataFrame:
    """Vulnerable packages, keyed by name, and advisories of older reports."""
    rows = reports.select("report_id", F.try_parse_json(body).alias("v")).where("v IS NOT NULL")
    each = lambda path: rows.select("report_id", F.explode(F.map_entries(F.try_variant_get("v", path, "map<string, variant>"))).alias("x")).select("report_id", F.col("x.key").alias("k"), F.col("x.value").alias("e"))
    e = F.col("e")
    via, first = F.try_variant_get(e, "$.via[0]", "string"), lambda *p: _text(e, *p)
    nested = F.schema_of_variant(F.try_variant_get(e, "$.via[0]", "variant")).startswith("OBJECT")
    v = each("$.vulnerabilities").select(
        "report_id", F.lower(F.coalesce(first("$.severity"), F.lit("unknown"))).alias("severity"),
        F.when(nested, F.coalesce(first("$.via[0].source", "$.via[0].name"), F.lit("advisory"))).otherwise(F.coalesce(via, F.lit("npm-audit"))).alias("rule_id"), F.col("k").alias("file"), F.lit(0).alias("line"),
        F.when(nested, F.coalesce(first("$.via[0].title", "$.via[0].name"), F.lit("npm advisory"))).otherwise("npm vulnerability").alias("message"),
    )
    a = each("$.advisories").select(
        "report_id", F.lower(F.coalesce(first("$.severity"), F.lit("unknown"))).alias("severity"), F.coalesce(first("$.cve", "$.id", "$.url"), F.lit("advisory")).alias("rule_id"),
        F.coalesce(first("$.module_name", "$.name"), F.lit("")).alias("file"), F.lit(0).alias("line"), F.coalesce(first("$.title", "$.overview"), F.lit("npm advisory")).alias("message"),
    )
    return v.unionByName(a)


def _xml(reports: DataFrame | None, body: str, schema: str) -> Column:
    return F.from_xml(body, schema, {"mode": "PERMISSIVE"})


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.when(c != "", c), F.lit(other))


def parse_cppcheck(reports: DataFrame, body: str = "body") -> DataFrame:
    x = _xml(reports, body, "errors struct<error array<struct<_id string, _severity string, _msg string, _verbose string, location array<struct<_file string, _line string>>>>>")
    rows = reports.select("report_id", F.explode(x["errors"]["error"]).alias("e"))
    loc = F.get("e.location", F.lit(0))
    return rows.select("report_id", F.lower(_or(F.col("e._severity"), "warning")).alias("severity"), _or(F.col("e._id"), "cppcheck").alias("rule_id"), plain(loc["_file"]).alias("file"), F.coalesce(loc["_line"].try_cast("int"), F.lit(0)).alias("line"), _or(F.coalesce(F.when(F.col("e._msg") != "", F.col("e._msg")), F.col("e._verbose")), "Cppcheck issue.").alias("message"))


def parse_phpcpd(reports: DataFrame, body: str = "body") -> DataFrame:
    """One note per file of each duplicated block."""
    x = _xml(reports, body, "duplication array<struct<_lines string, file array<struct<_path string, _line string>>>>")
    rows = reports.select("report_id", F.explode(x["duplication"]).alias("d")).select("report_id", F.col("d._lines").alias("n"), F.explode("d.file").alias("f"))
    return rows.select("report_id", F.lit("info").alias("severity"), F.lit("duplication").alias("rule_id"), plain(F.col("f._path")).alias("file"), F.coalesce(F.col("f._line").try_cast("int"), F.lit(0)).alias("line"), F.concat(F.lit("duplicated block lines="), F.coalesce("n", F.lit(""))).alias("message"))


def parse_trx(reports: DataFrame, body: str = "body") -> DataFrame:
    """Failed tests of result files, whatever namespace they name."""
    bare = F.regexp_replace(F.regexp_replace(F.col(body), r"\s+xmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    x = F.from_xml(bare, "Results struct<UnitTestResult array<struct<_outcome string, _testName string>>>", {"mode": "PERMISSIVE"})
    rows = reports.select("report_id", F.explode(x["Results"]["UnitTestResult"]).alias("r")).where(F.lower("r._outcome") == "failed")
    return rows.select("report_id", F.lit("error").alias("severity"), F.lit("test_failure").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("line"), F.coalesce("r._testName", F.lit("")).alias("message"))


def parse_composer_audit(reports: DataFrame, body: str = "body") -> DataFrame:
    """As generic; of a report that has nothing there, the advisories by package."""
    usual = parse_json(reports, JSON_FORMATS["generic"], body)
    rows = reports.select("report_id", F.try_parse_json(body).alias("v")).where("v IS NOT NULL")
    each = rows.select("report_id", F.explode(F.map_entries(F.try_variant_get("v", "$.advisories", "map<string, array<variant>>"))).alias("x")).select("report_id", F.col("x.key").alias("k"), F.explode("x.value").alias("e"))
    e = F.col("e")
    found = each.where(F.schema_of_variant("e").startswith("OBJECT")).select(
        "report_id", F.lower(F.coalesce(_text(e, "$.severity"), F.lit("high"))).alias("severity"), F.coalesce(_text(e, "$.cve", "$.id", "$.link"), F.lit("advisory")).alias("rule_id"),
        F.col("k").alias("file"), F.lit(0).alias("line"), F.coalesce(_text(e, "$.title", "$.summary"), F.lit("Composer advisory")).alias("message"),
    )
    return usual.unionByName(found.join(usual.select("report_id").distinct(), "report_id", "left_anti"))


def lizard_functions(body: str) -> Column:
    """The functions of a complexity report, most complex first: ARRAY<STRUCT<ccn, ncss, file, line, func>> with the first two negated."""
    x = _xml(None, body, "measure array<struct<_type string, item array<struct<_name string, value array<string>>>>>")
    of = F.filter(x["measure"], lambda m: F.lower(F.trim(m["_type"])) == "function")
    items = F.filter(F.get(of, F.lit(0))["item"], lambda i: F.size(i["value"]) >= 3)
    at = r"^(.+?)\s+at\s+(.*?):(\d+)\s*$"
    number = lambda v: F.coalesce(F.trim(v).try_cast("double").cast("int"), F.lit(0))

    def one(i: Column) -> Column:
        named = i["_name"].rlike(at)
        part = lambda g: F.regexp_extract(i["_name"], at, g)
        return F.struct(
            (-number(F.get(i["value"], F.lit(2)))).alias("ccn"), (-number(F.get(i["value"], F.lit(1)))).alias("ncss"), F.when(named, plain(F.trim(part(2)))).otherwise("").alias("file"),
            F.when(named, F.coalesce(part(3).try_cast("int"), F.lit(0))).otherwise(0).alias("line"), F.when(named, F.trim(part(1))).otherwise(F.coalesce(i["_name"], F.lit(""))).alias("func"),
        )

    return F.array_sort(F.transform(items, one))


def parse_lizard(reports: DataFrame, body: str = "body", most: int = 25) -> DataFrame:
    """The most complex functions of each report: by complexity, then statements, file and line."""
    rows = reports.select("report_id", F.explode(F.slice(lizard_functions(body), 1, most)).alias("f"))
    said = F.concat(F.lit("CCN="), -F.col("f.ccn"), F.lit(" NCSS="), -F.col("f.ncss"), F.lit(" "), F.col("f.func"))
    return rows.select("report_id", F.lit("info").alias("severity"), F.lit("complexity_hotspot").alias("rule_id"), F.col("f.file").alias("file"), F.col("f.line").alias("line"), F.trim(said).alias("message"))


def junit_totals(reports: DataFrame, body: str = "body") -> DataFrame:
    """Per test report what its suites say in all: tests, failures, errors, skipped; attributes that are no number count 0."""
    names = ("tests", "failures", "errors", "skipped")
    attrs = ", ".join(f"_{n} string" for n in names)
    x = _xml(None, body, f"testsuite array<struct<{attrs}>>, {attrs}")
    suites = F.when(F.size(x["testsuite"]) > 0, x["testsuite"]).otherwise(F.array(F.struct(*[x[f"_{n}"].alias(f"_{n}") for n in names])))
    total = lambda n: F.aggregate(suites, F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s[f"_{n}"].try_cast("bigint"), F.lit(0)))
    return reports.where(F.col(body).isNotNull()).select("report_id", *[total(n).alias(n) for n in names])


def go_modules(reports: DataFrame, body: str = "body") -> DataFrame:
    """Modules that a stream of JSON objects names: report_id, path, and how often."""
    named = parse_json_lines(reports, lambda e: _text(e, "$.Path").isNotNull(), {"path": lambda e: _text(e, "$.Path")}, body)
    return named.groupBy("report_id", "path").agg(F.count("*").alias("entries"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{n: (lambda df, f=f: parse_json(df, f)) for n, f in JSON_FORMATS.items()}, "go_test": parse_go_test, "flake8": parse_flake8, "checkstyle": parse_checkstyle, "junit": parse_junit,
    "gocyclo": lambda df: parse_lines(df, "cyclomatic"), "dupl": lambda df: parse_lines(df, "dup_block", 25), "stdout": lambda df: parse_lines(df, "stdout", 25), "clang_tidy": parse_clang_tidy,
    "dart_analyze": parse_dart, "cargo": parse_cargo, "govulncheck": parse_govulncheck, "npm_audit": parse_npm_audit, "cppcheck": parse_cppcheck, "phpcpd": parse_phpcpd, "trx": parse_trx,
    "composer_audit": parse_composer_audit, "lizard": parse_lizard, "scalastyle": parse_checkstyle,
}


def parse_reports(reports: DataFrame) -> DataFrame:
    """Reports (report_id, format, body) of all known formats; those of unknown formats are read as generic.

    The reports are written once, apart by format, so each parser reads the bodies of its own format alone.
    """
    known = F.when(F.col("format").isin(*PARSERS), F.col("format")).otherwise("generic")
    path = scratch_path(reports.sparkSession, "reports")
    reports.select("report_id", "body", known.alias("__format")).write.partitionBy("__format").parquet(path)
    apart = reports.sparkSession.read.schema(reports.select("report_id", "body", F.lit("").alias("__format")).schema).parquet(path)
    return reduce(DataFrame.unionByName, [parse(apart.where(F.col("__format") == name)) for name, parse in PARSERS.items()])
