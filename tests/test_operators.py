import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions import paths as P
from siltworks.functions import text as X
from siltworks.operators import evidence as E
from siltworks.operators import rollup as R
from siltworks.operators import scoring as S
from siltworks.operators import search as Q
from siltworks.operators import signals as G
from siltworks.operators import tools as T
from siltworks.operators.ranking import with_place
from siltworks.plans.predicate import BadPredicate, compile_predicate
from siltworks.sources.reports import parse_reports

LEAF = "g string, status string, score double, confidence double, review boolean, w double, enabled boolean"


def one(spark, column, schema="x string", *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_group_of_a_scored_a_missing_and_a_scored_leaf(spark):
    rows = [("g", "scored", 4.0, 0.9, False, 1 / 3, True), ("g", "scored", 2.0, 0.8, False, 1 / 3, True), ("g", "insufficient_evidence", None, 0.2, True, 1 / 3, True)]
    g = R.group_scores(spark.createDataFrame(rows, LEAF), ["g"]).first()
    assert g["score"] == pytest.approx(3.0) and g["coverage"] == pytest.approx(2 / 3)
    assert g["confidence"] == pytest.approx(0.85 * (0.5 + 0.5 * 2 / 3) * (1 - 0.15 / 3))


def test_group_of_leaves_that_do_not_apply(spark):
    g = R.group_scores(spark.createDataFrame([("g", "na", None, None, False, 1.0, True)], LEAF), ["g"]).first()
    assert (g["score"], g["coverage"], g["confidence"]) == (None, 0.0, 0.05)


def test_disabled_group_and_nulls(spark):
    rows = [("off", "scored", 5.0, None, None, 1.0, False), ("none", None, None, None, None, None, None), ("high", "scored", 9.0, 7.0, False, 1.0, True)]
    got = {r["g"]: (r["score"], r["confidence"]) for r in R.group_scores(spark.createDataFrame(rows, LEAF), ["g"]).collect()}
    assert got["off"] == (None, 0.0) and got["none"][0] is None and got["high"] == (5.0, 1.0)
    assert R.group_scores(spark.createDataFrame([], LEAF), ["g"]).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-2, 5)), min_size=1, max_size=6))
def test_weights_sum_to_one(spark, ws):
    df = R.normalized_weights(spark.createDataFrame([("g", w) for w in ws], "g string, weight double"), ["g"])
    assert df.agg(F.sum("w")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("text, want", [("a or b and c", True), ("(a or b) and c", False), ("x == none", True), ("kind == 'LIB'", True), ("kind == \"app\"", False), ("always", True), ("", False), ("never", False), ("a && !b", BadPredicate), ("a ==", BadPredicate), ("(a", BadPredicate), ("a b", BadPredicate), ("gone", False), ("n", True)])
def test_predicates(spark, text, want):
    df = spark.createDataFrame([(True, False, False, None, "lib", 2)], "a boolean, b boolean, c boolean, x string, kind string, n int")
    if want is BadPredicate:
        with pytest.raises(BadPredicate):
            compile_predicate(text, df.schema)
    else:
        assert df.select(compile_predicate(text, df.schema)).first()[0] is want


def test_judge_without_faults_and_with_missing_groups(spark):
    cols = [*S.SUBSCORES, *S.FAULTS]
    rows = [tuple([5] * 7 + [0] * 11), tuple([5] * 7 + [2 if f == "missing_relevant_groups" else 0 for f in S.FAULTS]), tuple([None] * 18)]
    got = S.rescore(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))).collect()
    assert [(r["base"], r["penalty"], r["overall"], r["verdict"]) for r in got] == [(100, 0, 100, "excellent"), (85, 14, 71, "fair"), (0, 0, 0, "unusable")]
    assert got[1]["activation_scope_correctness_score"] == got[1]["issue_coverage_score"] == 2


def test_leaf_payloads(spark):
    rows = [("Scored", "7", "2", None), ("scored", "x", "", "yes"), ("odd", "1", "0.5", "no"), ("na", None, None, None), ("scored", "NaN", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [tuple(r[0]) for r in df.select(S.clean_leaf_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [("scored", 5.0, 1.0, False), ("insufficient_evidence", None, None, True), ("insufficient_evidence", None, 0.5, False), ("na", None, None, True), ("insufficient_evidence", None, None, True)]


def test_run_status(spark):
    rows = [(1, {}, ["out"], True, False), (1, {"o": "p"}, ["out"], True, False), (1, None, None, True, False), (1, {}, [], False, True), (-9, {}, [], False, False), (None, {}, [], False, False), (0, None, None, False, False), (127, {}, [], True, True), (3, {}, [], False, False)]
    df = spark.createDataFrame(rows, "e int, a map<string,string>, d array<string>, f boolean, r boolean")
    got = [tuple(x[0]) for x in df.select(T.run_status(F.col("e"), F.col("a"), F.col("d"), F.col("f"), F.col("r"))).collect()]
    assert got == [("tool_failed", "nonzero_exit_and_no_artifacts"), ("completed", None), ("completed", None), ("completed", None), ("tool_failed", "terminated_by_signal:9"), ("tool_failed", "invalid_exit_code"), ("completed", None), ("tool_failed", "tool_not_found_or_not_executable"), ("tool_failed", "nonzero_exit_code:3")]


def test_paths(spark):
    assert one(spark, P.plain(F.col("x")), "x string", (".github/a",), ("..\\b\\c",), (None,)) == ["github/a", "b/c", ""]
    assert one(spark, P.is_build_output(F.col("x")), "x string", ("a/dist/b.js",), ("distant/b.js",), ("a.min.css",), ("a.map",), ("",)) == [True, False, True, True, False]
    assert one(spark, P.citation_kind(F.col("x")), "x string", ("a.py:3-9",), (" ",), (None,), ("retrieval.x:1",), ("n/a",), ("a:b",)) == ["repo_line", "empty", "empty", "retrieval", "other", "other"]


@pytest.mark.parametrize("glob, path, want", [("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("src/*", "src/a/b", False), ("a?c", "abc", True), ("a[!b]c", "abc", False), ("*.py", "a.py", True), ("*.py", "axpy", False), ("docs/**", "docs/a/b", True), ("[ab", "[ab", True)])
def test_globs(glob, path, want):
    assert bool(re.match(P.glob_pattern(glob), path)) is want


def test_texts(spark):
    assert one(spark, X.lines(F.col("x")), "x string", ("a\r\nb\n",), ("",), ("a\n\n",), (None,)) == [["a", "b"], [], ["a", ""], None]
    assert one(spark, X.looks_minified(F.col("x")), "x string", ("x" * 3000,), ("a\nb",), ("",), (None,)) == [True, False, False, False]
    assert one(spark, X.fingerprint(F.col("x")), "x string", ("  A \n b ",), (None,)) == ["a b", ""]
    assert one(spark, X.clip(F.col("x"), 3), "x string", ("abcd",), ("abc",)) == ["ab…", "abc"]
    assert one(spark, F.length(X.clip_middle(F.col("x"), 20)), "x string", ("y" * 90,)) == [20]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 120), st.sampled_from("pq")), min_size=1, max_size=20))
def test_windows_equal_a_sweep(spark, found):
    got = Q.windows(spark.createDataFrame([("f", n, q) for n, q in found], "k string, line_no int, query string"), "k", 2, 5)
    want: list[list] = []
    for low, high in sorted((max(1, n - 2), n + 2) for n, _ in found):
        if want and low <= want[-1][1] + 5:
            want[-1] = [want[-1][0], max(high, want[-1][1]), want[-1][2] + 1]
        else:
            want.append([low, high, 1])
    assert sorted([r["start"], r["end"], r["matches"]] for r in got.collect()) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), min_size=1, max_size=15))
def test_overlaps_equal_all_pairs(spark, spans):
    rows = [("k", i, low, low + n) for i, (low, n) in enumerate(spans)]
    got = {r["n"]: r["overlaps"] for r in Q.overlap_counts(spark.createDataFrame(rows, "k string, n int, low int, high int"), ["k"], "n").collect()}
    assert got == {i: sum(a <= high and b >= low for _, _, a, b in rows) for _, i, low, high in rows}


def test_findings_in_citations(spark):
    c = spark.createDataFrame([("r", "a.py:2-4"), ("r", "a.py:9"), ("r", "see README"), ("r", None)], "repo string, citation string")
    f = spark.createDataFrame([("r", "a.py", 2), ("r", "a.py", 2), ("r", "a.py", 4), ("r", "a.py", None), ("s", "a.py", 3)], "repo string, path string, line int")
    assert [tuple(r) for r in Q.findings_in_citations(c, f).collect()] == [("r", "a.py:2-4", 3, 2)]


def test_bad_patterns_stand_for_themselves(spark):
    lines = spark.createDataFrame([("f", 1, "x = EVAL(y)"), ("f", 2, "evaluate")], "k string, line_no int, line string")
    assert [r["line_no"] for r in Q.occurrences(lines, "k", ["eval("]).collect()] == [1]


def test_budget_and_versions(spark):
    df = spark.createDataFrame([("r", 1, 5), ("r", 2, 5), ("r", 3, 1), ("s", 1, 99)], "g string, n int, size int")
    assert sorted(r["n"] for r in Q.within_budget(df, ["g"], [F.col("n")], "size", 10, 10).collect()) == [1, 2]
    files = spark.createDataFrame([("r", "a/b", "v = 2"), ("r", "b", "v = 3"), ("r", "c", None), ("r", "a", "w = 1")], "r string, p string, t string")
    assert tuple(G.pick_versions(files, "r", "p", "t", [("v", r"v = (\d)"), ("w", r"w = (\d)")]).first()) == ("r", "v", "3", "b")


def test_reports_of_every_format(spark):
    rows = [
        (1, "semgrep", '{"results": [{"check_id": "c", "path": "./a.py", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR"}}]}'),
        (2, "gitleaks", '[{"RuleID": "k", "File": "b", "StartLine": 2, "Description": "d"}]'),
        (3, "eslint", '[{"filePath": "/c.js", "messages": [{"ruleId": null, "severity": 2, "line": 1, "message": "x"}]}]'),
        (4, "flake8", "noise\nd.py:7:1: E501 too long\n"),
        (5, "checkstyle", '<checkstyle><file name="e.java"><error line="4" message="a &amp; b"/><error line="x"/></file></checkstyle>'),
        (6, "junit", '<testsuites><testsuite><testcase classname="t" name="n"><failure message="no"/></testcase><testcase name="ok"/></testsuite></testsuites>'),
        (7, "go_test", '{"Action": "run"}\nbroken\n{"Action": "fail", "Package": "p", "Test": "T"}'),
        (8, "unheard", '{"warnings": [{"file": "w", "line": "9", "id": 5, "msg": "u"}, 3, null]}'),
        (9, "semgrep", '{"results": [{'), (10, "osv", "{}"), (11, "flake8", None), (12, "ruff", "[]"),
    ]
    got = sorted(tuple(r) for r in parse_reports(spark.createDataFrame(rows, "report_id int, format string, body string")).collect())
    assert got == [
        (1, "error", "c", "a.py", 3, "m"), (2, "high", "k", "b", 2, "d"), (3, "error", "eslint", "c.js", 1, "x"), (4, "warning", "E501", "d.py", 7, "too long"),
        (5, "warning", "checkstyle", "e.java", 0, "Checkstyle issue."), (5, "warning", "checkstyle", "e.java", 4, "a & b"), (6, "error", "test_failure", "t", 0, "t::n: no"),
        (7, "error", "test_fail", "p", 0, "p::T"), (8, "unknown", "5", "w", 9, "u"),
    ]


def test_late_findings_in_a_stream(spark, tmp_path):
    from siltworks.streaming.findings import drain, once_each, read_stream

    rows = [(1, "2025-01-01 00:00:00"), (1, "2025-01-02 00:00:00"), (2, "2025-01-02 00:00:00")]
    spark.createDataFrame(rows, "finding_id bigint, t string").select("finding_id", F.col("t").cast("timestamp").alias("ingested_at")).write.parquet(str(tmp_path / "f"))
    assert drain(once_each(read_stream(spark, str(tmp_path / "f"))), "append").count() == 2


def test_schema_search_all_reads_every_source(spark, tmp_path):
    from siltworks.queries.plans import schema_search_all

    docs = [(i, s, "a\nb\nc\nretry\nd\ne\nf") for i, s in enumerate(["adr_notes", "issues", " Reviews ", "", None])]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in schema_search_all(spark, str(tmp_path)).select("doc_id", "place", "start", "end", "matches", "queries", "chars").collect())
    assert got == [(i, 1, 2, 6, 1, "retry", 13) for i in range(5)]


def test_places_across_ranges(spark):
    rows = [("hot", i * 7919 % 5000) for i in range(5000)] + [("a", 3), ("a", 1), (None, 2), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("place", F.lit("old"))
    got = with_place(df, ["k"], [F.desc("v")]).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], {})[r["place"]] = r["v"]
    assert by["hot"] == {i + 1: 4999 - i for i in range(5000)} and by["a"] == {1: 3, 2: 1} and by[None] == {1: 2, 2: 1}
    assert with_place(df.where("false"), ["k"], [F.col("v")]).count() == 0


@pytest.mark.parametrize("value, want", [("./a\\b.py", "a/b.py"), ("/x", "x"), ("../up", None), ("a/../../b", None), ("a..b", "a..b"), ("  ", None), (None, None), ("./", None)])
def test_safe_paths(spark, value, want):
    assert one(spark, E.safe_path(F.col("x")), "x string", (value,)) == [want]


def test_hints_and_skips(spark):
    rows = [("path", "src", "src/a.py"), ("path", "src/a.py", "src/a.py"), ("path", "sr", "src/a.py"), ("glob", "src/*.py", "x/src/a.py"), ("glob", "*.p?", "d/e/f.py"), ("glob", "src/*", "src/d/a.py"), ("glob", "a+(b", "a+(b"), (None, "a", "a"), ("path", None, "a")]
    df = spark.createDataFrame(rows, "k string, h string, p string")
    assert [r[0] for r in df.select(E.hint_match(F.col("p"), F.col("k"), F.col("h"))).collect()] == ["below", "equal", None, "glob", "glob", None, "glob", None, None]
    files = spark.createDataFrame([("", "x"), ("css/a.txt", "x"), ("css", "x"), ("own/x.py", "  \n"), ("own/x.py", None), ("own/x.py", "y" * 3000), ("own/x.py", "z")], "p string, t string")
    assert [r[0] for r in files.select(E.skip_reason(F.col("p"), F.col("t"))).collect()] == ["generated_path", "generated_path", None, "empty", "empty", "minified_or_generated_content", None]


def test_objects_in_answers(spark):
    said = ['```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} it is', '{"a": ', "none", None, "", "[1]", '```\n[1]\n```']
    got = one(spark, E.first_object(F.col("x")), "x string", *[(s,) for s in said])
    assert got == ['{"a":1}', '{"a":{"b":2}}', None, None, None, None, None, None]


def test_patches_and_cut_dumps(spark):
    ddl = "k string, a int, b string"
    got = E.patched(spark.createDataFrame([("x", 1, "p"), ("y", 2, "q")], ddl), spark.createDataFrame([("x", None, "r"), ("z", 3, None)], ddl), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, "r"), ("y", 2, "q"), ("z", 3, None)]
    df = spark.createDataFrame([("g", 1, 40), ("g", 2, 70), ("g", 3, 5), (None, 1, 200)], "g string, i int, n int")
    assert sorted((r["g"] or "", r["i"], r["taken"]) for r in E.dump_cut(df, ["g"], [F.col("i")], "n", 10, 100).collect()) == [("", 1, 100), ("g", 1, 40), ("g", 2, 60)]


def test_capped_windows(spark):
    rows = [("f", 1, 5, 3), ("f", 10, 40, 30), ("f", 80, 99, 98)]
    df = spark.createDataFrame(rows, "k string, start int, `end` int, focus int")
    sizes = spark.createDataFrame([("f", 99)], "k string, size int")
    assert sorted(tuple(r) for r in Q.cap_windows(df, sizes, "k", 12).collect()) == [("f", 1, 5, 3), ("f", 24, 35, 30), ("f", 88, 99, 98)]
    assert Q.cap_windows(df, sizes, "k", 0).count() == 3
