import pytest
from pyspark.sql import functions as F

from sparklode.functions.predicates import condition
from sparklode.functions.regex import RegexError, checked, re2_to_java
from sparklode.operators.search import query_frame
from sparklode.plans.request import Matcher, QueryRequest
from sparklode.sources.schema import LOG_SCHEMA

BASE = 1_700_000_000_000_000_000


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (BASE, "GET /index 200", {"app": "web", "x": ""}, "1"),
        (BASE + 1000, "SELECT slow query 100%_\\", {"app": "db"}, "2"),
        (BASE + 2000, "POST /login 500 error É", {"app": "web", "x": "foo"}, "3"),
        (BASE + 2000, "tie ab\0cd", {"app": "web\n", "x": "\r"}, "4"),
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA).cache()


def ids(logs, **request):
    request["matchers"] = tuple(Matcher(*m) for m in request.get("matchers", ()))
    return [r["row_id"] for r in query_frame(logs, QueryRequest(**request)).collect()]


@pytest.mark.parametrize(("request_", "expected"), [
    ({}, "4321"), ({"limit": 1}, "4"), ({"start": BASE + 500, "end": BASE + 1500}, "2"), ({"start": BASE + 1000, "end": BASE + 1000}, "2"), ({"start": 5, "end": 1}, ""),
    ({"matchers": [("app", "web", "=")]}, "31"), ({"matchers": [("app", "web", "")]}, "31"), ({"matchers": [("app", "web", "!=")]}, "42"),
    ({"matchers": [("x", "", "=")]}, "1"), ({"matchers": [("x", "", "!=")]}, "432"), ({"matchers": [("x", "foo", "=")]}, "3"), ({"matchers": [("x", "foo", "!=")]}, "421"),
    ({"matchers": [("x", ".*", "=~")]}, "4321"), ({"matchers": [("x", "foo", "!~")]}, "421"), ({"matchers": [("x", "o", "=~")]}, "3"), ({"matchers": [("x", "^$", "=~")]}, "21"),
    ({"matchers": [("app", "w.b", "=~")]}, "431"), ({"matchers": [("app", "web$", "=~")]}, "31"), ({"matchers": [("x", "^.$", "=~")]}, "4"),
    ({"matchers": [("app", "nothing", "??")]}, "4321"),
    ({"line": "ERROR"}, "3"), ({"line": "select"}, "2"), ({"line": "É"}, "3"), ({"line": "é"}, ""), ({"line": "100%_\\"}, "2"), ({"line": "%"}, "2"), ({"line": "cd"}, "4"), ({"line": "0"}, "321"),
])
def test_truth_table(logs, request_, expected):
    assert "".join(ids(logs, **request_)) == expected


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(a)\1", "a++", "a*+", "(?U)a", "(", "[a", "a{1001}", "[[:nope:]]", r"\C", "(?P<a>x)(?P<a>y)"])
def test_patterns_that_are_rejected(spark, pattern):
    with pytest.raises(RegexError):
        checked(spark, pattern)


@pytest.mark.parametrize(("pattern", "text", "found"), [
    (r"(?P<name>web)", "web", True), (r"(?P<a_b>web)", "web", True), ("[[:alpha:]]+$", "ab1", False), ("[^[:digit:]]", "1", False), (r"\s", "\x0b", False), (r"[\s]", "\x0b", False), (r"\bweb\b", "a web.", True), (r"\béa", "xéa", True),
    ("(?m)^b$", "a\rb\rc", False), ("(?m)^b$", "a\u2028b\u2028c", False), ("(?m)^b$", "a\u0085b", False), ("(?m:a)b$", "ab\n", False), ("(?m:^b$)", "a\nb\n", True), ("(?m)a(?-m:b$)", "ab\nc", False), ("((?m)x)y$", "xy\n", False),
    ("(?m)^$", "a\n", True), ("(?m)b$", "ab\r\n", False), ("(?P<a_b>x)(?P<ab>y)", "xy", True), ("(?s:a.)b.c", "a\nb\nc", False), ("a^b", "a\nb", False),
    ("(?i)WEB", "web", True), ("(?i)É", "é", True), ("(?m)^b$", "a\nb\nc", True), ("(?s)a.b", "a\nb", True), ("a.b", "a\nb", False), ("a.b", "a\rb", True), ("[a&&b]", "&", True), ("[[a]", "[", True), (r"\Qa.b\E", "a.b", True), (r"x\z", "x\n", False), ("$", "", True), ("a{2,3}?", "aa", True),
])
def test_dialect(spark, pattern, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(checked(spark, pattern)).alias("f")).first()
    assert row["f"] is found


def test_invalid_pattern_fails_before_anything_runs(spark):
    with pytest.raises(RegexError):
        condition(spark, QueryRequest(matchers=(Matcher("a", "(", "=~"),)))
    assert re2_to_java("a$") == r"(?d)a\z"


def test_search_plan_is_a_top_k(logs):
    plan = query_frame(logs, QueryRequest(line="error"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
