import pytest

from sparklode.plans.request import Matcher, QueryRequest
from sparklode.plans.selector import SelectorError, parse_selector, unquote


@pytest.mark.parametrize(("text", "matchers", "line"), [
    ('{team="billing"}', [("team", "billing", "=")], ""),
    ('{team="billing",tier!="free",zone=~"eu-.*",pod!~"canary$"}', [("team", "billing", "="), ("tier", "free", "!="), ("zone", "eu-.*", "=~"), ("pod", "canary$", "!~")], ""),
    ("\t{   }\n", [], ""),
    ('{}|="refused"', [], "refused"),
    ('|=   "refused by peer"', [], "refused by peer"),
    ('{zone="eu"}   |=   "oom"', [("zone", "eu", "=")], "oom"),
    ('{title="one, two; three"}', [("title", "one, two; three", "=")], ""),
    (r'{quote="\"x\" \\"}', [("quote", '"x" \\', "=")], ""),
    ('{expr="{[}]"} |= "}{|="', [("expr", "{[}]", "=")], "}{|="),
    ('{  zone  =~  "e.u"  ,  pod  =  ""  }', [("zone", "e.u", "=~"), ("pod", "", "=")], ""),
    ('{my-org/kind.of thing!="y"}', [("my-org/kind.of thing", "y", "!=")], ""),
    ('|= "日本語"', [], "日本語"),
])
def test_valid(text, matchers, line):
    assert parse_selector(text) == (tuple(Matcher(*m) for m in matchers), line)


@pytest.mark.parametrize("text", [
    "\n", "billing", 'team="billing"}', '{team=billing}', '{team="billing"', '{team="billing', "{team}", "{=}", '{!="free"}', '{tier!"free"}', '{tier~"free"}',
    '{a="b"; c="d"}', '{a="b" c="d"}', '{a="b",,c="d"}', '{a="b", }', '{ ,a="b"}', '{a="line\nbreak"}', r'{a="\z"}', r'{a="\uDFFF"}', r'{a="\xg0"}', '{a=`b`}', "{a='b'}",
    '{a="b"} |= refused', '{a="b"} |= "no"', '{a="b"} |= "日本"', '{a="b"} |~ "refused"', '{a="b"} != "refused"', '{a="b"} !~ "refused"', '{a="b"} |= "one" |= "two"', '{a="b"} | json', '{a="b"}{c="d"}',
])
def test_invalid(text):
    with pytest.raises(SelectorError):
        parse_selector(text)


def test_unquote():
    assert unquote(r'"\x41\101\u00e9\n\\\""') == 'AAé\n\\"'
    assert unquote(r'"\xc3\xa9"') == "é"


@pytest.mark.parametrize(("limit", "effective"), [(-1, 100), (0, 100), (1, 1), (5000, 5000), (5001, 100)])
def test_limit_is_reset_and_not_clamped(limit, effective):
    assert QueryRequest(limit=limit).effective_limit == effective


def test_selector_replaces_matchers_and_line():
    body = {"matchers": [{"name": "a", "value": "b"}], "line": "old", "query": '{x="y"}', "limit": 3}
    assert QueryRequest.from_dict(body) == QueryRequest(matchers=(Matcher("x", "y", "="),), line="", limit=3)
    assert QueryRequest.from_dict(body | {"query": " "}).matchers == (Matcher("a", "b", ""),)
