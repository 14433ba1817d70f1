"""The filter language: syntax, meaning, and that the compiled form means the same."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.filters import FilterSyntaxError, NativeSource, VariantSource, compile_filter, evaluate, matches, parse
from veldspar.filters.compiler import java_pattern
from veldspar.filters.syntax import Call, ListOf, Literal, Name, Op, Quantified, tokens

PREFIX = {
    "size >= 4 AND kind == 'rock'": "AND(>=(size, 4), ==(kind, 'rock'))",
    "a STARTS_WITH 'x' OR a ENDS_WITH 'y'": "OR(STARTS_WITH(a, 'x'), ENDS_WITH(a, 'y'))",
    "t CONTAINS 'u' AND p > 5.5": "AND(CONTAINS(t, 'u'), >(p, 5.5))",
    "NOT (s == 'off' OR d < '2020-02-02')": "NOT(OR(==(s, 'off'), <(d, '2020-02-02')))",
    "n IN [1, 2] AND c NOT IN ['x', \"y\"]": "AND(IN(n, [1, 2]), NOT_IN(c, ['x', 'y']))",
    "m EXISTS AND k DOES NOT EXIST": "AND(EXISTS(m), DOES_NOT_EXIST(k))",
    "xs.length > 0 AND xs[0].cost < 9": "AND(>(.(xs, length), 0), <(.([](xs, 0), cost), 9))",
    "u.p.ok == true AND u.n >= :least": "AND(==(.(.(u, p), ok), true), >=(.(u, n), :least))",
    "(a == 1 AND b == 2) OR c == 3": "OR(AND(==(a, 1), ==(b, 2)), ==(c, 3))",
    "a == 1 OR b == 2 AND c == 3": "OR(==(a, 1), AND(==(b, 2), ==(c, 3)))",
    "NOT a == 5": "==(NOT(a), 5)",
    "x == null AND y == -2e1": "AND(==(x, null), ==(y, -20))",
    "DOES_NOT_EXIST(q)": "DOES_NOT_EXIST(q)",
}


@pytest.mark.parametrize("text", PREFIX)
def test_prefix_form(text):
    assert str(parse(text)) == PREFIX[text]


@pytest.mark.parametrize("text", ["a ==", "a == 1 junk", "a NOT ['x']", "a ! 1", "a = 1", "a IN (1)", "(a == 1", "a == 0x10", "", "a IN [true]", "a == 1 AND", "ANY(a, b)", "LENGTH(a) > 1", "a[*] == 1", "a == .5"])
def test_syntax_errors(text):
    with pytest.raises(FilterSyntaxError):
        parse(text)


def test_extended_syntax_and_quirks():
    assert str(parse("ANY(xs[*], n > 1) AND LENGTH(s) == 3", extended=True)) == "AND(ANY(xs[*], >(n, 1)), ==(LENGTH(s), 3))"
    assert str(parse("a == 1 junk", quirks=True)) == "==(a, 1)"
    assert str(parse("a == null AND b == 1", quirks=True)) == "==(a, null)"
    with pytest.raises(FilterSyntaxError):
        parse("(a == null)", quirks=True)


def test_tokens_and_strings():
    kinds = [(t.kind, t.text) for t in tokens("f1 EXISTS AND f2 DOES NOT EXIST OR g[*].h == \"v\"")]
    assert kinds == [("name", "f1"), ("keyword", "EXISTS"), ("keyword", "AND"), ("name", "f2"), ("absent", "DOES NOT EXIST"), ("keyword", "OR"), ("name", "g"), ("star", "[*]"), ("mark", "."), ("name", "h"), ("mark", "=="), ("string", "v"), ("end", "")]
    assert parse(r"a == 'x\n\t\\\"y\'z\q'").right.value == "x\n\t\\\"y\\'z\\q"
    assert parse("a == 'open").right.value == "open"
    assert parse("a == 5.").right.value == 5.0


CASES = [
    ("age == 30", {"age": 30}, True),
    ("age == 30", {"age": "30"}, False),
    ("age == 30", {}, False),
    ("age != 30", {}, True),
    ("age > 30", {}, False),
    ("age > 30 OR ok == true", {"ok": True}, False),
    ("NOT (age > 30)", {}, False),
    ("a == NULL AND b != NULL", {"b": "v"}, True),
    ("u.mail ENDS_WITH '@x.org'", {"u": {"mail": "a@x.org"}}, True),
    ("u.mail ENDS_WITH '@x.org'", {"u": 3}, False),
    ("s IN ['on', 'off']", {"s": "on"}, True),
    ("s NOT IN ['on']", {}, True),
    ("'a' IN tags", {"tags": ["b", "a"]}, True),
    ("'a' IN tags", {"tags": "a"}, False),
    ("p >= 1 AND p < 2 AND d <= 0.2", {"p": 1.5, "d": 0.15}, True),
    ("on == true AND gone == false", {"on": True, "gone": False}, True),
    ("n MATCHES '^[a-z0-9_]{3,16}$'", {"n": "ann_1"}, True),
    ("n MATCHES '^a$'", {"n": "a\n"}, False),
    ("n MATCHES '('", {"n": "("}, False),
    ("n MATCHES '(?=a)'", {"n": "a"}, False),
    ("us[0].cs[1].ad.city == 'Rome' AND us[0].cs[1].ph[1].t CONTAINS 'work'", {"us": [{"cs": [{}, {"ad": {"city": "Rome"}, "ph": [{}, {"t": "work"}]}]}]}, True),
    ("tags.length > 2 AND extra EXISTS", {"tags": [1, 2, 3], "extra": None}, True),
    ("s.length == 1", {"s": "a"}, False),
    ("o.length == 1", {"o": {"length": 1}}, True),
    ("((a > 10 OR b < 5) AND (c == true OR d != false)) OR (e IN [1, 2] AND f NOT IN ['x'])", {"a": 15, "b": 7, "c": False, "d": True, "e": 2, "f": "w"}, True),
    ("xs[9] == null", {"xs": [1]}, True),
    ("xs[0.5] == 2", {"xs": [1, 2]}, True),
    ("x EXISTS", {}, False),
    ("a.b EXISTS", {"a": {"b": None}}, True),
    ("a.b DOES NOT EXIST", {"a": {}}, True),
    ("n == :n", {"n": 1}, True),
    ("n == :m", {"n": 1}, False),
    ("n", {"n": True}, True),
    ("n", {"n": 1}, False),
    ("xs == [1, 'a']", {"xs": [1.0, "a"]}, True),
    ("xs == [1, 'a']", {"xs": [1.0]}, False),
    ("a == b", {"a": {"k": [1, 2.0]}, "b": {"k": [1.0, 2]}}, True),
    ("s < 'b'", {"s": "a"}, True),
    ("s < 1", {"s": "a"}, False),
    ("NOT (xs[0] EXISTS)", {}, True),
    ("ANY(xs, q > 100)", {"xs": [{"q": 1}, {"q": 120}]}, True),
    ("ANY(xs, q > 100)", {"xs": [{}, {"q": 120}]}, False),
    ("ANY(xs, q > 100)", {"xs": [{"q": 120}, {}]}, True),
    ("ALL(xs, q > 1)", {"xs": []}, True),
    ("ALL(xs, q > 1)", {"xs": [{"q": 2}, {"q": 1}]}, False),
    ("LENGTH(s) == 2 AND LENGTH(o) == 1", {"s": "é", "o": {"k": 0}}, True),
]
ODD = ["[1]", "3", "null", "not json", "", None]


def test_interpreter_cases():
    for text, data, wanted in CASES:
        assert matches(parse(text, extended=True), json.dumps(data)) is wanted, (text, data)
    for metadata in ODD:
        assert not matches(parse("a == 1 OR a != 1"), metadata)
        assert matches(parse("a DOES NOT EXIST"), metadata) is False
    assert not matches(parse("NOT (a[0] EXISTS)"), "nope") and matches(parse("NOT (a[0] EXISTS)"), "[1]")


def test_compiled_cases(spark):
    rows = [(i, json.dumps(d)) for i, (_, d, _) in enumerate(CASES)] + [(1000 + i, m) for i, m in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "i int, m string").select("i", F.expr("try_parse_json(m)").alias("v"))
    source = VariantSource(F.col("v"))
    for at in range(0, len(CASES), 12):
        part = CASES[at : at + 12]
        got = frame.select("i", *(F.coalesce(compile_filter(parse(t, extended=True), source), F.lit(False)).alias(f"c{n}") for n, (t, _, _) in enumerate(part))).collect()
        by_id = {r.i: r for r in got}
        for n, (text, _, wanted) in enumerate(part):
            assert by_id[at + n][f"c{n}"] is wanted, text
        data = {i: m for i, m in rows}
        for r in got:
            for n, (text, _, _) in enumerate(part):
                assert r[f"c{n}"] is matches(parse(text, extended=True), data[r.i]), (text, data[r.i])


def _value(rng, depth=0):
    c = rng.random()
    if c < 0.35 or depth > 2:
        return rng.choice([0, 1, 2.5, -1, 10])
    if c < 0.6:
        return rng.choice(["a", "ab", "", "x1"])
    if c < 0.75:
        return rng.choice([True, False, None])
    if c < 0.87:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: _value(rng, depth + 1) for k in rng.sample("abcd", rng.randint(0, 3))}


def _path(rng, depth):
    if depth > 2 or rng.random() < 0.6:
        return Name(rng.choice("abc"))
    return Op(".", _path(rng, depth + 1), Name(rng.choice("abc"))) if rng.random() < 0.5 else Op("[]", _path(rng, depth + 1), Literal(float(rng.randint(0, 2))))


def _node(rng, depth=0):
    c = rng.random()
    if depth > 3 or c < 0.2:
        return rng.choice([Name(rng.choice("abcde")), Literal(1.0), Literal("a"), Literal(True), Literal(None)])
    if c < 0.33:
        return Op(".", _path(rng, depth + 1), Name(rng.choice(["a", "length"])))
    if c < 0.5:
        return Op(rng.choice(["==", "!=", ">", "<="]), _node(rng, depth + 1), _node(rng, depth + 1))
    if c < 0.64:
        return Op(rng.choice(["AND", "OR"]), _node(rng, depth + 1), _node(rng, depth + 1))
    if c < 0.7:
        return Op("NOT", None, _node(rng, depth + 1))
    if c < 0.78:
        return Op(rng.choice(["IN", "NOT_IN"]), _node(rng, depth + 1), rng.choice([ListOf((Literal(1.0), Literal("a"))), Name("b")]))
    if c < 0.84:
        return Op(rng.choice(["CONTAINS", "MATCHES"]), _node(rng, depth + 1), Literal(rng.choice(["a", "^a.*$", "("])))
    if c < 0.92:
        return Call(rng.choice(["EXISTS", "DOES_NOT_EXIST", "LENGTH"]), (_path(rng, depth + 1),))
    return Quantified(rng.choice(["ANY", "ALL"]), _path(rng, depth + 1), _node(rng, depth + 1))


def test_random_filters_mean_the_same_compiled(spark):
    rng = random.Random(4)
    data = [json.dumps({k: _value(rng) for k in rng.sample("abcde", rng.randint(0, 5))}) for _ in range(120)] + ["[1]", "null", "nope"]
    frame = spark.createDataFrame(list(enumerate(data)), "i int, m string").select("i", F.expr("try_parse_json(m)").alias("v")).cache()
    for _ in range(4):
        nodes, quirks = [_node(rng) for _ in range(6)], rng.random() < 0.3
        got = frame.select("i", *(compile_filter(n, VariantSource(F.col("v")), quirks).alias(f"c{k}") for k, n in enumerate(nodes))).collect()
        for r in got:
            for k, n in enumerate(nodes):
                assert r[f"c{k}"] is matches(n, data[r.i], quirks), (str(n), data[r.i])
    frame.unpersist()


def test_native_columns(spark):
    schema = T.StructType.fromDDL("a int, s string, ok boolean, xs array<int>, o struct<k:double>")
    rows = [(1, "x", True, [1, 2], (1.5,)), (None, None, None, None, None), (7, "y", False, [], (None,))]
    frame = spark.createDataFrame(rows, schema)
    names = schema.fieldNames()

    def plain(row):
        return {k: ({x: y for x, y in v.asDict().items() if y is not None} if hasattr(v, "asDict") else v) for k, v in zip(names, row) if v is not None}

    found = frame.collect()
    for text in ["a > 1", "a != 1", "NOT (a > 1)", "s == 'x' AND a == 1", "ok", "xs.length == 2", "xs[1] == 2", "o.k > 1", "o.k EXISTS", "a IN [1, 2]", "s IN ['x']", "s == 1", "2 IN xs", "a > 0 OR nope == 1", "xs == [1, 2]", "nope EXISTS", "a DOES NOT EXIST"]:
        got = {str(r) for r in frame.where(compile_filter(parse(text), NativeSource(schema))).collect()}
        assert got == {str(r) for r in found if matches(parse(text), json.dumps(plain(r)))}, text


def test_native_comparisons_reach_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = events.where(compile_filter(parse("event_type == 'click' AND user_id > 3"), NativeSource(events.schema))).select("event_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(user_id,3)" in plan


def test_patterns(spark):
    assert java_pattern(r"a$") == r"(?d)a\z"
    assert java_pattern(r"[[:alpha:]$]+") == r"(?d)[\p{Alpha}$]+"
    for bad in ("(?=a)", r"(a)\1", "a++", "("):
        assert java_pattern(bad) is None


def test_evaluate_returns_values():
    assert evaluate(parse("a.length"), {"a": [1, 2]}) == 2.0
