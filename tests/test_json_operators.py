"""The JSON operators in transform SQL: what they become, and what they return."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changeflow.functions.json_operators import rewrite_json_operators as rewrite
from changeflow.operators.transform import sql_transform

SAME = [
    "SELECT 1",
    "transform(a, x -> x + 1)",
    "aggregate(a, 0, (acc, x) -> acc + x, acc -> acc)",
    "zip_with(a, b, (x, y) -> x || '->>')",
    "map_filter(m, (k, v) -> k > v)",
    "filter(a, /* -> */ x /* ? */ -> x > 1)",
    "-- a -> b\nSELECT 1 /* a ->> b /* c ? d */ */",
    "'a -> ?' || \"b ->> c\" || `d -> e`",
    "r'\\' || '->'",
    "'it''s -> ' || 'it\\'s ->'",
    "SELECT 'never closed -> ",
    "SELECT (a -> 'b'",
    "SELECT /* a -> 'b'",
    "SELECT a] -> 'b'",
]


@pytest.mark.parametrize("sql", SAME)
def test_left_alone(sql):
    assert rewrite(sql) == sql


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("a->'b'", "json_get_json(a, 'b')"),
        ("s.a ->> 'b'", "json_get_str(s.a, 'b')"),
        ("`s x`.`a` ? 'b'", "json_contains(`s x`.`a`, 'b')"),
        ("a -> 'b' -> 1 ->> c.d", "json_get_str(a, 'b', 1, c.d)"),
        ("a->1->2->3->4->5->>6", "json_get_str(json_get_json(a, 1, 2, 3, 4), 5, 6)"),
        ("a -> 'b' ? 'c' AND NOT d ? 'e'", "json_contains(json_get_json(a, 'b'), 'c') AND NOT json_contains(d, 'e')"),
        ("(a ->> 'n')::int + 1 > 2", "(json_get_str(a, 'n'))::int + 1 > 2"),
        ("a ->> 'n' + 1", "json_get_str(a, 'n') + 1"),
        ("x || a ->> 'n' || y", "x || json_get_str(a, 'n') || y"),
        ("a::string -> 'b'::string", "json_get_json(a::string, 'b'::string)"),
        ("a::decimal(9, 2) ->> 'b'", "json_get_str(a::decimal(9, 2), 'b')"),
        ("f(a, b -> 'c')[0].d ->> ('e' || x)", "json_get_str(f(a, json_get_json(b, 'c'))[0].d, ('e' || x))"),
        ("CASE WHEN a ? 'b' THEN c END ->> 'd'", "json_get_str(CASE WHEN json_contains(a, 'b') THEN c END, 'd')"),
        ("a ->> CASE WHEN b THEN 'c' END", "json_get_str(a, CASE WHEN b THEN 'c' END)"),
        ("a ->> CASE WHEN b ? 'c' THEN d -> 'e' END || f", "json_get_str(a, CASE WHEN json_contains(b, 'c') THEN json_get_json(d, 'e') END) || f"),
        ("WHERE (a) -> -1", "WHERE json_get_json((a), (-1))"),
        ("x IN (a -> 'b', 'c')", "x IN (json_get_json(a, 'b'), 'c')"),
        ("transform(a -> 'b', x -> x ->> 'c')", "transform(json_get_json(a, 'b'), x -> get_json_object(x, '$[\\'c\\']'))"),
        ("filter(a, x -> f(x -> 'j' -> 2 ? 'k'))", "filter(a, x -> f(coalesce(array_contains(json_object_keys(to_json(try_variant_get(try_parse_json(x), '$[\\'j\\'][2]', 'variant'))), 'k'), false)))"),
        ("reduce(a, b -> 'c', (x, y) -> x + y, x -> x, d -> 'e')", "reduce(a, json_get_json(b, 'c'), (x, y) -> x + y, x -> x, json_get_json(d, 'e'))"),
        ("own(a -> 'b', c -> 'd')", "own(json_get_json(a, 'b'), json_get_json(c, 'd'))"),
        ("a -- note\n -> 'b'", "json_get_json(a, 'b')"),
        ("'it''s' ->> 'b'", "json_get_str('it''s', 'b')"),
        ("EXISTS (SELECT 1 FROM t WHERE a ? 'b')", "EXISTS (SELECT 1 FROM t WHERE json_contains(a, 'b'))"),
    ],
)
def test_becomes(sql, want):
    assert rewrite(sql) == want


@pytest.mark.parametrize("sql", ["SELECT -> 'b'", "a ->> ", "a -> , b", "a + -> 'b'", "a ? AND b"])
def test_a_missing_operand_is_an_error(sql):
    with pytest.raises(ValueError, match="no value on its"):
        rewrite(sql)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "'x'", "(", ")", "[", "]", ",", "->", "->>", "?", "::", ".", "/*", "*/", "--", "\n", "'", "`", "case", "end", "-"]), max_size=25).map("".join))
def test_any_text_is_rewritten_or_refused(sql):
    try:
        out = rewrite(sql)
    except ValueError:
        return
    assert isinstance(out, str) and (out == sql or "json_" in out)


def test_values_in_lambdas(spark):
    got = sql_transform(
        spark.createDataFrame([(["{\"a\": {\"0\": 1, \"x y\": [5, 6]}}", "no", None, "[[7]]"], "x y")], "xs array<string>, k string"),
        """SELECT transform(xs, x -> x->'a'->>'x y') AS texts, transform(xs, (x, i) -> x->'a'->k->>1) AS by_column,
           transform(xs, x -> x->'a'->'0') AS digits, filter(xs, x -> x ? 'a') AS kept, exists(xs, x -> x->0->>0 = '7') AS found FROM __src""",
    ).first()
    assert got.texts == ["[5,6]", None, None, None] and got.by_column == ["6", None, None, None]
    assert got.digits == ["1", None, None, None] and len(got.kept) == 1 and got.found


def test_values(spark):
    rows = [
        (1, '{"a": {"b": [10, {"c": "x"}], "n": null}, "t": true}'),
        (2, '{"a": {"b": []}}'),
        (3, "not json"),
        (4, None),
        (5, "[1, 2]"),
    ]
    got = sql_transform(
        spark.createDataFrame(rows, "id int, j string"),
        """SELECT id, j->'a'->'b'->1->>'c' AS c, j->'a'->'b'->>0 AS n, j->'a'->'b' AS b, j ->> 't' AS t, j ? 'a' AS has,
           j->'a' ? 'n' AS has_n, j->'a'->>'n' AS null_text, j->>1 AS second FROM __src ORDER BY id;""",
    ).collect()
    assert [tuple(r) for r in got] == [
        (1, "x", "10", '[10,{"c":"x"}]', "true", True, True, None, None),
        (2, None, None, "[]", None, True, False, None, None),
        (3, None, None, None, None, False, False, None, None),
        (4, None, None, None, None, False, False, None, None),
        (5, None, None, None, None, False, False, None, "2"),
    ]
