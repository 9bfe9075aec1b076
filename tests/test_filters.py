"""Wire filters, pre-flight checks and compiled conditions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryfield.errors import FILTER_CODES, FieldNotFilterable, FilterError, InvalidCursor, InvalidTenantId, PageSizeOutOfRange, UnknownField
from quarryfield.functions.records import decode_cursor, encode_cursor
from quarryfield.operators import search
from quarryfield.plans import ast, preflight
from quarryfield.plans.compiler import compile_filter
from quarryfield.plans.wire import decode, encode
from quarryfield.registry import Registry
from quarryfield.types import Settings

FIELD = {"model": "m", "name": "s"}


def leaf(op, value=..., field=FIELD):
    return {"op": op, "field": field} | ({} if value is ... else {"value": value})


def wire(node):
    return json.dumps({"version": "1", "filter": node})


ACCEPTED = [
    *(leaf(op, "x") for op in ("eq", "neq", "lt", "lte", "gt", "gte", "prefix")), leaf("in", ["x", 1, 1.5, True]), leaf("nin", [1]), leaf("between", [1, 2]), leaf("is_null"), leaf("is_not_null"),
    {"op": "and", "args": [leaf("eq", 1), {"op": "not", "arg": {"op": "or", "args": [leaf("is_null"), leaf("eq", "y")]}}]}, leaf("in", list(range(1024))), leaf("eq", "x" * 4096), leaf("eq", False),
]


@pytest.mark.parametrize("node", ACCEPTED)
def test_accepted(node):
    tree = decode(wire(node))
    assert decode(json.dumps(encode(tree))) == tree


REJECTED = [
    ("nope", "envelope_malformed", ""), ("[]", "envelope_malformed", ""), ("{", "envelope_malformed", ""), ("", "envelope_malformed", ""), ('{"filter": null}', "node_malformed", "/filter"), ('{"filter": [1]}', "envelope_malformed", "/filter"),
    ('{"filter": []}', "node_malformed", "/filter"), ('{"filter": {}}', "node_malformed", "/filter"), ('{"version": 2, "filter": {}}', "version_unsupported", "/version"), ('{"version": null}', "version_unsupported", "/version"),
    (wire(leaf("like", "x")), "operator_unknown", "/filter/op"), (wire({"op": "eq", "value": 1}), "node_malformed", "/filter"), (wire(leaf("is_null", None)), "value_unexpected", "/filter/value"), (wire(leaf("eq")), "node_malformed", "/filter"),
    (wire(leaf("in", [])), "value_count_mismatch", "/filter/value"), (wire(leaf("in", list(range(1025)))), "value_out_of_bounds", "/filter/value"), (wire(leaf("in", [1, None])), "node_malformed", "/filter/value/1"), (wire(leaf("between", [1, 2, 3])), "value_count_mismatch", "/filter/value"),
    (wire(leaf("between", 1)), "node_malformed", "/filter/value"), (wire(leaf("prefix", "")), "value_out_of_bounds", "/filter/value"), (wire(leaf("prefix", 1)), "node_malformed", "/filter/value"), (wire(leaf("eq", None)), "node_malformed", "/filter/value"),
    (wire(leaf("eq", "x" * 4097)), "value_out_of_bounds", "/filter/value"), (wire({"op": "and", "args": []}), "value_count_mismatch", "/filter/args"), (wire({"op": "or"}), "node_malformed", "/filter"), (wire({"op": "or", "args": [1]}), "node_malformed", "/filter/args/0"),
    (wire({"op": "not"}), "node_malformed", "/filter"), (wire({"op": "and", "args": [leaf("is_null")] * 65}), "value_out_of_bounds", "/filter/args"), (wire(leaf("eq", 1, {"model": "", "name": "x"})), "node_malformed", "/filter/field/model"), (wire(leaf("eq", 1, {"model": "m"})), "node_malformed", "/filter/field/name"),
    ('{"filter": {"op": "eq", "x": "' + "y" * 65536 + '"}}', "value_out_of_bounds", ""), (wire({"op": 1}), "node_malformed", "/filter"), ('{"filter": {"op": "eq", "field": {"model": "m", "name": "s"}, "value": NaN}}', "envelope_malformed", ""),
]


@pytest.mark.parametrize("text,code,pointer", REJECTED)
def test_rejected(text, code, pointer):
    with pytest.raises(FilterError) as e:
        decode(text)
    assert (e.value.code, e.value.pointer) == (code, pointer) and e.value.code in FILTER_CODES


def test_match_all_and_limits():
    assert decode("{}") is None and decode('{"version": "1", "other": 3}') is None
    deep = leaf("is_null")
    for _ in range(7):
        deep = {"op": "not", "arg": deep}
    decode(wire(deep))
    with pytest.raises(FilterError, match="nesting_too_deep"):
        decode(wire({"op": "not", "arg": deep}))
    wide = lambda n: {"op": "and", "args": [{"op": "or", "args": [leaf("is_null")] * k} for k in n]}
    assert ast.size(decode(wire(wide([63, 63, 63, 62])))) == 256
    with pytest.raises(FilterError, match="node_count_exceeded"):
        decode(wire(wide([63, 63, 63, 63])))


def test_sets_tell_types_apart():
    tree = decode(wire(leaf("in", [1, 1.0, "1", True, 1, "1", False, 0])))
    assert [(type(v), v) for v in tree.value] == [(int, 1), (float, 1.0), (str, "1"), (bool, True), (bool, False), (int, 0)]


def test_strategy_and_flat_filters():
    a, b = ast.Leaf("eq", ast.FieldRef("m", "s"), 1), ast.Leaf("is_null", ast.FieldRef("m", "s"))
    assert ast.all_of([]) is None and ast.all_of([a]) == a and ast.all_of([a, b]) == ast.And((a, b))
    assert [ast.strategy(x) for x in (None, a, ast.And((a, b)), ast.Or((a, b)), ast.And((a, ast.Not(b))))] == ["joins", "joins", "joins", "exists", "exists"]


REG = Registry().provision(1).define(1, "m", [("s", "string"), ("i", "int"), ("n", "numeric"), ("d", "datetime"), ("j", "string", False)])


def test_preflight():
    fields = REG.view(1)
    run = lambda op, name, value=None: preflight.validate(ast.Leaf(op, ast.FieldRef("whatever", name), value), fields)
    for name, good, bad in [("s", ["x", ""], [1, True, 1.5]), ("i", [1, 2.0, -(2**63)], ["1", True, 1.5]), ("n", [1, 1.5], ["1", True]), ("d", ["2026-01-15T08:00:00Z", "2026-01-15T08:00:00.123456+05:30"], ["2026-01-15", "2026-01-15 08:00:00Z", "2026-13-15T08:00:00Z", 5])]:
        for v in good:
            run("eq", name, v)
            run("in", name, (v, v))
        for v in bad:
            for op, value in (("eq", v), ("in", (good[0], v)), ("between", (v, good[0]))):
                with pytest.raises(FilterError, match="value_type_mismatch"):
                    run(op, name, value)
    with pytest.raises(FilterError, match="value_out_of_bounds"):
        run("eq", "i", 1e30)
    with pytest.raises(UnknownField):
        run("eq", "S", "x")
    with pytest.raises(FieldNotFilterable, match="not_filterable"):
        run("eq", "j", "x")
    with pytest.raises(FilterError, match="capability_unsupported"):
        preflight.check_capability(ast.Leaf("fuzzy", ast.FieldRef("m", "s"), "x"), fields, frozenset(ast.LEAF_OPS))
    bare = Registry().define(1, "m", [("s", "string")]).view(1)
    with pytest.raises(FieldNotFilterable, match="unmapped"):
        preflight.validate(ast.Leaf("is_null", ast.FieldRef("m", "s")), bare)


def test_compiled_trees_follow_two_valued_logic(spark):
    """Random trees over every combination of value, null, and absence, against an evaluator of sets."""
    r = random.Random(7)
    fields = REG.view(1)
    values = [("a", True), ("b", True), (None, True), (None, False)]
    rows = [(k, s, p1, i, True) for k, ((s, p1), i) in enumerate(itertools.product(values, [1, 2, None]))]
    schema = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField(fields["s"].column, T.StringType()), T.StructField(fields["s"].group, T.BooleanType()), T.StructField(fields["i"].column, T.LongType()), T.StructField("x", T.BooleanType())])
    df = spark.createDataFrame(rows, schema).persist()

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            name, v = r.choice([("s", r.choice("abc")), ("i", r.choice([1, 2, 3]))])
            op = r.choice(["eq", "neq", "lt", "gte", "in", "nin", "between", "is_null", "is_not_null"])
            value = (v, v) if op == "between" else (v, "a" if name == "s" else 1) if op in ("in", "nin") else None if op.startswith("is") else v
            return ast.Leaf(op, ast.FieldRef("m", name), value)
        kind = r.choice([ast.And, ast.Or, ast.Not])
        return ast.Not(tree(depth - 1)) if kind is ast.Not else kind(tuple(tree(depth - 1) for _ in range(r.choice([1, 2, 3]))))

    def holds(n, s, p, i):
        if isinstance(n, ast.Leaf):
            x, present = (s, p) if n.field.name == "s" else (i, p)
            if n.op == "is_null":
                return present and x is None
            if n.op == "is_not_null":
                return x is not None
            if x is None:
                return False
            v = n.value
            return {"eq": lambda: x == v, "neq": lambda: x != v, "lt": lambda: x < v, "gte": lambda: x >= v, "in": lambda: x in v, "nin": lambda: x not in v, "between": lambda: v[0] <= x <= v[1]}[n.op]()
        got = [holds(c, s, p, i) for c in ast.children(n)]
        return not got[0] if isinstance(n, ast.Not) else all(got) if isinstance(n, ast.And) else any(got)

    trees = [tree(4) for _ in range(150)]
    got = df.select("entry_id", *(F.coalesce(compile_filter(t, fields), F.lit(False)).alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for g in got:
        k, s, p, i, _ = rows[g.entry_id]
        for n, t in enumerate(trees):
            assert g[f"t{n}"] == holds(t, s, p, i), (t, s, p, i)


def test_cursors_and_requests():
    for n in (0, 1, 99, 10**15):
        assert decode_cursor(encode_cursor(n)) == n
    for bad in ("", "***", encode_cursor(1)[:-1] + "!", "djI6MQ", "djE6eA"):
        with pytest.raises(InvalidCursor):
            decode_cursor(bad)
    for size in (0, 1001, -1):
        with pytest.raises(PageSizeOutOfRange):
            search.Request(1, 1, page_size=size).check(Settings())
    for t in (0, -3, True):
        with pytest.raises(InvalidTenantId):
            search.Request(t, 1).check(Settings())


def conforms(schema, value, root):
    """The few keywords that the schema uses."""
    if "$ref" in schema:
        return conforms(root["$defs"][schema["$ref"].rsplit("/", 1)[1]], value, root)
    for key, count in (("oneOf", lambda n: n == 1), ("anyOf", lambda n: n >= 1)):
        if key in schema and not count(sum(conforms(s, value, root) for s in schema[key])):
            return False
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "boolean": bool}
    wanted = schema.get("type")
    if wanted:
        wanted = wanted if isinstance(wanted, list) else [wanted]
        if not any(isinstance(value, kinds[k]) and (k == "boolean" or not isinstance(value, bool)) for k in wanted):
            return False
    if "const" in schema and value != schema["const"] or "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 10**9):
        return False
    if isinstance(value, list) and schema.get("type") == "array":
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 10**9) and all(conforms(schema["items"], v, root) for v in value)
    if isinstance(value, dict) and "properties" in schema:
        return all(k in value for k in schema["required"]) and all(k in schema["properties"] and conforms(schema["properties"][k], v, root) for k, v in value.items())
    return True


def test_schema_agrees_with_the_decoder():
    from quarryfield.plans.schema import json_schema

    schema = json_schema()
    for node in ACCEPTED:
        assert conforms(schema, json.loads(wire(node)), schema), node
    assert conforms(schema, {}, schema) and not conforms(schema, {"version": "1", "other": 3}, schema)
    for text, _code, _pointer in REJECTED:
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if len(text) < 60000 and "NaN" not in text:
            assert not conforms(schema, value, schema), text
