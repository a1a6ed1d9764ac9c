"""Schemas to depth eight, fields in the order of the text, nested attributes, files, malformed patterns."""

import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from spanloom.functions.jsonview import json_leaves
from spanloom.functions.schemas import breaches, schema_rules
from spanloom.operators import checks
from spanloom.sources.traces import decode_attributes

KEY = ["graph_id", "run_id"]


def fits(value, schema, level=0):
    """True, False, or None where both go on below level eight."""
    if not isinstance(schema, dict):
        return True
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    types = schema.get("type")
    if types is not None:
        types = types if isinstance(types, list) else [types]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (t == "number" or isinstance(value, int)) if t in ("number", "integer") else isinstance(value, kinds[t]) for t in types):
            return False
    if "enum" in schema and json.dumps(value, sort_keys=True) not in [json.dumps(x, sort_keys=True) for x in schema["enum"]]:
        return False
    if isinstance(value, dict) and not set(schema.get("required", [])) <= set(value):
        return False
    inner = [(value[k], s) for k, s in schema.get("properties", {}).items() if isinstance(value, dict) and k in value] + [(x, schema["items"]) for x in value if isinstance(value, list) and "items" in schema] if isinstance(value, (dict, list)) else []
    if level == 8:
        return None if isinstance(value, (dict, list)) and ("items" in schema or schema.get("properties")) else True
    found = [fits(v, s, level + 1) for v, s in inner]
    return False if False in found else None if None in found else True


def some_value(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice([1, -7, 2.5, "a", "b c", True, None])
    if r.random() < 0.5:
        return [some_value(r, depth - 1) for _ in range(r.randrange(3))]
    return {k: some_value(r, depth - 1) for k in r.sample(["a", "b", "c.d", "e[]"], r.randint(0, 3))}


def some_schema(r, depth):
    out = {}
    if r.random() < 0.5:
        out["type"] = r.choice(["object", "array", "string", "integer", "number", "boolean", "null", ["integer", "string"], ["object", "array", "null"], ["object", "array", "number", "string", "boolean", "null"]])
    if r.random() < 0.1:
        out["enum"] = [r.choice([1, "a", None, [1]]) for _ in range(3)]
    if r.random() < 0.1:
        out["required"] = [r.choice(["a", "b", "c.d"])]
    if depth and r.random() < 0.7:
        out["properties"] = {k: some_schema(r, depth - 1) for k in r.sample(["a", "b", "c.d", "e[]", "f"], r.randint(1, 3))}
    if depth and r.random() < 0.6:
        out["items"] = some_schema(r, depth - 1)
    return out


def nested(depth, leaf):
    return leaf if depth == 0 else {"a": nested(depth - 1, leaf)}


def nested_schema(depth, leaf):
    return leaf if depth == 0 else {"properties": {"a": nested_schema(depth - 1, leaf)}}


def test_schemas_against_recursion(spark):
    r = random.Random(6)
    cases = [(some_schema(r, 4), some_value(r, 4)) for _ in range(250)]
    cases += [(nested_schema(8, {"type": "string"}), nested(8, x)) for x in ("ok", 5)]  # depth eight decides
    cases += [(nested_schema(9, {"type": "string"}), nested(9, 5)), (nested_schema(9, {"type": "string"}), nested(3, "end"))]  # deeper isn't measured
    cases += [({**nested_schema(9, {"type": "string"}), "required": ["b"]}, nested(9, 5))]  # but a breach above counts
    want = [fits(v, s) for s, v in cases]
    assert {True, False, None} == set(want)
    contracts = spark.createDataFrame([(f"a{i}", "*", json.dumps(s), 1) for i, (s, _) in enumerate(cases)] + [("bare", "*", "no json", 1)], "agent_name string, version_glob string, json_schema string, ord int")
    outputs = [json.dumps(v) for _, v in cases]
    runs = spark.createDataFrame([(i, 0, f"a{i}", "v", t) for i, t in enumerate(outputs)] + [(900, 0, "bare", "v", "{}"), (901, 0, "a0", "v", "no json"), (902, 0, "a0", "v", None), (903, 0, "none", "v", "{}")], "graph_id long, run_id long, agent_name string, agent_version string, output string")
    got = {x.graph_id: x.schema for x in checks.schema_component(runs, contracts).collect()}
    assert got.pop(900) == 1.0 and got.pop(901) == got.pop(902) == 0.0 and 903 not in got
    assert [got[i] for i in range(len(cases))] == [None if w is None else float(w) for w in want]


def test_where_arguments_break(spark):
    rules = schema_rules(spark.createDataFrame([("t", '{"required":["id"],"properties":{"tags":{"items":{"type":"string"}}}}')], "tool string, s string"), "tool", "s")
    values = spark.createDataFrame([(1, "t", '{"tags":["x",4]}'), (2, "t", '{"id":1}')], "id long, tool string, j string").select("id", "tool", F.try_parse_json("j").alias("v"))
    assert sorted((x.id, x.path, x.reason) for x in breaches(values, ["id"], rules, "tool").collect()) == [(1, [], "required"), (1, [".tags", "[]"], "type")]


def test_claims_in_the_order_of_the_text(spark):
    texts = ['{"zeta": "later words", "alpha": {"y": "plain", "x": 12}, "list": [{"b": "two b", "a": "one a"}, "tail"], "mid": "first"}', 'see {"b": "bee one", "a": ["an item", {"d": 7, "c": 8}]} here', '["q", "zz top", {"m": "mm", "k": "abc"}]']

    def walk(v):
        for x in v.values() if isinstance(v, dict) else v:
            if isinstance(x, (dict, list)):
                yield from walk(x)
            else:
                yield x

    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "graph_id long, run_id long, output string")
    leaves = json_leaves(rows, KEY, "output", ordered=True)
    got = {x.graph_id: [y["v"] for y in sorted(x.all, key=lambda y: y["p"])] for x in leaves.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("place").alias("p"), F.col("value").alias("v"))).alias("all")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [str(x) for x in walk(json.loads(t[t.index("{" if i == 1 else t[0]) : t.rindex("}" if i == 1 else t[-1]) + 1]))]
    claims = {x.graph_id: x.claims for x in checks.structured_claims(leaves).collect()}
    assert claims[0] == ["later words", "12", "two b", "one a", "plain", "tail"]
    assert claims[2] == ["zz top", "abc"]


def test_nested_attributes(spark):
    s = lambda x: {"stringValue": x}
    bag = [{"key": "list", "value": {"arrayValue": {"values": [s("x"), {"intValue": "7"}, {"intValue": "x"}, {"boolValue": True}]}}},
           {"key": "map", "value": {"kvlistValue": {"values": [{"key": "a", "value": s("1")}, {"key": "a", "value": {"arrayValue": {"values": [s('q"q')]}}}, {"key": "b", "value": {"doubleValue": 2.5}}, {"key": "", "value": s("no key")}]}}},
           {"key": "text", "value": s('say "hi"')}, {"key": "int", "value": {"intValue": "12"}}, {"key": "bad", "value": {"intValue": "1x"}}, {"key": "flag", "value": {"boolValue": False}}, {"key": "plain", "value": "p"}, {"key": "object", "value": {"own": [1, 2]}},
           {"key": "text", "value": s("last")}, {"key": "snake", "value": {"array_value": {"values": [{"string_value": "y"}]}}}]
    rows = spark.createDataFrame([(json.dumps(bag),), (json.dumps({"k": {"kvlistValue": {"values": [{"key": "z", "value": {"kvlistValue": {"values": []}}}]}}, "n": 5}),)], "j string")
    got = [x.m for x in rows.select(decode_attributes(F.try_parse_json("j")).alias("m")).collect()]
    assert got[0]["text"] == "last" and got[0]["int"] == "12" and got[0]["bad"] is None and got[0]["flag"] == "false" and got[0]["plain"] == "p"
    assert json.loads(got[0]["list"]) == ["x", 7, None, True] and json.loads(got[0]["map"]) == {"a": ['q"q'], "b": 2.5} and json.loads(got[0]["snake"]) == ["y"] and json.loads(got[0]["object"]) == {"own": [1, 2]}
    assert json.loads(got[1]["k"]) == {"z": {}} and got[1]["n"] == "5"


def archive(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "<x/>" * 50)
    return out.getvalue()


def test_files(spark):
    good, other = archive("[Content_Types].xml", "word/document.xml"), archive("readme.txt")
    pdf = b"%PDF-1.7\n" + b"x" * 2000 + b"\n%%EOF\n"
    files = {
        "a/good.docx": (good, "zip", True), "a/cut.docx": (good[: len(good) // 2], "zip", False), "a/other.docx": (other, "zip", False), "a/sheet.XLSX": (archive("xl/workbook.xml"), "zip", True), "a/none.pptx": (b"", "empty", False),
        "a/fake.docx": (b"just text", "text", False), "a/good.pdf": (pdf, "pdf", True), "a/cut.pdf": (pdf[:500], "pdf", False), "a/fake.pdf": (b"hello %%EOF", "text", False), "a/x.json": (b'{"a": [1]}', "text", True), "a/y.json": (b'{"a": [1}', "text", False),
        "a/t.md": ("été".encode() * 2000, "text", True), "a/u.txt": (b"\xff\xfe\x00\x01" * 9, "binary", False), "a/v.html": (b"", "empty", True), "a/z.bin": (bytes(range(256)), "binary", True), "a/w": (b"x", "text", True), "a/gone.txt": (None, "missing", False),
        "a/mix.txt": (b"ab\x01\x02\x03", "binary", True), "a/edge.txt": (b"a" * 4095 + "é".encode(), "text", True)}
    got = {x.path: x for x in checks.file_meta(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, (c, *_) in files.items()], "path string, content binary")).collect()}
    assert {p: (x.detected_kind, x.parse_ok) for p, x in got.items()} == {p: tuple(v[1:]) for p, v in files.items()}
    assert got["a/sheet.XLSX"].declared_ext == "xlsx" and got["a/w"].declared_ext == "" and not got["a/none.pptx"].nonempty and got["a/gone.txt"].size == 0 and got["a/gone.txt"].sha256 is None


def test_malformed_patterns_give_nothing(spark):
    rules = spark.createDataFrame([(None, "bad", "regex", "([a-z", False), (None, "good", "regex", "^Total", True), ("w", "own", "substring", "sum", False), (None, "odd", "unknown", "x", False), ("w", "bad too", "regex", "*", False)], "agent_name string, name string, match string, pattern string, case_sensitive boolean")
    runs = spark.createDataFrame([(1, 1, "w", "Total 5"), (1, 2, "v", "the total"), (1, 3, "w", None)], "graph_id long, run_id long, agent_name string, output string")
    got = sorted((x.run_id, x.params["section"]) for x in checks.required_section(runs, rules).collect())
    assert got == [(1, "own"), (2, "good"), (3, "good"), (3, "own")]
    assert checks.required_section(runs, rules.where("name = 'bad'")).count() == 0
