from larkspur.functions import validate as V

SCHEMA = {
    "type": "object",
    "properties": {
        "n": {"type": "integer", "minimum": 1, "maximum": 9},
        "x": {"type": ["number", "null"]},
        "kind": {"type": "string", "enum": ["a", "b"], "minLength": 1, "maxLength": 3},
        "flag": {"type": "boolean"},
        "note": {"anyOf": [{"type": "string", "maxLength": 2}, {"type": "null"}]},
        "list": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}},
    },
    "required": ["n", "kind"],
}


def errors(value):
    return V.check_value(V.cast_value(value, SCHEMA), SCHEMA)


def test_valid_values():
    assert errors({"n": "3", "kind": "a", "x": None, "flag": "Yes", "note": None, "list": [{"id": "7"}], "more": object}) == []
    assert V.cast_value({"n": "3", "x": "1.5", "flag": "0", "kind": 5}, SCHEMA) == {"n": 3, "x": 1.5, "flag": False, "kind": "5"}


def test_each_rule():
    good = {"n": 1, "kind": "a"}
    for change, error in (
        ({"n": 0}, "n: minimum"), ({"n": 10}, "n: maximum"), ({"n": True}, "n: integer"), ({"n": None}, "n: integer"), ({"n": "z"}, "n: integer"), ({"x": "z"}, "x: number"),
        ({"kind": "c"}, "kind: enum"), ({"flag": "perhaps"}, "flag: boolean"), ({"note": "abc"}, "note: maxLength"), ({"list": {}}, "list: array"), ({"list": [1]}, "list[0]: object"), ({"list": [{"id": 1}, {}]}, "list[1].id: required"), ({"list": [{"id": "q"}]}, "list[0].id: integer"),
    ):
        assert errors(good | change) == [error], change
    assert errors({}) == ["n: required", "kind: required"] and errors([]) == ["value: object"]
    assert errors(good | {"kind": ""}) == ["kind: enum", "kind: minLength"]


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"n": "2", "kind": "a"}'), (2, "broken"), (3, None), (None, "{}"), (4, "[1]")], "errors long, p string")  # a clashing name
    got = {r[0]: (r[1], list(r[2])) for r in V.validated(df.withColumnRenamed("errors", "id"), "id", "p", SCHEMA).collect()}
    assert got == {1: ('{"n": 2, "kind": "a"}', []), 2: (None, ["value: json"]), 3: (None, ["value: json"]), 4: ("[1]", ["value: object"])}
