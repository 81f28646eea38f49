"""The schema compiler against a slow checker, and walks against loops."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import schema as S


def slow(v, s, path, doc, refs=()):
    """A checker written value by value."""
    if s is True:
        return []
    if s is False:
        return [(path, "false")]
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"null": v is None, "boolean": isinstance(v, bool), "number": number, "integer": number and math.floor(v) == v, "string": isinstance(v, str), "array": isinstance(v, list), "object": isinstance(v, dict)}
    plain = lambda x: json.dumps(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x, sort_keys=True)
    out = []
    ok = lambda t, x=v: not slow(x, t, path, doc, refs)
    for k, w in s.items():
        bad = {
            "type": lambda: not any(kinds[t] for t in ([w] if isinstance(w, str) else w)), "enum": lambda: all(plain(v) != plain(x) for x in w), "const": lambda: plain(v) != plain(w),
            "minProperties": lambda: kinds["object"] and len(v) < w, "maxProperties": lambda: kinds["object"] and len(v) > w, "minItems": lambda: kinds["array"] and len(v) < w, "maxItems": lambda: kinds["array"] and len(v) > w,
            "uniqueItems": lambda: w and kinds["array"] and len({plain(x) for x in v}) < len(v), "contains": lambda: kinds["array"] and not any(ok(w, x) for x in v), "pattern": lambda: kinds["string"] and not re.search(w, v),
            "minLength": lambda: kinds["string"] and len(v) < w, "maxLength": lambda: kinds["string"] and len(v) > w, "minimum": lambda: number and v < w, "maximum": lambda: number and v > w, "exclusiveMinimum": lambda: number and v <= w,
            "exclusiveMaximum": lambda: number and v >= w, "multipleOf": lambda: number and v % w != 0, "anyOf": lambda: not any(map(ok, w)), "oneOf": lambda: sum(map(ok, w)) != 1, "not": lambda: ok(w),
            "additionalProperties": lambda: w is False and kinds["object"] and bool(set(v) - set(s.get("properties", {}))),
        }.get(k)
        if bad and bad():
            out.append((path, k))
        if k == "$ref":
            out += [(path, "depth")] if refs.count(w) >= S.DEPTH else slow(v, doc["$defs"][w.split("/")[-1]], path, doc, (*refs, w))
        if k == "required" and kinds["object"]:
            out += [(path, f"required {n}") for n in w if n not in v]
        if k == "properties" and kinds["object"]:
            out += [e for n, t in w.items() if n in v for e in slow(v[n], t, f"{path}.{n}", doc, refs)]
        if k == "additionalProperties" and kinds["object"] and isinstance(w, dict):
            out += [e for n in v if n not in s.get("properties", {}) for e in slow(v[n], w, f"{path}.{n}", doc, refs)]
        if k == "items" and kinds["array"]:
            out += [e for i, x in enumerate(v) if i >= len(s.get("prefixItems", [])) for e in slow(x, w, f"{path}[{i}]", doc, refs)]
        if k == "prefixItems" and kinds["array"]:
            out += [e for i, (x, t) in enumerate(zip(v, w, strict=False)) for e in slow(x, t, f"{path}[{i}]", doc, refs)]
        if k == "allOf":
            out += [e for t in w for e in slow(v, t, path, doc, refs)]
        if k == "if":
            out += slow(v, s.get("then", True) if ok(w) else s.get("else", True), path, doc, refs)
    return out


def value(rng, deep=3):
    kind = rng.randrange(9 if deep else 6)
    if kind < 6:
        return [None, rng.random() < 0.5, rng.randrange(-3, 9), rng.choice([0.5, 2.0, -1.25]), rng.choice(["", "a", "abc", "zz9", "longer text"]), rng.choice(["x", "y"])][kind]
    if kind < 7:
        return [value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {n: value(rng, deep - 1) for n in rng.sample(["a", "b", "c", "kind"], rng.randrange(4))}


SCHEMAS = [
    {"type": ["object", "array"], "properties": {"a": {"type": "integer", "minimum": 0, "exclusiveMaximum": 5}, "b": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2}}, "required": ["a", "kind"], "additionalProperties": False, "minItems": 1},
    {"properties": {"a": {"enum": ["x", 2, None, True, [1], {"a": 1}]}, "kind": {"const": 2}}, "additionalProperties": {"type": ["number", "array"], "multipleOf": 0.5}, "maxProperties": 2, "items": {"not": {"type": "null"}}, "uniqueItems": True},
    {"oneOf": [{"type": "object", "required": ["a"]}, {"type": "object", "required": ["b"]}, {"type": "array", "contains": {"type": "string"}}], "title": "told"},
    {"anyOf": [{"type": "number", "maximum": 3}, {"type": "string", "maxLength": 3}, {"type": "object"}], "if": {"type": "object", "required": ["kind"]}, "then": {"properties": {"kind": {"type": "string"}}, "minProperties": 2}, "else": {"not": {"type": "boolean"}}},
    {"$ref": "#/$defs/tree", "$defs": {"tree": {"type": ["object", "array", "null", "number"], "properties": {"a": {"$ref": "#/$defs/tree"}}, "items": {"$ref": "#/$defs/leaf"}}, "leaf": {"allOf": [{"type": ["string", "number"]}, {"minimum": 1, "exclusiveMinimum": 1}]}}},
    {"type": "array", "prefixItems": [{"type": "string"}, False], "items": {"type": "integer"}, "maxItems": 3},
]


@pytest.mark.parametrize("n", range(len(SCHEMAS)))
def test_against_the_slow_checker(spark, n):
    rng = random.Random(n)
    values = [value(rng) for _ in range(120)] + [{"a": {"a": {"a": {"a": {"a": "deep"}}}}}, {"a": 1, "kind": 1.0, "b": "ok"}]
    rows = spark.createDataFrame([(str(i), json.dumps(v)) for i, v in enumerate(values)], "id string, j string")
    got = sorted(map(tuple, S.checked(rows, "id", "j", SCHEMAS[n]).collect()))
    assert got == sorted((str(i), p, k) for i, v in enumerate(values) for p, k in slow(v, SCHEMAS[n], "$", SCHEMAS[n]))
    assert got


def test_bad_json_null_and_unknown_keywords(spark):
    rows = spark.createDataFrame([("1", "{"), ("2", None), ("3", "null")], "id string, j string")
    assert [tuple(r) for r in S.checked(rows, "id", "j", {"type": "object"}).orderBy("key").collect()] == [("1", "$", "json"), ("3", "$", "type")]
    for bad in ({"typo": 1}, {"$ref": "http://else.where/x"}):
        with pytest.raises(ValueError):
            S.violations(F.parse_json(F.lit("1")), bad)


def strings(v, path="$", name=None):
    if isinstance(v, dict):
        return [e for k, x in v.items() for e in strings(x, f"{path}.{k}", k)]
    if isinstance(v, list):
        return [e for i, x in enumerate(v) for e in strings(x, f"{path}[{i}]", name)]
    return [(path, name, v)] if isinstance(v, str) else []


def test_walk_of_any_depth(spark):
    rng = random.Random(4)

    def nest(deep):
        kind = rng.randrange(4 if deep else 2)
        if kind < 2:
            return rng.choice(["/etc/x", "C:\\data", "c:/x", "\\\\host\\x", "relative/x", "//x", "", 5, None, "x:y"])
        return [nest(deep - 1) for _ in range(rng.randrange(4))] if kind == 2 else {k: nest(deep - 1) for k in rng.sample(["path", "Root_dir", "title", "aliases", "fileName", "n"], rng.randrange(1, 5))}

    values = [nest(rng.randrange(9)) for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{bad")], "id int, j string")
    want = [(str(i), p, t) for i, v in enumerate(values) for p, n, t in strings(v) if n and any(m in n.lower() for m in S.PATH_NAMES) and re.match(S.ABSOLUTE, t)]
    assert sorted(map(tuple, S.absolute_paths(rows, "id", "j").collect())) == sorted(want) and len(want) > 50
    assert S.absolute_paths(rows.limit(0), "id", "j").collect() == []
