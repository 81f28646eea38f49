"""JSON Schema compiled to expressions over VARIANT, and walks through nested values of any depth.

`violations` turns a schema document into one Column: the array of (path, keyword) that a value breaks. It knows type,
enum, const, properties, required, additionalProperties, minProperties, maxProperties, items, prefixItems, minItems,
maxItems, uniqueItems, contains, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum,
multipleOf, allOf, anyOf, oneOf, not, if/then/else and $ref into the document. Annotations are passed over, any other
keyword raises. A schema that refers to itself is unrolled `DEPTH` times; a value that goes deeper breaks `depth`.

Numbers are compared as doubles; 1.0 is an integer, and equal to 1. Arrays and objects are compared by their JSON.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.layout import settled

DEPTH = 4
ANNOTATIONS = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "then", "else"}
NOTHING = "array<struct<path:string,keyword:string>>"
# The parts of names that hold paths, and what an absolute path begins with.
PATH_NAMES = ("path", "root", "alias", "filename", "file_name")
ABSOLUTE = r"^(?:/|\\\\|[A-Za-z]:[\\/])"


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _parts(v: Column) -> Column:
    """A value with what the keywords look at: kind, members, elements, number, string."""
    members, elements = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")

    def scalar(x: Column) -> Column:
        told = F.regexp_extract(F.schema_of_variant(x["v"]), "^[A-Z]+", 0)
        number = told.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        kind = F.when(x["e"].isNotNull(), "array").when(x["m"].isNotNull(), "object").when(F.is_variant_null(x["v"]), "null").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(number, "number").otherwise("other")
        return F.struct(x["v"].alias("v"), kind.alias("kind"), x["m"].alias("m"), x["e"].alias("e"))

    def whole(x: Column) -> Column:
        return F.struct(x["v"], x["kind"], x["m"], x["e"], F.when(x["kind"] == "number", F.try_variant_get(x["v"], "$", "double")).alias("n"), F.when(x["kind"] == "string", F.try_variant_get(x["v"], "$", "string")).alias("s"))

    return _bound(_bound(F.struct(v.alias("v"), members.alias("m"), elements.alias("e")), scalar), whole)


def _equal(x: Column, wanted) -> Column:
    if wanted is None:
        return x["kind"] == "null"
    if isinstance(wanted, bool):
        return (x["kind"] == "boolean") & F.try_variant_get(x["v"], "$", "boolean").eqNullSafe(F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return x["n"].eqNullSafe(F.lit(float(wanted)))
    if isinstance(wanted, str):
        return x["s"].eqNullSafe(F.lit(wanted))
    return F.to_json(x["v"]) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(x: Column, kind: str) -> Column:
    return (x["kind"] == "number") & (x["n"] == F.floor(x["n"]).cast("double")) if kind == "integer" else x["kind"] == kind


class _Compiler:
    def __init__(self, document: dict):
        self.document = document

    def resolve(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise ValueError(f"only references into the document are known: {ref}")
        parts = [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/") if p]
        return reduce(lambda d, p: d[p], parts, self.document)

    def errors(self, v: Column, path: Column, schema, refs: tuple[str, ...] = ()) -> Column:
        """The array of (path, keyword) of a value."""
        none = F.array().cast(NOTHING)
        if schema is True or schema == {}:
            return none
        if schema is False:
            return F.array(F.struct(path.alias("path"), F.lit("false").alias("keyword")))
        return _bound(_parts(v), lambda x: self._all(x, path, schema, refs))

    # functions of one value; Spark takes a function's parameters for its own, so what they are about comes from outside
    def _if_there(self, path: Column, schema, refs: tuple[str, ...]):
        return lambda y: F.when(y.isNotNull(), self.errors(y, path, schema, refs)).otherwise(F.array().cast(NOTHING))

    def _member(self, path: Column, schema, refs: tuple[str, ...]):
        return lambda e: self.errors(e["value"], F.concat(path, F.lit("."), e["key"]), schema, refs)

    def _element(self, path: Column, schema, refs: tuple[str, ...], first: int):
        return lambda y, i: F.when(i >= first, self.errors(y, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema, refs)).otherwise(F.array().cast(NOTHING))

    def _fits(self, path: Column, schema, refs: tuple[str, ...]):
        return lambda y: F.size(self.errors(y, path, schema, refs)) == 0

    def _all(self, x: Column, path: Column, schema: dict, refs: tuple[str, ...]) -> Column:
        none = F.array().cast(NOTHING)
        found: list[Column] = []

        def tell(bad: Column, keyword: str) -> None:
            found.append(F.when(bad, F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword")))).otherwise(none))

        def sub(s) -> Column:
            return self.errors(x["v"], path, s, refs)

        def holds(s) -> Column:
            return F.size(sub(s)) == 0

        known = schema.get("properties", {})
        for word, said in schema.items():
            if word in ANNOTATIONS:
                continue
            if word == "$ref":
                if refs.count(said) >= DEPTH:
                    tell(F.lit(True), "depth")
                else:
                    found.append(self.errors(x["v"], path, self.resolve(said), (*refs, said)))
            elif word == "type":
                tell(~reduce(Column.__or__, [_is(x, t) for t in ([said] if isinstance(said, str) else said)]), word)
            elif word == "enum":
                tell(~reduce(Column.__or__, [_equal(x, w) for w in said]), word)
            elif word == "const":
                tell(~_equal(x, said), word)
            elif word == "required":
                for name in said:
                    tell((x["kind"] == "object") & ~F.map_contains_key(x["m"], name), f"required {name}")
            elif word == "properties":
                for name, s in said.items():
                    inner = F.concat(path, F.lit(f".{name}"))
                    found.append(_bound(F.try_element_at(x["m"], F.lit(name)), self._if_there(inner, s, refs)))
            elif word == "additionalProperties":
                rest = F.filter(F.map_entries(x["m"]), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
                if said is False:
                    tell((x["kind"] == "object") & (F.size(rest) > 0), word)
                elif said is not True:
                    found.append(F.when(x["kind"] == "object", F.flatten(F.transform(rest, self._member(path, said, refs)))).otherwise(none))
            elif word in ("minProperties", "maxProperties"):
                n = F.size(x["m"])
                tell((x["kind"] == "object") & (n < said if word == "minProperties" else n > said), word)
            elif word == "items":
                from_ = len(schema.get("prefixItems", []))
                found.append(F.when(x["kind"] == "array", F.flatten(F.transform(x["e"], self._element(path, said, refs, from_)))).otherwise(none))
            elif word == "prefixItems":
                for i, s in enumerate(said):
                    found.append(_bound(F.get(x["e"], i), self._if_there(F.concat(path, F.lit(f"[{i}]")), s, refs)))
            elif word in ("minItems", "maxItems"):
                n = F.size(x["e"])
                tell((x["kind"] == "array") & (n < said if word == "minItems" else n > said), word)
            elif word == "uniqueItems":
                if said:
                    tell((x["kind"] == "array") & (F.size(F.array_distinct(F.transform(x["e"], lambda y: F.to_json(y)))) < F.size(x["e"])), word)
            elif word == "contains":
                tell((x["kind"] == "array") & ~F.exists(x["e"], self._fits(path, said, refs)), word)
            elif word == "pattern":
                tell((x["kind"] == "string") & ~x["s"].rlike(said), word)
            elif word in ("minLength", "maxLength"):
                n = F.length(x["s"])
                tell((x["kind"] == "string") & (n < said if word == "minLength" else n > said), word)
            elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                n, limit = x["n"], F.lit(float(said))
                tell((x["kind"] == "number") & {"minimum": n < limit, "maximum": n > limit, "exclusiveMinimum": n <= limit, "exclusiveMaximum": n >= limit}[word], word)
            elif word == "multipleOf":
                tell((x["kind"] == "number") & (x["n"] % F.lit(float(said)) != 0), word)
            elif word == "allOf":
                found += [sub(s) for s in said]
            elif word == "anyOf":
                tell(~reduce(Column.__or__, [holds(s) for s in said]), word)
            elif word == "oneOf":
                tell(reduce(Column.__add__, [holds(s).cast("int") for s in said]) != 1, word)
            elif word == "not":
                tell(holds(said), word)
            elif word == "if":
                found.append(F.when(holds(said), sub(schema.get("then", True))).otherwise(sub(schema.get("else", True))))
            else:
                raise ValueError(f"unknown keyword {word!r}")
        return F.concat(*found) if found else none


def violations(value: Column, schema: dict | bool, root: str = "$") -> Column:
    """The array of (path, keyword) that a VARIANT breaks; empty for a valid one, null for null."""
    return F.when(value.isNotNull(), _Compiler(schema if isinstance(schema, dict) else {}).errors(value, F.lit(root), schema))


def checked(rows: DataFrame, key: str, value: str, schema: dict | bool) -> DataFrame:
    """(key, path, keyword) of all that JSON texts in a column break; a text that is no JSON breaks `json`, null breaks nothing."""
    read = rows.select(F.col(key).cast("string").alias("key"), F.col(value).isNotNull().alias("_there"), F.try_parse_json(value).alias("_v"))
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("keyword")))
    found = F.when(F.col("_there") & F.col("_v").isNull(), bad).otherwise(violations(F.col("_v"), schema))
    return read.select("key", F.explode_outer(found).alias("x")).where("x is not null").select("key", "x.path", "x.keyword")


def walked(rows: DataFrame, key: str, value: str, wanted: Column, root: str = "$") -> DataFrame:
    """(key, path, name, text) of all strings in nested VARIANT values for which `wanted` (over name and text) holds.

    One level goes in each round, until no level has objects or arrays any more; what an array holds goes by the array's
    name. A level keeps what is nested and the strings that are wanted, and is written before the next one reads it.
    """
    none = F.lit(None).cast("string")
    level = rows.select(F.col(key).cast("string").alias("key"), F.lit(root).alias("path"), none.alias("name"), F.col(value).alias("v")).where("v is not null")
    out = None
    while True:
        members, elements = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        text = F.when(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0) == "STRING", F.try_variant_get("v", "$", "string"))
        level = level.select("key", "path", "name", F.when(elements.isNotNull(), F.transform(elements, lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.col("name").alias("name"), x.alias("v")))).otherwise(
            F.transform(F.map_entries(members), lambda e: F.struct(F.concat("path", F.lit("."), e["key"]).alias("path"), e["key"].alias("name"), e["value"].alias("v")))).alias("inside"), text.alias("text"))
        level = settled(level.where(F.col("inside").isNotNull() | (F.col("text").isNotNull() & wanted)))
        found = level.where("inside is null").select("key", "path", "name", "text")
        out = found if out is None else out.unionByName(found)
        nested = level.where("inside is not null")
        if not nested.limit(1).count():
            return out
        level = nested.select("key", F.explode("inside").alias("x")).select("key", "x.*")


def absolute_paths(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, text) of absolute paths in fields whose names speak of paths, at any depth of JSON texts in a column."""
    read = rows.select(F.col(key).alias("key"), F.try_parse_json(value).alias("v"))
    named = reduce(Column.__or__, [F.contains(F.lower("name"), F.lit(n)) for n in PATH_NAMES])
    return walked(read, "key", "v", F.coalesce(named, F.lit(False)) & F.col("text").rlike(ABSOLUTE)).select("key", "path", "text")
