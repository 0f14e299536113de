"""Contracts of records as JSON Schema: their types for Spark, and what a record breaks, as columns.

A record is parsed as a variant, so a field keeps whatever kind it has; each rule of the contract is a column
expression over it, found by recursion through the schema. A record comes out with the list of what it breaks,
and in types with whatever fits them. Good and bad records are two results of one pass: nothing is dropped, and no
record stops a job.

Understood are type (with lists of types), properties, required, additionalProperties: false, items, enum, pattern
(that of the JVM), minimum, maximum, format date and date-time, oneOf, and $ref within the document. Other words of
a schema are refused, so that no rule is passed over in silence. Of a list the rules hold for each item. Null text and text that
is no JSON break the contract as a whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that state no rule.
_SILENT = {"$schema", "$id", "$defs", "title", "description", "default", "examples"}
_RULES = {"type", "properties", "required", "additionalProperties", "items", "enum", "pattern", "minimum", "maximum", "format", "oneOf", "$ref"}
_KINDS = {"integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID"}
_TYPES = {"integer": T.LongType(), "number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _with(value: Column, of) -> Column:
    """of(value), with the value worked out once however often it stands in there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


class Contract:
    """The schema of one record; that of a list of records stands for its items."""

    def __init__(self, schema: dict | str):
        self.root = json.loads(schema) if isinstance(schema, str) else schema
        top = self._node(self.root)
        self.record = self._node(top["items"]) if top.get("type") == "array" else top

    def _node(self, node: dict) -> dict:
        if strange := set(node) - _RULES - _SILENT:
            raise ValueError(f"rules that aren't understood: {', '.join(sorted(strange))}")
        if "$ref" not in node:
            return node
        found = self.root
        for part in node["$ref"].removeprefix("#/").split("/"):
            found = found[part]
        return self._node(found)

    def _kinds(self, node: dict) -> list[str]:
        kinds = node.get("type", [])
        return [kinds] if isinstance(kinds, str) else list(kinds)

    def spark_type(self, node: dict | None = None) -> T.DataType:
        """What a value is read as: of several kinds a string, which takes all of them; dates as such where the format says so."""
        node = self._node(node) if node is not None else self.record
        if "oneOf" in node:
            others = [o for o in map(self._node, node["oneOf"]) if self._kinds(o) != ["null"]]
            return self.spark_type(others[0]) if len(others) == 1 else T.StringType()
        kinds = [k for k in self._kinds(node) if k != "null"]
        if kinds == ["object"]:
            return T.StructType([T.StructField(n, self.spark_type(p)) for n, p in node.get("properties", {}).items()])
        if kinds == ["array"]:
            return T.ArrayType(self.spark_type(node.get("items", {"type": "string"})))
        if kinds == ["string"] and node.get("format") in ("date", "date-time"):
            return T.DateType() if node["format"] == "date" else T.TimestampType()
        return _TYPES[kinds[0]] if len(kinds) == 1 else T.StringType()

    def _rules(self, node: dict, at: Column):
        return lambda value: self.broken(value, node, at)

    def broken(self, value: Column, node: dict, at: Column) -> Column:
        """An array of what a variant breaks. at: its place, as text."""
        node = self._node(node)
        none = F.array().cast("array<string>")
        said = lambda wrong, what: F.when(wrong, F.array(F.concat(at, F.lit(f": {what}")))).otherwise(none)
        if "oneOf" in node:
            options = [self.broken(value, o, at) for o in node["oneOf"]]
            if len(options) == 2 and ["null"] in [self._kinds(self._node(o)) for o in node["oneOf"]]:
                rest = next(b for b, o in zip(options, node["oneOf"], strict=True) if self._kinds(self._node(o)) != ["null"])
                return F.when(F.is_variant_null(value), none).otherwise(rest)
            fits = sum((F.size(b) == 0).cast("int") for b in options)
            return said(fits != 1, "not one of its alternatives")
        kinds = self._kinds(node)
        kind = F.schema_of_variant(value)
        rules, text = [], F.try_variant_get(value, "$", "string")
        is_a = lambda *names: kind.rlike("^(" + "|".join(_KINDS[n] for n in names) + ")$")
        if kinds:
            rules.append(said(~is_a(*kinds), "not " + " or ".join(kinds)))
        if "enum" in node:
            rules.append(said(is_a("string") & ~text.isin(*[e for e in node["enum"] if isinstance(e, str)]), "not among its values"))
        if "pattern" in node:
            rules.append(said(is_a("string") & ~text.rlike(node["pattern"]), "not of its pattern"))
        if node.get("format") in ("date", "date-time"):
            whole = r"^\d{4}-\d{2}-\d{2}$" if node["format"] == "date" else r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}"
            rules.append(said(is_a("string") & ~(text.rlike(whole) & text.try_cast("timestamp").isNotNull()), f"no {node['format']}"))
        number = F.try_variant_get(value, "$", "double")
        for word, wrong in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m)):
            if word in node:
                rules.append(said(is_a("number") & wrong(node[word]), f"beyond its {word}"))
        if "object" in kinds:
            properties = node.get("properties", {})

            def of_fields(fields: Column) -> Column:
                found = []
                for name in dict.fromkeys([*node.get("required", []), *properties]):
                    place = F.concat(at, F.lit(f".{name}"))
                    inner = _with(fields[name], self._rules(properties[name], place)) if name in properties else none
                    missing = F.array(F.concat(place, F.lit(": missing"))) if name in node.get("required", []) else none
                    found.append(F.when(F.map_contains_key(fields, name), inner).otherwise(missing))
                if node.get("additionalProperties") is False:
                    more = F.array_except(F.map_keys(fields), F.array(*map(F.lit, properties)).cast("array<string>"))
                    found.append(F.transform(F.array_sort(more), lambda k: F.concat(at, F.lit("."), k, F.lit(": unknown"))))
                return F.concat(*found) if found else none

            rules.append(F.when(is_a("object"), _with(F.try_variant_get(value, "$", "map<string,variant>"), of_fields)).otherwise(none))
        if "array" in kinds and "items" in node:
            items = F.try_variant_get(value, "$", "array<variant>")
            inner = F.flatten(F.transform(items, lambda v, i: self.broken(v, node["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            rules.append(F.when(is_a("array"), inner).otherwise(none))
        return F.concat(*rules) if rules else none


def checked(rows: DataFrame, contract: Contract, text: str, errors: str = "errors", record: str = "record") -> DataFrame:
    """rows with two more columns: what the text breaks, empty where nothing, and the record in types, null where it breaks anything."""
    found = _with(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(contract.broken(v, contract.record, F.lit("$"))))
    rows = rows.withColumn(errors, found)
    return rows.withColumn(record, F.when(F.size(errors) == 0, F.from_json(text, contract.spark_type())))


def parted(checked_rows: DataFrame, errors: str = "errors", record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Good records without their errors, and bad ones with theirs and the text as it was."""
    return checked_rows.where(F.size(errors) == 0).drop(errors), checked_rows.where(F.size(errors) > 0).drop(record)


#: What a trade of a feed must hold to be merged.
TRADE = {
    "type": "object", "required": ["_txId", "_politicianId", "txType", "txDate", "value"],
    "properties": {
        "_txId": {"type": "integer", "minimum": 0}, "_politicianId": {"type": "string", "pattern": r"^[A-Z]\d{6}$"}, "txType": {"type": "string", "enum": ["buy", "sell", "exchange", "receive"]}, "txDate": {"type": "string", "format": "date"},
        "value": {"type": "integer"}, "size": {"type": ["integer", "null"]}, "labels": {"type": "array", "items": {"type": "string"}}, "issuer": {"type": "object", "required": ["issuerTicker"], "properties": {"issuerTicker": {"type": ["string", "null"]}}},
    },
}
