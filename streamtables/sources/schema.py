"""Schema spellings of a declared stream, all turned into one ``StructType``.

Three spellings are accepted: a field list, the columns of a CREATE TABLE text, and an
Avro record. Nothing is inferred from data.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Type names of the field-list spelling and the Avro primitives.
PRIMITIVES: dict[str, T.DataType] = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
}

# Logical types by the primitive they annotate.
LOGICAL_TYPES: dict[tuple[str, str], T.DataType] = {
    ("int", "date"): T.DateType(),
    ("long", "timestamp-millis"): T.TimestampType(),
    ("long", "timestamp-micros"): T.TimestampType(),
    ("long", "local-timestamp-millis"): T.TimestampNTZType(),
    ("long", "local-timestamp-micros"): T.TimestampNTZType(),
}

# Column types of the CREATE TABLE spelling. Small integers widen to int.
SQL_TYPES: dict[str, T.DataType] = {
    "NULL": T.NullType(),
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.IntegerType(),
    "SMALLINT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}

PROCTIME = "proctime"


@dataclass(frozen=True)
class MetadataColumn:
    """A column taken from the message envelope instead of the payload."""

    name: str
    type: T.DataType
    source: str
    readonly: bool = False
    optional: bool = False


@dataclass
class Columns:
    """What one schema text declares."""

    table: str
    payload: T.StructType
    metadata: dict[str, MetadataColumn] = field(default_factory=dict)
    time_attributes: dict[str, str] = field(default_factory=dict)


def primitive(name: str, logical: str | None = None) -> T.DataType:
    """Spark type of a primitive name, plain (``long``) or with a logical type
    (``long_timestamp-millis``)."""
    if logical is None and "_" in name:
        name, logical = name.split("_")[:2]
    base = name.lower()
    if base not in PRIMITIVES:
        raise ValueError(f"unknown type {name!r}")
    if not logical:
        return PRIMITIVES[base]
    if logical == "decimal":
        return T.DecimalType(10, 0)
    return LOGICAL_TYPES.get((base, logical), PRIMITIVES[base])


def metadata_column(spec: dict[str, Any]) -> MetadataColumn:
    envelope = spec.get("metadata") or {}
    return MetadataColumn(
        name=spec["name"],
        type=primitive(spec["type"], spec.get("logicalType")),
        source=envelope.get("from") or spec["name"],
        readonly=bool(envelope.get("readonly")),
        optional=bool(spec.get("optional")),
    )


def from_fields(
    table: str,
    fields: list[dict[str, Any]],
    outer_metadata: dict[str, MetadataColumn] | None = None,
    outer_time: dict[str, str] | None = None,
) -> Columns:
    """Field-list spelling. Declarations outside the field list win over those inside it."""
    metadata = dict(outer_metadata or {})
    time_attributes = dict(outer_time or {})
    payload: list[T.StructField] = []
    for spec in fields:
        name, is_proctime = spec["name"], spec["type"].lower() == PROCTIME
        if is_proctime or (spec.get("watermark") or "").strip():
            time_attributes.setdefault(name, spec.get("watermark") or "")
        if spec.get("metadata") and name not in metadata:
            metadata[name] = metadata_column(spec)
        if name not in metadata and not is_proctime:
            dtype = primitive(spec["type"], spec.get("logicalType"))
            payload.append(T.StructField(name, dtype, bool(spec.get("optional"))))
    return Columns(table, T.StructType(payload), metadata, time_attributes)


_CREATE = re.compile(r"^\s*CREATE\s+TABLE\s+`?(\w+)`?\s*\((.*)\)[^)]*$", re.I | re.S)
_COLUMN = re.compile(r"^`?(\w+)`?\s+(\w+)\s*(?:\(([\d\s,]*)\))?(.*)$", re.S)
_COMPUTED = re.compile(r"^`?(\w+)`?\s+AS\s+PROCTIME\s*\(\s*\)$", re.I)
_WATERMARK = re.compile(r"^WATERMARK\s+FOR\s+`?(\w+)`?\s+AS\s+(.*)$", re.I | re.S)
_METADATA = re.compile(r"\bMETADATA(?:\s+FROM\s+'([^']+)')?(\s+VIRTUAL)?", re.I)


def sql_type(name: str, arguments: str | None = None) -> T.DataType:
    """Spark type of a declared SQL column type; nested types are refused."""
    upper = name.upper()
    if upper in ("DECIMAL", "NUMERIC"):
        digits = [int(a) for a in (arguments or "10,0").split(",")]
        return T.DecimalType(digits[0], digits[1] if len(digits) > 1 else 0)
    if upper not in SQL_TYPES:
        raise ValueError(f"unsupported SQL column type {name!r}")
    if upper == "TIMESTAMP" and arguments and int(arguments) > 3:
        raise ValueError("timestamps carry milliseconds: use TIMESTAMP(3)")
    return SQL_TYPES[upper]


def from_sql(text: str) -> Columns:
    """CREATE TABLE spelling; only the first statement counts."""
    match = _CREATE.match(text.split(";")[0])
    if not match:
        raise ValueError("the first statement must be CREATE TABLE name (columns)")
    columns = Columns(match.group(1), T.StructType([]))
    # Commas inside type arguments, as in DECIMAL(10,2), do not separate columns.
    for item in re.split(r",(?![^(]*\))", match.group(2)):
        item = item.strip()
        if found := _WATERMARK.match(item):
            columns.time_attributes[found.group(1)] = found.group(2).strip()
        elif found := _COMPUTED.match(item):
            columns.time_attributes.setdefault(found.group(1), "")
        else:
            found = _COLUMN.match(item)
            if not found:
                raise ValueError(f"cannot read column definition {item!r}")
            name, type_name, arguments, rest = found.groups()
            dtype = sql_type(type_name, arguments)
            required = re.search(r"\bNOT\s+NULL\b", rest, re.I) is not None
            if envelope := _METADATA.search(rest):
                columns.metadata[name] = MetadataColumn(
                    name, dtype, envelope.group(1) or name, bool(envelope.group(2)), not required
                )
            else:
                columns.payload.add(T.StructField(name, dtype, not required))
    return columns


def avro_type(node: Any, named: dict[str, T.DataType]) -> tuple[T.DataType, bool]:
    """Spark type and nullability of an Avro type node."""
    if isinstance(node, list):
        branches = [b for b in node if b != "null"]
        if len(branches) != 1:
            raise ValueError(f"only unions of null and one type are supported: {node}")
        return avro_type(branches[0], named)[0], len(branches) < len(node)
    if isinstance(node, str):
        return named.get(node) or primitive(node), node == "null"
    kind = node["type"]
    if isinstance(kind, (dict, list)):
        return avro_type(kind, named)
    if kind == "record":
        members = []
        for member in node["fields"]:
            dtype, nullable = avro_type(member["type"], named)
            members.append(T.StructField(member["name"], dtype, nullable))
        result: T.DataType = T.StructType(members)
    elif kind == "array":
        dtype, nullable = avro_type(node["items"], named)
        return T.ArrayType(dtype, nullable), False
    elif kind == "map":
        dtype, nullable = avro_type(node["values"], named)
        return T.MapType(T.StringType(), dtype, nullable), False
    elif node.get("logicalType") == "decimal":
        result = T.DecimalType(int(node.get("precision", 10)), int(node.get("scale", 0)))
    elif kind == "enum":
        result = T.StringType()
    elif kind == "fixed":
        result = T.BinaryType()
    else:
        return (named.get(kind) or primitive(kind, node.get("logicalType") or "")), False
    if "name" in node:
        named[node["name"]] = result
    return result, False


def from_avro_record(text: str | dict[str, Any]) -> Columns:
    """Avro record spelling."""
    record = json.loads(text) if isinstance(text, str) else text
    if not isinstance(record, dict) or record.get("type") != "record":
        raise ValueError("an Avro record is required")
    payload, _ = avro_type(record, {})
    return Columns(record["name"], payload)


# Avro spelling of the Spark types, for to_avro / from_avro.
_TO_AVRO: dict[type, Any] = {
    T.NullType: "null",
    T.BooleanType: "boolean",
    T.IntegerType: "int",
    T.LongType: "long",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.BinaryType: "bytes",
    T.StringType: "string",
    T.DateType: {"type": "int", "logicalType": "date"},
    T.TimestampType: {"type": "long", "logicalType": "timestamp-millis"},
    T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-millis"},
}


def avro_node(dtype: T.DataType, name: str) -> Any:
    if isinstance(dtype, T.StructType):
        members = []
        for f in dtype.fields:
            node = avro_node(f.dataType, f"{name}_{f.name}")
            members.append({"name": f.name, "type": ["null", node] if f.nullable else node})
        return {"type": "record", "name": name, "fields": members}
    if isinstance(dtype, T.ArrayType):
        node = avro_node(dtype.elementType, f"{name}_item")
        return {"type": "array", "items": ["null", node] if dtype.containsNull else node}
    if isinstance(dtype, T.MapType):
        node = avro_node(dtype.valueType, f"{name}_value")
        return {"type": "map", "values": ["null", node] if dtype.valueContainsNull else node}
    if isinstance(dtype, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": dtype.precision, "scale": dtype.scale}
    return _TO_AVRO[type(dtype)]


def to_avro_record(name: str, payload: T.StructType) -> str:
    """The payload as an Avro record text."""
    return json.dumps(avro_node(payload, name))
