"""Declared streams: typed columns, time attributes, keys and format options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from streamtables.sources import schema as S

OPTION_PREFIX = "ddl."
RAW_KEY = "the_kafka_key"

_INTERVAL = re.compile(
    r"^\s*`?(?P<col>\w+)`?\s*-\s*INTERVAL\s+'?(?P<n>\d+(?:\.\d+)?)'?\s+(?P<unit>[A-Za-z]+)\s*$", re.I
)
# Interval units a watermark may use.
_UNITS = ("millisecond", "second", "minute", "hour", "day", "week")


class StreamError(ValueError):
    """A stream declaration or reference that cannot be used."""


def watermark_delay(column: str, text: str) -> str:
    """Delay of a watermark written as ``column - INTERVAL 'n' UNIT``, or ``column`` alone."""
    if text.strip().strip("`") == column:
        return "0 seconds"
    match = _INTERVAL.match(text)
    unit = match and match["unit"].lower().rstrip("s")
    if not match or match["col"] != column or unit not in _UNITS:
        raise StreamError(f"watermark of {column!r} must read `{column}` - INTERVAL 'n' UNIT, got {text!r}")
    return f"{match['n']} {unit}s"


@dataclass
class Stream:
    """One declared stream. ``payload`` holds the message columns only."""

    name: str
    table: str
    payload: T.StructType
    metadata: dict[str, S.MetadataColumn] = field(default_factory=dict)
    time_attributes: dict[str, str] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)
    protocol: str = "kafka"
    servers: dict[str, str] = field(default_factory=dict)
    ready: bool = True

    # -- construction ---------------------------------------------------------------------

    @classmethod
    def declare(
        cls,
        name: str,
        *,
        fields: list[dict[str, Any]] | None = None,
        sql: str | None = None,
        avro: str | dict[str, Any] | None = None,
        table: str | None = None,
        metadata: list[dict[str, Any]] | None = None,
        time_attributes: dict[str, str] | None = None,
        primary_key: list[str] | tuple[str, ...] = (),
        options: dict[str, str] | None = None,
        protocol: str = "kafka",
        servers: dict[str, str] | None = None,
    ) -> "Stream":
        """Declare a stream in one of the spellings; inline texts win over the field list."""
        outer_metadata = {m["name"]: S.metadata_column(m) for m in metadata or []}
        outer_time = dict(time_attributes or {})
        if sql is not None:
            columns = S.from_sql(sql)
        elif avro is not None:
            columns = S.from_avro_record(avro)
        elif fields is not None:
            columns = S.from_fields(table or name, fields, outer_metadata, outer_time)
        else:
            raise StreamError(f"stream {name!r} has no data schema")
        stream = cls(
            name=name,
            table=table or columns.table,
            payload=columns.payload,
            metadata={**columns.metadata, **outer_metadata},
            time_attributes={**columns.time_attributes, **outer_time},
            primary_key=tuple(primary_key),
            options=dict(options or {}),
            protocol=protocol,
            servers=dict(servers or {}),
        )
        stream.check()
        return stream

    @classmethod
    def from_dict(cls, resource: dict[str, Any], schema_text: str | None = None) -> "Stream":
        """Read a stream resource as written in YAML.

        ``schema_text`` supplies the Avro record of a stream whose schema lives in a registry.
        """
        name, spec = resource["metadata"]["name"], resource["spec"]
        context = spec.get("dataSchemaContext")
        if not context:
            raise StreamError(f"stream {name!r} has no data schema")
        inline, listed = context.get("inline"), context.get("schema")
        spelling: dict[str, Any] = {}
        if inline:
            kind = inline["type"].lower()
            if kind == "avro-confluent":
                if schema_text is None:
                    raise StreamError(f"pass the registry's schema text for stream {name!r}")
                spelling["avro"] = schema_text
            elif kind in ("sql", "avro"):
                spelling[kind] = inline["schema"]
            else:
                raise StreamError(f"unknown schema spelling {inline['type']!r}")
        elif listed:
            spelling.update(fields=listed["fields"], table=listed["name"])
        addresses = ((resource.get("status") or {}).get("storageAddress") or {}).get("servers") or {}
        variables = next(iter(addresses.values()), {}).get("variables") or {}
        return cls.declare(
            name,
            **spelling,
            metadata=context.get("metadataFields"),
            time_attributes={t["name"]: t.get("watermark") or "" for t in context.get("timeAttributes") or []},
            primary_key=context.get("primaryKey") or (),
            options=context.get("options"),
            protocol=spec.get("protocol", "kafka"),
            servers=variables,
        )

    # -- derived facts --------------------------------------------------------------------

    def resolved_options(self) -> dict[str, str]:
        """Format options without their prefix; inferred values replace user ones."""
        options = {
            key[len(OPTION_PREFIX):]: value
            for key, value in self.options.items()
            if key.startswith(OPTION_PREFIX)
        }
        value_format = options.get("value.format", "avro")
        inferred = {
            "value.format": value_format,
            "connector": options.get("connector", self.protocol),
            "topic": self.name,
        }
        if "brokers" in self.servers:
            inferred["properties.bootstrap.servers"] = self.servers["brokers"]
        if value_format.lower() == "avro":
            inferred |= {"key.format": "raw", "key.fields": RAW_KEY, "value.fields-include": "EXCEPT_KEY"}
            if registry := (self.servers.get("schemaRegistry") or "").strip():
                inferred |= {"value.format": "avro-confluent", "value.avro-confluent.url": registry}
        elif value_format.lower() == "json":
            inferred |= {
                "key.format": "json",
                "value.format": "json",
                "key.json.ignore-parse-errors": "true",
                "value.json.fail-on-missing-field": "false",
                "value.fields-include": "ALL",
            }
        return options | inferred

    @property
    def key_fields(self) -> list[str]:
        options = self.resolved_options()
        if "key.fields" in options:
            return [k.strip() for k in options["key.fields"].split(",")]
        return list(self.primary_key) if options["connector"].startswith("upsert") else []

    @property
    def raw_key_columns(self) -> list[str]:
        """Key columns that exist only in the message key."""
        options = self.resolved_options()
        if options.get("key.format", "").lower() != "raw":
            return []
        return [k for k in self.key_fields if k not in self.payload.names and k not in self.metadata]

    @property
    def schema(self) -> T.StructType:
        """All stored columns in order: payload, raw key, metadata."""
        extra = [T.StructField(k, T.StringType(), False) for k in self.raw_key_columns]
        extra += [T.StructField(m.name, m.type, m.optional) for m in self.metadata.values()]
        return T.StructType(list(self.payload.fields) + extra)

    @property
    def writable_schema(self) -> T.StructType:
        """Columns a query inserts: everything except read-only metadata and raw keys."""
        return T.StructType(
            list(self.payload.fields)
            + [T.StructField(m.name, m.type, m.optional) for m in self.metadata.values() if not m.readonly]
        )

    @property
    def required_columns(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    @property
    def event_time(self) -> tuple[str, str] | None:
        """Column and delay of the event-time attribute, if one is declared."""
        stored = set(self.schema.names)
        for column, text in self.time_attributes.items():
            if column in stored and text.strip():
                return column, watermark_delay(column, text)
        return None

    @property
    def proctime_columns(self) -> list[str]:
        stored = set(self.schema.names)
        return [c for c, text in self.time_attributes.items() if c not in stored and not text.strip()]

    def avro_schema(self) -> str:
        return S.to_avro_record(self.table, self.payload)

    def check(self) -> None:
        stored = set(self.schema.names)
        for column, text in self.time_attributes.items():
            if text.strip():
                if column not in stored:
                    raise StreamError(f"table {self.table!r} has no column {column!r} for its watermark")
                watermark_delay(column, text)
        if missing := [k for k in self.primary_key if k not in stored]:
            raise StreamError(f"primary key columns {missing} are not in table {self.table!r}")


class Catalog:
    """Declared streams by name."""

    def __init__(self, *streams: Stream):
        self._streams = {s.name: s for s in streams}

    def add(self, stream: Stream) -> "Catalog":
        self._streams[stream.name] = stream
        return self

    def get(self, name: str) -> Stream:
        stream = self._streams.get(name)
        if stream is None:
            raise StreamError(f"missing stream: {name}")
        if not stream.ready:
            raise StreamError(f"stream not ready: {name}")
        return stream

    def __contains__(self, name: str) -> bool:
        return name in self._streams

    def __iter__(self):
        return iter(self._streams.values())
