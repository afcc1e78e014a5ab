"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declared mapping, which turns the
record's layout (prompt and response, instruction and output, lists of messages) into turns of
role and text. Turns are then written with a template whose marks cannot occur inside texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.llm.common import boxed, unboxed


@dataclass(frozen=True)
class Layout:
    """A layout: single fields in order, as (role, field), or a list of messages."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"

    def paths(self) -> list[str]:
        """The paths of a record of this layout, as ``field_paths`` writes them."""
        single = [f".{field}=" for _, field in self.fields]
        if self.messages is None:
            return single
        return [*single, f".{self.messages}[]", f".{self.messages}[].{self.role}=", f".{self.messages}[].{self.text}="]


# Layouts in public use, and other names of the three roles.
LAYOUTS = (
    Layout("messages", messages="messages"),
    Layout("system+messages", (("system", "system"),), messages="messages"),
    Layout("conversations", messages="conversations", role="from", text="value"),
    Layout("system+conversations", (("system", "system"),), messages="conversations", role="from", text="value"),
    Layout("prompt+response", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt+completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("system+prompt+response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction+output", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction+input+output", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question+answer", (("user", "question"), ("assistant", "answer"))),
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Levels of a record whose paths are told apart; what lies deeper is one path.
DEPTH = 4
_DEEPER = "..."


def _variant_paths(value: Column, depth: int) -> Column:
    if depth == 0:
        return F.array(F.lit(_DEEPER))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")

    def below(name: Column, inner: Column) -> Column:
        return F.transform(_variant_paths(inner, depth - 1), lambda p: F.concat(name, p))

    of_fields = F.transform(F.map_entries(fields), lambda e: below(F.concat(F.lit("."), e["key"]), e["value"]))
    of_items = F.transform(items, lambda x: below(F.lit("[]"), x))
    return (
        F.when(fields.isNotNull(), F.flatten(of_fields))
        .when(items.isNotNull(), F.concat(F.array(F.lit("[]")), F.flatten(of_items)))
        .otherwise(F.array(F.lit("=")))
    )


def field_paths(record: Column, depth: int = DEPTH) -> Column:
    """All nested paths of a variant: of every field, and of every element of its lists.

    ``.a=`` is a single value (null too), ``.a[]`` a list, ``.a[].b=`` a field of its elements.
    """
    return F.array_distinct(_variant_paths(record, depth))


def _typed_paths(record: Column, kind: T.StructType, layouts: tuple[Layout, ...]) -> Column:
    """``field_paths`` of a struct column, without a variant, which ends at 128 MiB.

    A type names its fields whether a record has them or not. Those that no layout knows count
    where they are not null.
    """
    known = {path for layout in layouts for path in layout.paths()}

    def path(name: str, there: Column, always: Column) -> Column:
        return F.when(always if name in known else there, F.lit(name))

    def any_has(listed: Column, name: str) -> Column:
        return F.exists(listed, lambda m: m[name].isNotNull())

    def single(dtype: T.DataType) -> bool:
        return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))

    found = []
    for field in kind.fields:
        value, name, dtype = record[field.name], f".{field.name}", field.dataType
        if single(dtype):
            found.append(path(f"{name}=", value.isNotNull(), record.isNotNull()))
        elif isinstance(dtype, T.ArrayType):
            found.append(path(f"{name}[]", value.isNotNull(), record.isNotNull()))
            elements = dtype.elementType.fields if isinstance(dtype.elementType, T.StructType) else None
            filled = F.coalesce(F.size(value) > 0, F.lit(False))
            if elements is None:
                found.append(F.when(filled, F.lit(f"{name}[]=" if single(dtype.elementType) else f"{name}[]{_DEEPER}")))
            for inner in elements or []:
                there = any_has(value, inner.name)
                found.append(path(f"{name}[].{inner.name}{'=' if single(inner.dataType) else _DEEPER}", there, filled))
        else:
            found.append(F.when(value.isNotNull(), F.lit(f"{name}{_DEEPER}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _turns(record: Column, layout: Layout, typed: T.StructType | None = None) -> Column | None:
    """Turns of a variant, or of a struct of type ``typed``; None if its type has no such fields."""
    if typed is not None:
        names = [field for _, field in layout.fields] + ([layout.messages] if layout.messages else [])
        if not set(names) <= set(typed.names):
            return None
        if layout.messages is not None:
            listed = typed[layout.messages].dataType
            if not isinstance(listed, T.ArrayType) or not isinstance(listed.elementType, T.StructType):
                return None
            if not {layout.role, layout.text} <= set(listed.elementType.names):
                return None

    def text(path: str) -> Column:
        value = record[path[2:]].cast("string") if typed is not None else F.try_variant_get(record, path, "string")
        return F.coalesce(value, F.lit(""))

    single = [F.struct(F.lit(role).alias("role"), text(f"$.{field}").alias("text")) for role, field in layout.fields]
    if layout.messages is None:
        return F.array(*single)
    kind = f"array<struct<`{layout.role}` string, `{layout.text}` string>>"
    messages = F.try_variant_get(record, f"$.{layout.messages}", kind) if typed is None else record[layout.messages]
    listed = F.transform(
        F.coalesce(messages, F.array().cast(kind)) if typed is None else messages,
        lambda m: F.struct(
            F.coalesce(m[layout.role].cast("string"), F.lit("")).alias("role"),
            F.coalesce(m[layout.text].cast("string"), F.lit("")).alias("text"),
        ),
    )
    return F.concat(F.array(*single), listed) if single else listed


def canonical_turns(
    records: DataFrame,
    record: str,
    layouts: tuple[Layout, ...] = LAYOUTS,
    role_names: dict[str, str] | None = None,
    ignored: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``schema_hash``, ``layout`` and ``turns`` (array of role and text) to ``records``.

    ``record`` names a variant column, a struct column or one of JSON text. A mapping is chosen by the hash
    of all nested paths of the record, but for top-level fields ``ignored`` (such as an id). Text that is no
    JSON gives a null layout and null turns, as does a record with a field, in any element of a list, that no
    mapping covers, so no text is lost without a sign. Null fields, roles and texts are empty; an
    empty list of messages gives no turns. The three columns replace columns of ``records`` with
    these names.
    """
    names = ROLE_NAMES if role_names is None else role_names
    kind = records.schema[record].dataType
    typed = kind if isinstance(kind, T.StructType) else None
    plain = typed is not None or kind.simpleString() == "variant"
    value = F.col(record) if plain else F.try_parse_json(F.col(record).cast("string"))
    own = [c for c in records.columns if c not in ("schema_hash", "layout", "turns")]
    hashed = records.select(boxed(own), value.alias("_v"))
    paths_of = field_paths(F.col("_v")) if typed is None else _typed_paths(F.col("_v"), typed, layouts)
    if ignored:
        begins = [f".{name}{mark}" for name in ignored for mark in ("=", ".", "[")]
        paths_of = F.filter(paths_of, lambda p: ~reduce(lambda a, b: a | b, [p.startswith(x) for x in begins]))
    hashed = hashed.withColumn("schema_hash", fingerprint(paths_of))
    layout_of, turns_of = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    for layout in reversed(layouts):
        turns = _turns(F.col("_v"), layout, typed)
        if turns is None:
            continue
        variants = [layout.paths()]
        if layout.messages is not None:
            lists = f".{layout.messages}[]."
            variants.append([p for p in layout.paths() if not p.startswith(lists)])
        hit = F.lit(False)
        for paths in variants:
            hit = hit | (F.col("schema_hash") == fingerprint(F.array(*[F.lit(p) for p in paths])))
        layout_of = F.when(hit, F.lit(layout.name)).otherwise(layout_of)
        turns_of = F.when(hit, turns).otherwise(turns_of)
    renamed = F.transform(
        turns_of,
        lambda t: F.struct(_other_name(t["role"], names).alias("role"), t["text"].alias("text")),
    )
    return hashed.select(*unboxed(own), "schema_hash", layout_of.alias("layout"), renamed.alias("turns"))


def _other_name(role: Column, names: dict[str, str]) -> Column:
    result = role
    for old, new in names.items():
        result = F.when(role == old, F.lit(new)).otherwise(result)
    return result


# -- the template: <turn role>text</turn>, and a line end ---------------------------------

OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    r"""No <, > or lone \ is left: they become \l, \g and \b."""
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    r"""Undo ``escape``: every \ begins a code, so codes can be replaced one kind at a time."""
    for char, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turns(turns: Column) -> Column:
    """The turns as one text."""
    one = F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))
    )
    return F.array_join(one, "")


def loss_runs(turns: Column, learned: str = "assistant") -> Column:
    """The loss mask of the formatted text: lengths of runs without and with loss, in turn.

    Every turn has two runs without and two with loss (the text of a ``learned`` turn and a run
    of no characters), so the runs add up to the length of the text.
    """

    def runs(t: Column) -> Column:
        head = F.length(escape(t["role"])) + len(OPEN) + len(CLOSE)
        body = F.length(escape(t["text"]))
        on = F.when(t["role"] == learned, body).otherwise(0)
        return F.array(head, on, body - on + len(END), F.lit(0))

    return F.flatten(F.transform(turns, runs))


def _segments(formatted: Column) -> Column:
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""

    def turn(s: Column) -> Column:
        role = F.substring_index(s, CLOSE, 1)
        text = F.substr(s, F.length(role) + 2)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text"))

    return F.transform(_segments(formatted), turn)


def read_loss_text(formatted: Column, runs: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    by_turn = F.transform(
        _segments(formatted), lambda s, i: F.substr(s, F.get(runs, 4 * i) + 1, F.get(runs, 4 * i + 1))
    )
    return unescape(F.array_join(by_turn, ""))


def message_records(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows of single messages (``turn``, ``role``, ``text``) as one ``record`` per conversation.

    Messages are ordered by turn, then role and text, nulls first; a null conversation is one
    conversation. Records are structs, not variants, which end at 128 MiB. A conversation becomes
    one text, so it has to fit one row.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.transform(
        F.sort_array(F.collect_list(message)),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
    )
    grouped = rows.groupBy(conv).agg(listed.alias("messages"))
    return grouped.select(conv, F.struct("messages").alias("record"))
