"""Pipelines: ordered steps over declared streams, run over tables or live."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from streamtables.functions.messages import map_messages
from streamtables.operators.checks import duplicate_keys, required_report
from streamtables.operators.ordered import settle
from streamtables.operators.versions import keep_last
from streamtables.plans.references import expand_windows, referenced_streams, resolve, split_insert, split_ranking
from streamtables.sources.scan import (
    Binding,
    as_stored,
    declared_binding,
    encode,
    read_channel,
    scan,
    scan_image,
    sink_options,
    with_time_attributes,
)
from streamtables.sources.stream import Catalog, Stream, StreamError
from streamtables.streaming.files import committed, exists, make_folder, write_numbered
from streamtables.streaming.run import BatchFolder, append_files, debug_rows, each_batch, finish, insert_by_position
from streamtables.streaming.upsert import DELETED, UpsertSink

#: Formats that are written as one folder per batch, so that a repeated batch replaces itself.
FILE_FORMATS = ("parquet", "orc", "json", "csv", "text")

Transform = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass
class Query:
    """One ``INSERT INTO target SELECT …`` statement.

    Give ``sql`` text, or a ``transform`` from the step's inputs (by stream name) plus
    ``target`` and ``inputs``. ``closed`` is SQL over the table ``closed`` or a function; a live
    run applies it to each micro-batch of the step, a batch run to the whole result. It is where
    a live pipeline ranks the rows of closed windows. ``live_sql`` replaces ``sql`` and
    ``closed`` is left to live runs if the statement ranks in place, which only a table allows.
    """

    sql: str | None = None
    target: str | None = None
    inputs: list[str] = field(default_factory=list)
    transform: Transform | None = None
    closed: str | Callable[[DataFrame], DataFrame] | None = None
    mode: str = "append"
    order: list[str] = field(default_factory=list)
    live_sql: str | None = None

    def target_name(self) -> str | None:
        if self.target or not self.sql:
            return self.target
        reference, _ = split_insert(self.sql)
        return referenced_streams(reference)[0] if reference else None

    def input_names(self) -> list[str]:
        if self.sql:
            return referenced_streams(split_insert(self.sql)[1])
        return self.inputs

    def for_live(self) -> Query:
        """The statement as a stream can run it: a ranking over counts of windows in two parts."""
        if self.live_sql or self.closed is not None or not self.sql:
            return self
        target, select = split_insert(self.sql)
        if not (parts := split_ranking(select)):
            return self
        counts, closed = parts
        return replace(self, live_sql=f"INSERT INTO {target} {counts}" if target else counts, closed=closed)

    def apply_closed(self, rows: DataFrame, live: bool = True) -> DataFrame:
        if self.closed is None or (self.live_sql and not live):
            return rows
        if callable(self.closed):
            return self.closed(rows)
        rows.createOrReplaceTempView("closed")
        return rows.sparkSession.sql(self.closed)


@dataclass
class MessageStep:
    """Apply a named message function to a source stream and write each output stream."""

    source: str
    function: str
    outputs: list[str]
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Pipeline:
    """Ordered steps over a catalog. ``bindings`` says where streams are stored when they are
    not on their broker; ``tables`` supplies streams as DataFrames; streams in ``static`` are
    read as tables in live runs."""

    catalog: Catalog
    queries: list[Query] = field(default_factory=list)
    messages: list[MessageStep] = field(default_factory=list)
    bindings: dict[str, Binding] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    static: set[str] = field(default_factory=set)
    debug_query: str | None = None
    explain_ids: list[int] = field(default_factory=list)

    # -- inputs ---------------------------------------------------------------------------

    def binding(self, name: str) -> Binding:
        return self.bindings.get(name) or declared_binding(self.catalog.get(name))

    def check(self) -> None:
        """Every referenced stream must exist and be ready before anything runs."""
        for query in self.queries:
            for name in [*query.input_names(), *filter(None, [query.target_name()])]:
                self.catalog.get(name)
        for step in self.messages:
            for name in [step.source, *step.outputs]:
                if name not in self.tables and name not in self.bindings:
                    self.catalog.get(name)

    def _input(self, spark: SparkSession, name: str, live: bool) -> DataFrame:
        stream = self.catalog.get(name)
        if name in self.tables:
            return self.tables[name]
        if self._is_upsert(stream):
            if live and name not in self.static:
                raise StreamError(
                    f"{name!r} is an upsert stream: a live query would take its updates for new rows; "
                    "list it in static to read its image as a table"
                )
            if self._keeps_image(stream):
                # A live run reads the image anew for each batch, see _start_with_images.
                return self._upsert_sink(stream, []).image(spark)
            return scan_image(spark, stream, self.binding(name))
        return scan(spark, stream, self.binding(name), streaming=live and name not in self.static)

    def _select(self, query: Query, inputs: dict[str, DataFrame], spark: SparkSession, live: bool = False) -> DataFrame:
        if query.transform:
            return query.transform(inputs)
        for name, df in inputs.items():
            df.createOrReplaceTempView(self.catalog.get(name).table)
        _, select = split_insert(query.live_sql if live and query.live_sql else query.sql)
        return spark.sql(expand_windows(resolve(select, self.catalog)))

    # -- sinks ----------------------------------------------------------------------------

    @staticmethod
    def _is_upsert(stream: Stream) -> bool:
        return stream.resolved_options()["connector"].startswith("upsert")

    def _keeps_image(self, stream: Stream) -> bool:
        """Typed upsert targets are kept as an image; message targets get key/value messages."""
        return self._is_upsert(stream) and self.binding(stream.name).layout == "typed"

    def _upsert_sink(self, stream: Stream, order: list[str]) -> UpsertSink:
        if not stream.primary_key:
            raise StreamError(f"upsert stream {stream.name!r} declares no primary key")
        read_as_messages = any(step.source == stream.name for step in self.messages)
        return UpsertSink(
            self.binding(stream.name).path, list(stream.primary_key), order, keep_changes=read_as_messages
        )

    def _stored_form(self, rows: DataFrame, stream: Stream, order: list[str] | None = None) -> DataFrame:
        """Rows as the target stores them: typed columns or messages.

        A batch of an upsert stream stored as messages sends its last row per key only.
        """
        if self.binding(stream.name).layout == "typed":
            return rows
        if self._is_upsert(stream) and not rows.isStreaming:
            keys = list(stream.primary_key) or stream.key_fields
            rows = keep_last(rows, keys, order or [c for c in rows.columns if c not in keys] or keys)
        return as_stored(encode(rows, stream), stream.resolved_options()["topic"], self.binding(stream.name).format)

    def _save(self, rows: DataFrame, target: str) -> None:
        binding = self.binding(target)
        rows.write.format(binding.format).options(**sink_options(binding)).mode("append").save(binding.path)

    # -- batch ----------------------------------------------------------------------------

    def _plans(self, spark: SparkSession) -> tuple[list[DataFrame], dict[str, DataFrame]]:
        """(rows per query, rows per target) as lazy batch plans."""
        self.check()
        plans: list[DataFrame] = []
        produced: dict[str, DataFrame] = {}
        for i, query in enumerate(self.queries):
            inputs = {n: produced[n] if n in produced else self._input(spark, n, live=False) for n in query.input_names()}
            rows = query.apply_closed(self._select(query, inputs, spark), live=False)
            target = query.target_name()
            if target:
                stream = self.catalog.get(target)
                rows = with_time_attributes(insert_by_position(rows, stream.writable_schema), stream)
            plans.append(rows)
            name = target or f"query-{i}"
            produced[name] = produced[name].unionByName(rows) if name in produced else rows
        for name, rows in produced.items():
            if name in self.catalog:
                rows.createOrReplaceTempView(self.catalog.get(name).table)
        return plans, produced

    def results(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The rows of each target stream, as one lazy batch plan.

        Later queries read earlier results directly, so Catalyst optimises across steps. Several
        queries may insert into one stream.
        """
        return self._plans(spark)[1]

    def run_batch(self, spark: SparkSession) -> None:
        """Run the queries in order over the stored streams and write every target."""
        self.check()
        for query in self.queries:
            inputs = {n: self._input(spark, n, live=False) for n in query.input_names()}
            target = self.catalog.get(query.target_name())
            rows = insert_by_position(query.apply_closed(self._select(query, inputs, spark), live=False), target.writable_schema)
            if self._keeps_image(target):
                sink = self._upsert_sink(target, query.order)
                sink.write(rows, 1 + max(committed(spark, f"{sink.path}/changes"), default=-1))
            else:
                self._save(self._stored_form(rows, target, query.order), target.name)
        for step in self.messages:
            messages = self._messages(spark, step, live=False)
            if len(step.outputs) > 1:  # the function runs once
                messages = settle(messages)
            for output in step.outputs:
                self._save(messages, output)

    # -- live -----------------------------------------------------------------------------

    def _by_target(self) -> list[list[int]]:
        """The queries by target, each target after the targets it reads.

        Queries that insert into one target run as one streaming query: two would share the
        target's batch numbers and file log, and rows would be lost.
        """
        groups: dict[str, list[int]] = {}
        for i, query in enumerate(self.queries):
            if (target := query.target_name()) is None:
                raise StreamError("a live query needs a target: INSERT INTO …")
            groups.setdefault(target, []).append(i)
        reads = {t: {n for i in g for n in self.queries[i].input_names() if n in groups and n != t} for t, g in groups.items()}
        ordered: list[list[int]] = []
        while groups:
            # In a circle of targets the one that is written first goes first.
            ready = next((t for t in groups if not reads[t] & set(groups)), next(iter(groups)))
            ordered.append(groups.pop(ready))
        return ordered

    def _check_live(self) -> None:
        """What a stream cannot do is said before anything starts."""
        self.check()
        for query in map(Query.for_live, self.queries):
            text = query.live_sql or query.sql or ""
            if re.search(r"\bROW_NUMBER\s*\(", text, re.I):
                raise StreamError(
                    "ROW_NUMBER cannot run on a stream unless it ranks a sub-query that counts per window; "
                    "give live_sql that does and rank in closed: "
                    + " ".join(text.split())[:80]
                )

    def start(self, spark: SparkSession, checkpoints: str, every: str) -> list[StreamingQuery]:
        """Start the steps, one streaming query per target, each with its own checkpoint."""
        self._check_live()
        for name in dict.fromkeys(filter(None, (q.target_name() for q in self.queries))):
            if self.binding(name).path:
                make_folder(spark, self.binding(name).path)
        started = [self._start_target(spark, g, f"{checkpoints}/query-{g[0]}", every) for g in self._by_target()]
        for i, step in enumerate(self.messages):
            started += self._start_messages(spark, step, f"{checkpoints}/messages-{i}", every)
        return started

    def replay(self, spark: SparkSession, checkpoints: str) -> list[StreamingQuery]:
        """Read what the streams hold and stop: the steps run one after the other."""
        self._check_live()
        done = [finish(self._start_target(spark, g, f"{checkpoints}/query-{g[0]}", None)) for g in self._by_target()]
        for i, step in enumerate(self.messages):
            done += [finish(q) for q in self._start_messages(spark, step, f"{checkpoints}/messages-{i}", None)]
        return done

    def _start_target(self, spark: SparkSession, numbers: list[int], checkpoint: str, every: str | None) -> StreamingQuery:
        """One streaming query for all inserts into a target."""
        queries = [self.queries[i].for_live() for i in numbers]
        target = self.catalog.get(queries[0].target_name())
        if any(self._is_kept_image(n) for q in queries for n in q.input_names()):
            if len(queries) > 1:
                raise StreamError(f"a join with an image must be the only insert into {target.name!r}")
            return self._start_with_images(spark, queries[0], target, f"query-{numbers[0]}", checkpoint, every)
        selected = []
        for query in queries:
            inputs = {n: self._input(spark, n, live=True) for n in query.input_names()}
            selected.append(self._select(query, inputs, spark, live=True))
        if len({q.mode for q in queries}) > 1:
            raise StreamError(f"inserts into {target.name!r} have different output modes")

        def finishing(query: Query, rows: DataFrame) -> DataFrame:
            return insert_by_position(query.apply_closed(rows), target.writable_schema)

        binding, mode = self.binding(target.name), queries[0].mode
        by_batch = self._is_upsert(target) or mode != "append" or any(q.closed is not None for q in queries)
        if not by_batch:
            parts = [finishing(q, rows) for q, rows in zip(queries, selected, strict=True)]
            stored = self._stored_form(reduce(DataFrame.unionByName, parts), target)
            return append_files(stored, binding.path, checkpoint, every, binding.format, **sink_options(binding))

        # The rows of each insert travel in a column of their own and are finished batch by batch.
        boxed = [
            rows.select(F.lit(i).alias("_insert"), F.struct(*rows.columns).alias(f"_rows_{i}"))
            for i, rows in enumerate(selected)
        ]
        rows = selected[0] if len(selected) == 1 else reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), boxed)

        def finished(batch: DataFrame) -> DataFrame:
            if len(queries) == 1:
                return finishing(queries[0], batch)
            own = [batch.filter(F.col("_insert") == i).select(f"_rows_{i}.*") for i in range(len(queries))]
            return reduce(DataFrame.unionByName, [finishing(q, o) for q, o in zip(queries, own, strict=True)])

        order = next((q.order for q in queries if q.order), [])
        if self._keeps_image(target):
            sink = self._upsert_sink(target, order)
            self._refuse_old_batches(spark, f"{sink.path}/changes", checkpoint)
            return each_batch(rows, lambda b, n: sink.write(finished(b), n), checkpoint, every, mode)
        to_stored = lambda batch: self._stored_form(finished(batch), target, order)
        if binding.format in FILE_FORMATS:
            self._refuse_old_batches(spark, binding.path, checkpoint)
            write = BatchFolder(binding.path, to_stored, binding.format).write
        else:  # such a sink has to recognise a repeated batch itself
            write = lambda batch, number: self._save(to_stored(batch), target.name)
        return each_batch(rows, write, checkpoint, every, mode)

    def _is_kept_image(self, name: str) -> bool:
        return name not in self.tables and name in self.static and self._keeps_image(self.catalog.get(name))

    def _start_with_images(
        self, spark: SparkSession, query: Query, target: Stream, reader: str, checkpoint: str, every: str | None
    ) -> StreamingQuery:
        """A statement that joins a stream with images of upsert streams, which change while it runs.

        The statement runs batch by batch, each over the images as they are when the batch
        begins. Nothing is carried from batch to batch, so it must not aggregate.
        """
        names = query.input_names()
        images = [n for n in names if self._is_kept_image(n)]
        moving = [n for n in names if n not in self.static]
        if len(moving) != 1:
            raise StreamError(f"a join with an image needs one stream that is not static, not {moving}")
        sinks = {n: self._upsert_sink(self.catalog.get(n), []) for n in images}
        # What the statement says is judged on its plan over empty inputs.
        empty = {n: spark.createDataFrame([], self.catalog.get(n).schema) for n in names}
        plan = self._select(query, empty, spark, live=True)._jdf.queryExecution().analyzed().toString()
        if re.search(r"\b(Aggregate|Window|Distinct|Deduplicate)\b", plan):
            raise StreamError("a statement over a changing image runs batch by batch and cannot aggregate, rank or deduplicate")

        def rows_of(batch: DataFrame, number: int) -> DataFrame:
            session = batch.sparkSession
            inputs = {n: self._input(session, n, live=False) for n in names if n not in images and n not in moving}
            inputs |= {n: sink.pinned_image(session, reader, number) for n, sink in sinks.items()}
            rows = self._select(query, {**inputs, moving[0]: batch}, session, live=True)
            return insert_by_position(query.apply_closed(rows), target.writable_schema)

        source, binding = self._input(spark, moving[0], live=True), self.binding(target.name)
        if self._keeps_image(target):
            sink = self._upsert_sink(target, query.order)
            self._refuse_old_batches(spark, f"{sink.path}/changes", checkpoint)
            write = lambda batch, number: sink.write(rows_of(batch, number), number)
        elif binding.format in FILE_FORMATS:
            self._refuse_old_batches(spark, binding.path, checkpoint)
            write = lambda batch, number: write_numbered(
                self._stored_form(rows_of(batch, number), target, query.order), binding.path, number, binding.format
            )
        else:
            write = lambda batch, number: self._save(
                self._stored_form(rows_of(batch, number), target, query.order), target.name
            )
        return each_batch(source, write, checkpoint, every)

    @staticmethod
    def _refuse_old_batches(spark: SparkSession, path: str, checkpoint: str) -> None:
        """A new checkpoint counts batches from 0, so folders of an older run would be overwritten."""
        if committed(spark, path) and not exists(spark, f"{checkpoint}/offsets"):
            raise StreamError(f"{path} holds batches of another run; keep its checkpoint or take a new folder")

    # -- message functions ----------------------------------------------------------------

    def _messages(self, spark: SparkSession, step: MessageStep, live: bool) -> DataFrame:
        if step.source in self.tables:
            messages = self.tables[step.source]
        elif live and step.source in self.catalog and self._is_upsert(self.catalog.get(step.source)):
            # Every change is a message; they are passed on as they are stored.
            stored = read_channel(spark, self.binding(step.source), live)
            messages = stored.select(F.col("key").cast("string"), F.col("value").cast("string"))
        elif step.source in self.catalog:
            messages = encode(self._input(spark, step.source, live), self.catalog.get(step.source))
            messages = messages.select("key", "value")
        else:
            # A channel without a schema: its messages are opaque text.
            stored = read_channel(spark, self.bindings[step.source], live)
            messages = stored.select(F.col("key").cast("string"), F.col("value").cast("string"))
        return map_messages(messages, step.function, step.params)

    def _start_messages(self, spark: SparkSession, step: MessageStep, checkpoint: str, every: str | None):
        declared = step.source not in self.tables and step.source in self.catalog
        stream = self.catalog.get(step.source) if declared else None
        if stream is not None and self._keeps_image(stream):
            # A keyed image is read as its change folders; each change is one message.
            changes = self._changes(spark, stream)
            mapped = map_messages(encode(changes, stream, "_deleted"), step.function, step.params)
        else:
            mapped = self._messages(spark, step, live=True)
        bindings = [self.binding(output) for output in step.outputs]
        if len(bindings) > 1 and all(b.format in FILE_FORMATS for b in bindings):
            # One query for all outputs: the source is read and the function runs once a batch.
            folders = [BatchFolder(b.path, format=b.format) for b in bindings]
            for folder in folders:
                self._refuse_old_batches(spark, folder.path, f"{checkpoint}/all")

            def write(batch: DataFrame, number: int) -> None:
                batch.persist()
                for folder in folders:
                    folder.write(batch, number)
                batch.unpersist()

            return [each_batch(mapped, write, f"{checkpoint}/all", every)]
        return [
            append_files(mapped, b.path, f"{checkpoint}/{output}", every, b.format, **sink_options(b))
            for output, b in zip(step.outputs, bindings, strict=True)
        ]

    def _changes(self, spark: SparkSession, stream: Stream) -> DataFrame:
        schema = T.StructType([*stream.writable_schema.fields, T.StructField(DELETED, T.BooleanType())])
        return spark.readStream.schema(schema).parquet(f"{self.binding(stream.name).path}/changes/b=*")

    # -- diagnostics ----------------------------------------------------------------------

    def audit(self, spark: SparkSession) -> dict[str, tuple[DataFrame, DataFrame | None]]:
        """Per target: missing values of its required columns, and repeated primary keys.

        Neither constraint is enforced on write, so these reports show what breaks them.
        """
        reports: dict[str, tuple[DataFrame, DataFrame | None]] = {}
        for name, rows in self.results(spark).items():
            if name in self.catalog:
                stream = self.catalog.get(name)
                required = [f.name for f in stream.writable_schema.fields if not f.nullable]
                repeated = duplicate_keys(rows, list(stream.primary_key)) if stream.primary_key else None
                reports[name] = (required_report(rows, required), repeated)
        return reports

    def tables_in_use(self) -> list[Stream]:
        names = [n for q in self.queries for n in [*filter(None, [q.target_name()]), *q.input_names()]]
        return [self.catalog.get(n) for n in dict.fromkeys(names)]

    def explain(self, spark: SparkSession, ids: list[int] | None = None) -> dict[int, str]:
        """Plans of statements by number: the tables in use come first, then the queries."""
        tables = self.tables_in_use()
        plans, _ = self._plans(spark)
        texts: dict[int, str] = {}
        for i in self.explain_ids if ids is None else ids:
            if i < len(tables):
                texts[i] = f"{tables[i].table}: {tables[i].schema.simpleString()}"
                continue
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                plans[i - len(tables)].explain("formatted")
            texts[i] = out.getvalue()
        return texts

    def debug(self, spark: SparkSession, stored: bool = False) -> DataFrame:
        """The debug query with its row kind, over the batch plan or over the stored targets."""
        if not self.debug_query:
            raise ValueError("the pipeline declares no debug query")
        if stored:
            for stream in self.tables_in_use():
                self._input(spark, stream.name, live=False).createOrReplaceTempView(stream.table)
        else:
            self.results(spark)
        return debug_rows(spark.sql(resolve(self.debug_query, self.catalog)))


def from_resources(
    documents: list[dict[str, Any]],
    schema_texts: Mapping[str, str] | None = None,
    functions: Mapping[str, str] | None = None,
    live: Mapping[str, Mapping[str, Any]] | None = None,
) -> list[Pipeline]:
    """Pipelines of a list of resources (loaded YAML documents): streams and processors.

    Streams without a data schema are message channels. ``functions`` names the message
    function that stands for a container; by default it is the container's own name. ``live``
    gives, by target stream, the live form of its statements: ``live_sql``, ``closed``, ``order``.
    """
    texts, names = schema_texts or {}, functions or {}

    def statement(text: str) -> Query:
        query = Query(sql=text)
        return replace(query, **(live or {}).get(query.target_name() or "", {}))

    streams = [d for d in documents if d and d.get("kind") == "Stream"]
    catalog = Catalog()
    for d in streams:
        if d["spec"].get("dataSchemaContext"):
            catalog.add(Stream.from_dict(d, texts.get(d["metadata"]["name"])))
    pipelines = []
    for d in documents:
        if not d or d.get("kind") != "Processor":
            continue
        spec = d["spec"]
        inputs, debug = spec.get("inputs") or {}, (spec.get("inputs") or {}).get("debug") or {}
        pipeline = Pipeline(
            catalog,
            queries=[statement(text) for text in inputs.get("query") or []],
            debug_query=debug.get("query"),
            explain_ids=list(debug.get("explain") or []),
        )
        containers = (((spec.get("template") or {}).get("spec")) or {}).get("containers") or []
        for source in inputs.get("sources") or []:
            for container in containers:
                params = {e["name"]: e["value"] for e in container.get("env") or []}
                function = names.get(container["name"], container["name"])
                outputs = [o["name"] for o in spec.get("outputs") or []]
                pipeline.messages.append(MessageStep(source["name"], function, outputs, params))
        pipelines.append(pipeline)
    return pipelines


def from_yaml(text: str, **names: Mapping[str, str]) -> list[Pipeline]:
    """Pipelines of a YAML text with several documents (needs PyYAML)."""
    import yaml

    return from_resources(list(yaml.safe_load_all(text)), **names)
