"""Declared streams and streaming-SQL pipelines on Spark."""

from streamtables.plans.pipeline import MessageStep, Pipeline, Query, from_resources, from_yaml
from streamtables.sources.scan import Binding, scan
from streamtables.sources.stream import Catalog, Stream, StreamError
from streamtables.streaming.upsert import UpsertSink

__all__ = [
    "Binding",
    "Catalog",
    "MessageStep",
    "Pipeline",
    "Query",
    "Stream",
    "StreamError",
    "UpsertSink",
    "from_resources",
    "from_yaml",
    "scan",
]
