"""Message functions: named user functions over the text of a message.

A function is registered under a name as a factory. The factory receives string parameters and
returns a Series-to-Series function, which Spark runs on Arrow batches inside its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TextFunction = Callable[[pd.Series], pd.Series]
Factory = Callable[[Mapping[str, str]], TextFunction]

_FACTORIES: dict[str, Factory] = {}
_EXPRESSIONS: dict[str, Callable[[Column], Column]] = {"uppercase": F.upper, "lowercase": F.lower}


def register(name: str) -> Callable[[Factory], Factory]:
    """Register a message function factory under a name."""

    def keep(factory: Factory) -> Factory:
        _FACTORIES[name] = factory
        return factory

    return keep


@register("uppercase")
def _uppercase(params: Mapping[str, str]) -> TextFunction:
    return lambda texts: texts.str.upper()


@register("lowercase")
def _lowercase(params: Mapping[str, str]) -> TextFunction:
    return lambda texts: texts.str.lower()


def message_function(name: str, params: Mapping[str, str] | None = None, prefer_builtin: bool = True):
    """Column function registered under ``name``.

    A name that Spark has as a built-in expression stays inside the JVM unless
    ``prefer_builtin`` is off.
    """
    if prefer_builtin and name in _EXPRESSIONS:
        return _EXPRESSIONS[name]
    if name not in _FACTORIES:
        raise KeyError(f"no message function named {name!r}")
    apply = _FACTORIES[name](dict(params or {}))

    def call(texts: pd.Series) -> pd.Series:
        return apply(texts)

    return F.pandas_udf(call, "string")


def map_messages(
    df: DataFrame,
    name: str,
    params: Mapping[str, str] | None = None,
    column: str = "value",
    prefer_builtin: bool = True,
) -> DataFrame:
    """Apply a named function to the message column, one message in and one out."""
    return df.withColumn(column, message_function(name, params, prefer_builtin)(F.col(column)))
