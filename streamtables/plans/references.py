"""Stream references and window table functions inside query text."""

from __future__ import annotations

import re

from streamtables.sources.stream import Catalog

_REFERENCE = re.compile(r"\[\[STREAM:(\S*?)\]\]", re.I)
_INSERT = re.compile(r"^\s*INSERT\s+INTO\s+(\S+)\s+(.*)$", re.I | re.S)
_INTERVAL = r"INTERVAL\s+'(\d+)'\s+(\w+)"
_TUMBLE = re.compile(
    r"TABLE\s*\(\s*TUMBLE\s*\(\s*TABLE\s+(\S+?)\s*,\s*DESCRIPTOR\s*\(\s*`?(\w+)`?\s*\)\s*,\s*" + _INTERVAL + r"\s*\)\s*\)",
    re.I,
)
_HOP = re.compile(
    r"TABLE\s*\(\s*HOP\s*\(\s*TABLE\s+(\S+?)\s*,\s*DESCRIPTOR\s*\(\s*`?(\w+)`?\s*\)\s*,\s*"
    + _INTERVAL + r"\s*,\s*" + _INTERVAL + r"\s*\)\s*\)",
    re.I,
)


def referenced_streams(*texts: str) -> list[str]:
    """Stream names referenced as ``[[STREAM:name]]``, in order of first use."""
    return list(dict.fromkeys(name for text in texts for name in _REFERENCE.findall(text)))


def resolve(text: str, catalog: Catalog) -> str:
    """Replace stream references by table names. An unknown stream is an error."""
    return _REFERENCE.sub(lambda m: catalog.get(m.group(1)).table, text)


def split_insert(text: str) -> tuple[str | None, str]:
    """(target reference, SELECT text) of a statement; the target is None for a plain SELECT."""
    match = _INSERT.match(text)
    return (match.group(1), match.group(2)) if match else (None, text)


def _windowed(table: str, window: str) -> str:
    return (
        f"(SELECT *, window.start AS window_start, window.end AS window_end "
        f"FROM (SELECT *, {window} AS window FROM {table}))"
    )


def expand_windows(text: str) -> str:
    """Write the TUMBLE and HOP table functions as sub-queries over Spark's ``window()``."""
    text = _TUMBLE.sub(lambda m: _windowed(m[1], f"window({m[2]}, '{m[3]} {m[4]}')"), text)
    return _HOP.sub(lambda m: _windowed(m[1], f"window({m[2]}, '{m[5]} {m[6]}', '{m[3]} {m[4]}')"), text)


_QUOTED = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"|--[^\n]*")


def _sub_queries(text: str) -> list[tuple[int, int]]:
    """Start and end (without the parentheses) of every parenthesised SELECT, inner ones first."""
    plain = _QUOTED.sub(lambda m: "_" * len(m[0]), text)
    found, opened = [], []
    for at, char in enumerate(plain):
        if char == "(":
            opened.append(at + 1)
        elif char == ")" and opened:
            start = opened.pop()
            if re.match(r"\s*SELECT\b", plain[start:at], re.I):
                found.append((start, at))
    return found


def split_ranking(select: str) -> tuple[str, str] | None:
    """A ranking over the counts of windows, as its counts and the ranking over a table ``closed``.

    A stream can count but not rank; the counts of a closed window arrive together, so the rest
    of the statement may run over each batch of them. None if the statement is of another kind.
    """
    ranking = re.search(r"\bROW_NUMBER\s*\(", select, re.I)
    if not ranking:
        return None
    spans = _sub_queries(select)
    around = min((b - a for a, b in spans if a <= ranking.start() < b), default=len(select))
    start, end = next(((a, b) for a, b in spans if a <= ranking.start() < b and b - a == around), (0, len(select)))
    counted = [
        (a, b)
        for a, b in spans
        if ranking.start() < a and b < end and re.search(r"\bFROM\s*\(\s*$", select[start:a], re.I)
    ]
    if not counted:
        return None
    a, b = max(counted, key=lambda span: span[1] - span[0])
    grouping = list(re.finditer(r"\bGROUP\s+BY\b", select[a:b], re.I))
    if not grouping or not re.search(r"\b(TUMBLE|HOP)\s*\(", select[a:b], re.I):
        return None
    # The window itself carries the watermark; its start and end follow from it.
    at = a + grouping[-1].end()
    return f"{select[a:at]} window,{select[at:b]}".strip(), f"{select[: a - 1]}closed{select[b + 1 :]}"
