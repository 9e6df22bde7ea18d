"""Text of JSON records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: Keys that hold text and keys that hold turns, in the order in which they are taken.
TEXT_KEYS = ["instruction", "input", "output", "question", "answer", "query", "response", "prompt", "completion", "text", "content", "article", "passage", "title"]
CHAT_KEYS = ["messages", "conversations", "dialogue", "history", "turns"]


def _gather(value: Any, lenient: bool, into: list[str]) -> None:
    """Appends the texts of a value. lenient: single characters count, and unknown keys are looked into."""
    if isinstance(value, str):
        text = value.strip()
        if len(text) >= (1 if lenient else 2):
            into.append(text)
    elif isinstance(value, list):
        for item in value:
            _gather(item, lenient, into)
    elif isinstance(value, dict):
        before = len(into)
        for key in TEXT_KEYS + CHAT_KEYS:
            if key in value:
                _gather(value[key], True, into)
        if lenient and len(into) == before:
            for item in value.values():
                _gather(item, False, into)


def text_of(value: Any, lenient: bool = True) -> str:
    found: list[str] = []
    _gather(value, lenient, found)
    return "\n".join(found)


def collect_text(json_column: Column, lenient: bool = True) -> Column:
    """Text of JSON values of any shape, by Arrow batches; null for null and for what isn't JSON."""

    @F.pandas_udf("string")
    def gather(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for raw in rows:
                try:
                    out.append(None if raw is None else text_of(json.loads(raw), lenient))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return gather(json_column)


def collect_flat(fields: dict[str, Column]) -> Column:
    """collect_text() for records with known string fields, in built-in functions: known keys in their order, each stripped."""
    return F.concat_ws("\n", *[F.nullif(strip(fields[k]), F.lit("")) for k in TEXT_KEYS if k in fields])
