"""The engine's text, graph and byte functions for SQL: ``register(spark)``, then for example

    SELECT path, inline(graph_units('prompt', text, 'output', true)) FROM fields
    SELECT path, summarize(collect_list(struct(ord, field, text))) FROM fields GROUP BY path

All take Arrow batches. Nulls give null.
"""

from __future__ import annotations

import io
import json
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import media
from .nodegraph import stored_prompts, summarise, units_of
from .text import decode_escapes, prepare

PAIRS = "array<struct<label:string,text:string>>"
STORED = "array<struct<field:string,key:string,kind:string,text:string>>"
FIELDS = "array<struct<ord:int,field:string,text:string>>"


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)


def _pairs(fields) -> list[tuple[str, str]]:
    rows = sorted((f if isinstance(f, dict) else f.asDict() for f in fields), key=lambda f: f["ord"])
    return [(f["field"], f["text"]) for f in rows if f["text"]]


def nfc(text: pd.Series) -> pd.Series:
    return _each(lambda t: unicodedata.normalize("NFC", t), text)


def decode_json_escapes(text: pd.Series) -> pd.Series:
    return _each(lambda t: decode_escapes(t).encode("utf-8", "replace").decode(), text)


def prepare_text(text: pd.Series) -> pd.Series:
    return _each(lambda t: prepare(t).encode("utf-8", "replace").decode(), text)


def graph_units(label: pd.Series, text: pd.Series, connected: pd.Series, per_node: pd.Series) -> pd.Series:
    """Units of a field: ``connected`` is '', linked or output."""
    return _each(lambda n, t, c, p: [{"label": a, "text": b} for a, b in units_of(n, prepare(t), connected_mode=c or None, per_node=bool(p))], label, text, connected, per_node)


def saved_prompts(fields: pd.Series) -> pd.Series:
    return _each(lambda f: [dict(zip(("field", "key", "kind", "text"), x)) for x in stored_prompts(_pairs(f))], fields)


def summarize(fields: pd.Series) -> pd.Series:
    """The summary as JSON; null where the fields say nothing."""

    def one(f) -> str | None:
        found = summarise(_pairs(f))
        return json.dumps(found, ensure_ascii=False) if found else None

    return _each(one, fields)


def extract_fields(content: pd.Series, suffix: pd.Series) -> pd.Series:
    """The metadata of a file's bytes; null for what cannot be read."""

    def one(data: bytes, ext: str):
        try:
            return [{"ord": k, "field": n, "text": t} for k, (n, t) in enumerate(media.fields(io.BytesIO(data), ext.lower().lstrip(".")))]
        except Exception:  # an unreadable file has no fields
            return None

    return _each(one, content, suffix)


def register(spark: SparkSession) -> None:
    for f, kind in ((nfc, "string"), (decode_json_escapes, "string"), (prepare_text, "string"), (graph_units, PAIRS), (saved_prompts, STORED), (summarize, "string"), (extract_fields, FIELDS)):
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
