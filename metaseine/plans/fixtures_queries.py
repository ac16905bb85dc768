"""Queries of byte extraction, graphs and summaries, over files and graphs made from the tables' rows; SQL tells what must come out of them."""

from __future__ import annotations

import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.match import SearchSpec, search
from ..streaming.landing import extract_content
from .catalogue import query, table

_GRAPH = "named_struct('1', named_struct('class_type', 'TextEncode', 'inputs', named_struct('text', text)), '2', named_struct('class_type', 'KSampler', 'inputs', named_struct('steps', 20, 'seed', doc_id, 'positive', array('1', '0'))), '3', named_struct('class_type', 'SaveImage', 'inputs', named_struct('images', array('2', '0'))), '4', named_struct('class_type', 'Note', 'inputs', named_struct('text', source)))"


def _records(spark, sf_dir):
    """A record of fields for each document: its text inside a generation graph, and a stored prompt."""
    d = table(spark, sf_dir, "documents")
    field = lambda k, n, e: F.struct(F.lit(k).alias("ord"), F.lit(n).alias("field"), e.alias("text"))
    made = F.array(field(0, "prompt", F.expr(f"to_json({_GRAPH})")), field(1, "gen_meta", F.expr("to_json(named_struct('prompt', text, 'intermediate_prompt_1', lang))")))
    return d.select(F.col("doc_id").cast("string").alias("path"), made.alias("fields"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 'prompt#1' AS label FROM documents WHERE regexp_matches(text, 'rights', 'is')")
def q_graph_units(spark, sf_dir):
    """The nodes that feed an output, as units, for records whose graph has a term in one of them."""
    spec = SearchSpec(("rights",), scope="node", connected="output", snippets=False)
    found = search(scan.units(_records(spark, sf_dir), spec), scan.replaced(spec))
    return found.select(F.col("entity").alias("path"), F.col("hits")[0]["label"].alias("label"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 'gen_meta:intermediate_prompt_1' AS label FROM documents WHERE regexp_matches(lang, 'en', 'is')")
def q_saved_prompts(spark, sf_dir):
    spec = SearchSpec(("en",), saved_kinds=("intermediate1",), snippets=False)
    return search(scan.units(_records(spark, sf_dir), spec), scan.replaced(spec)).select(F.col("entity").alias("path"), F.col("hits")[0]["label"].alias("label"))


_SUMMARY = r"""WITH d AS (SELECT *, coalesce(regexp_matches(text, '\S'), false) AS told FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, '{"positive": [' || CASE WHEN told THEN CAST(to_json(text) AS VARCHAR) ELSE '' END || '], "negative": [], "models": [], "loras": [], "samplers": [{"seed": ' || doc_id || ', "steps": 20}], "intermediate": [' || CAST(to_json(lang) AS VARCHAR) || '], "prompt_source": "' || CASE WHEN told THEN 'gen_meta' ELSE 'graph' END || '"}' AS summary FROM d"""


@query(_SUMMARY)
def q_summary(spark, sf_dir):
    return scan.summaries(_records(spark, sf_dir)).select("path", "summary")


@query("""SELECT '/d/' || doc_id || '.png' AS path, 'note' AS field, '{"text": ' || CAST(to_json(text) AS VARCHAR) || '}' AS text, CAST(NULL AS VARCHAR) AS error FROM documents""")
def q_extract_png(spark, sf_dir):
    """Each document as the text chunk of a small picture, read back from its bytes."""

    def build(batches):
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
        tail = chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
        for b in batches:
            texts = [head + chunk(b"iTXt", b"note\0\0\0\0\0" + json.dumps({"text": t}, ensure_ascii=False).encode()) + tail for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["path", "content"])

    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/d/"), "doc_id", F.lit(".png")).alias("path"), "text").mapInArrow(build, "path string, content binary")
    return extract_content(files).select("path", F.col("fields")[0]["field"].alias("field"), F.col("fields")[0]["text"].alias("text"), "error")
