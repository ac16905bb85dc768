import json

from metaseine.functions.register import register

from . import build
from .test_nodegraph import PROMPT


def test_functions_in_sql(spark):
    register(spark)
    data = build.png(build.text("prompt", json.dumps(PROMPT)), build.text("gen_meta", '{"prompt": "told"}'))
    spark.createDataFrame([(data, "png"), (b"junk", "png"), (None, "png")], "content binary, ext string").createOrReplaceTempView("files")
    got = spark.sql("SELECT fields, summarize(fields) s, saved_prompts(fields) p, size(graph_units('prompt', fields[0].text, 'output', true)) n FROM (SELECT extract_fields(content, ext) fields FROM files)").collect()
    assert json.loads(got[0]["s"])["positive"] == ["told"] and got[0]["p"][0]["key"] == "prompt" and got[0]["n"] == 5
    assert got[1]["fields"] is None and got[1]["s"] is None and got[2]["fields"] is None
    row = spark.sql(r"SELECT nfc('café') a, decode_json_escapes(r'[é]') b, prepare_text(r'{é}') c").first()
    assert tuple(row) == ("café", "[é]", "{é}")
