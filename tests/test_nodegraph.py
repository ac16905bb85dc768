import json

import pytest

from metaseine.functions import nodegraph as g
from metaseine.functions.text import decode_escapes, decode_value, prepare, split_parameters

PROMPT = {
    "1": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "main.safetensors"}},
    "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "a cat", "clip": ["1", 1]}},
    "3": {"class_type": "CLIPTextEncode", "inputs": {"text": "blurry", "clip": ["1", 1]}},
    "4": {"class_type": "KSampler", "inputs": {"seed": 5, "steps": 20, "cfg": 7.0, "model": ["1", 0], "positive": ["2", 0], "negative": ["3", 0]}},
    "5": {"class_type": "SaveImage", "inputs": {"images": ["4", 0]}},
    "6": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "stray.safetensors"}},
    "7": {"class_type": "LoadImage", "inputs": {"image": "chain.png"}},
    "8": {"class_type": "ImageScale", "inputs": {"image": ["7", 0]}},
}


def node(i, kind, mode=0, **more):
    return {"id": i, "type": kind, "mode": mode, **more}


def test_connected_prompt():
    assert set(g.connected_prompt(PROMPT, "linked")) == {"1", "2", "3", "4", "5", "7", "8"}
    assert set(g.connected_prompt(PROMPT, "output")) == {"1", "2", "3", "4", "5"}
    alone = {k: PROMPT[k] for k in ("6", "7", "8")}
    assert set(g.connected_prompt(alone, "output")) == {"7", "8"}  # no output: as linked


def ids(graph, mode):
    return {n["id"] for n in g.connected_workflow(graph, mode)["nodes"]}


def test_bypassed_muted_relays_and_names():
    links = [[1, 1, 0, 2, 0, "X"], [2, 2, 0, 3, 0, "X"]]
    assert ids({"nodes": [node(1, "Load"), node(2, "Lora", 4), node(3, "SaveImage")], "links": links}, "output") == {1, 3}
    assert ids({"nodes": [node(1, "Load", 2), node(2, "Scale", 2), node(3, "PreviewImage")], "links": links}, "linked") == set()
    assert ids({"nodes": [node(1, "Load"), node(2, "Reroute"), node(3, "SaveImage")], "links": links}, "linked") == {1, 3}
    named = [node(1, "Load"), node(2, "SetNode", widgets_values=["k"]), node(4, "GetNode", widgets_values=["k"]), node(3, "SaveImage"), node(5, "GetNode", widgets_values=["other"])]
    assert ids({"nodes": named, "links": [[1, 1, 0, 2, 0, "X"], [2, 4, 0, 3, 0, "X"]]}, "output") == {1, 3}


def test_stale_links_are_not_trusted():
    nodes = [node(1, "Load", outputs=[{"links": [7]}]), node(2, "SaveImage", inputs=[{"link": 7}]), node(3, "Old")]
    graph = {"nodes": nodes, "links": [[7, 1, 0, 2, 0, "X"], [8, 3, 0, 2, 0, "X"]]}
    assert ids(graph, "linked") == {1, 2}
    assert ids({"nodes": [node(1, "Load"), node(2, "SaveImage")], "links": [[9, 1, 0, 2, 0, "X"]]}, "linked") == {1, 2}


def test_subgraphs():
    inner = {"id": "sg", "name": "part", "nodes": [node(1, "TextBox"), node(2, "Other"), node(9, "Stray")], "links": [{"id": 1, "origin_id": -10, "target_id": 1}, {"id": 2, "origin_id": 1, "target_id": 2}, {"id": 3, "origin_id": 2, "target_id": -20}]}
    unused = {"id": "no", "nodes": [node(1, "X")], "links": []}
    graph = {"nodes": [node(1, "sg"), node(2, "SaveImage")], "links": [[1, 1, 0, 2, 0, "X"]], "definitions": {"subgraphs": [inner, unused]}}
    got = g.connected_workflow(graph, "output")
    assert [s["id"] for s in got["definitions"]["subgraphs"]] == ["sg"]
    assert [n["id"] for n in got["definitions"]["subgraphs"][0]["nodes"]] == [1, 2]
    assert [label for label, _ in g.nodes_of(graph, "workflow")] == ["2", "part/1", "part/2", "part/9", "no/1"]


def test_units():
    text = "prompt:" + json.dumps(PROMPT)
    whole = g.units_of("Model", text, connected_mode="output")
    assert len(whole) == 1 and whole[0][1].startswith('prompt:{"1": {"class_type"') and "stray" not in whole[0][1]
    assert [u for u, _ in g.units_of("Model", text, node_types=["ksampler"])] == ["Model#4"]
    assert g.units_of("f", text, inputs=["Text"])[0] == ("f#2", '{"text": "a cat"}')
    assert g.units_of("f", "no graph", per_node=True) == [("f", "no graph")] and g.units_of("f", "no graph", inputs=["x"]) == []
    assert g.units_of("f", text, per_node=True, gate=lambda t: False) == []
    assert g.units_of("f", '{"class_type" broken', per_node=True) == [("f", '{"class_type" broken')]


def test_summary():
    got = g.summarise([("prompt", json.dumps(PROMPT))])
    assert got == {"positive": ["a cat"], "negative": ["blurry"], "models": ["main.safetensors"], "loras": [], "samplers": [{"seed": 5, "steps": 20, "cfg": 7.0}], "prompt_source": "graph"}
    stored = g.summarise([("prompt", json.dumps(PROMPT)), ("gen_meta", '{"prompt": "told", "intermediate_prompt_2": "mid"}')])
    assert stored["positive"] == ["told"] and stored["negative"] == [] and stored["intermediate"] == ["mid"] and stored["prompt_source"] == "gen_meta"
    assert g.summarise([("x", "y")]) == {}
    assert g.flat_summary(got)["sampler"] == "seed 5, steps 20, cfg 7.0"


def test_long_chains_do_not_recurse():
    chain = {str(i): {"class_type": "Concat", "inputs": {"string_a": [str(i + 1), 0]}} for i in range(5000)}
    chain["5000"] = {"class_type": "Text", "inputs": {"text": "deep"}}
    assert g.texts_feeding(chain, "0", set()) == ["deep"]


def test_stored_prompts():
    assert g.stored_prompts([("a", '{"request": {"prompt": "p1", "negativePrompt": "n1"}, "prompt": "p2"}')]) == [("a", "prompt", "prompt", "p1"), ("a", "negativePrompt", "negative", "n1")]
    assert g.stored_prompts([("a", '{"raw": {"meta": {"prompt": "deep"}}}')]) == [("a", "prompt", "prompt", "deep")]
    assert g.stored_prompts([("prompt", '{"prompt": "x"}')]) == [] and g.stored_prompts([("a", '{"promt": "typo"}')])[0][1] == "promt"
    assert g.kind_name("Intermediate-Prompt_02") == "intermediate2" and g.is_wanted("intermediate", "intermediate_prompt_2", ["intermediate2"])
    assert not g.is_wanted("intermediate", "intermediate_prompt_3", ["intermediate2"]) and g.is_wanted("negative", "n", [])
    with pytest.raises(ValueError):
        g.kind_name("nothing")


def test_parameters():
    got = split_parameters('a <lora:x:0.5> cat\nNegative prompt: bad\nSteps: 20, Sampler: Euler a, CFG scale: 7, Seed: 1, Model: m, Other: "a, b"')
    assert got == {"positive": ["a <lora:x:0.5> cat"], "negative": ["bad"], "models": ["m"], "loras": ["x (0.5)"], "samplers": [{"seed": "1", "steps": "20", "cfg": "7", "sampler_name": "Euler a"}]}


def test_escapes_and_composition():
    assert prepare('{"a": "caf\\u00e9 \\ud83d\\ude00"}') == '{"a": "café 😀"}'
    assert prepare('{"a": "\\\\u00e9"}') == '{"a": "\\\\u00e9"}'
    assert prepare("caf\\u00e9") == "caf\\u00e9" and prepare("café") == "café"
    assert decode_escapes('{"a": "\\u0022\\u00e9\\u0041"}') == '{"a": "\\u0022é\\u0041"}'
    assert decode_escapes("[\\ud800 \\u00e9]") == "[\\ud800 é]" and decode_escapes("[\\u0041]") == "[A]"


def test_values():
    assert decode_value(b"ASCII\0\0\0abc") == "abc" and decode_value("hello é".encode("utf-16")) == "hello é" and decode_value(b"\xe9") == "é"
