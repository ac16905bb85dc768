import io
import json

import pytest

from metaseine.sources import media
from metaseine.sources.media import fields

from . import build


def read(data: bytes, suffix: str = "png", deep: bool = False) -> dict:
    return dict(fields(io.BytesIO(data), suffix, deep))


def test_png_text_chunks():
    data = build.png(build.text("prompt", "café"), build.itxt("note", "女孩"), build.chunk(b"zTXt", b"z\0\0" + __import__("zlib").compress(b"packed")), after=(build.text("late", "end"),))
    assert read(data) == {"prompt": "café", "note": "女孩", "z": "packed"}
    assert read(data, deep=True)["late"] == "end"


def test_exif_in_jpeg_webp_and_tiff():
    block = build.tiff({0x010F: b'prompt:{"a": 1}', 0x0110: b"model"}, {0x9286: b"UNICODE\0" + "Barcelona".encode("utf-16-le")})
    for data, suffix in ((build.jpeg((0xE1, b"Exif\0\0" + block)), "jpg"), (build.webp(block), "webp"), (block, "tif")):
        got = read(data, suffix)
        assert got["Make"] == 'prompt:{"a": 1}' and got["Model"] == "model" and got["Exif:UserComment"] == "Barcelona"


def test_heif_and_gif():
    exif = b"\0\0\0\6Exif\0\0" + build.tiff({0x010F: b"maker"}, {0x9286: b"ASCII\0\0\0a remark"})
    packet = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><a>hello</a></x:xmpmeta>'
    for suffix in ("heic", "avif"):
        got = read(build.heif({b"Exif": exif, b"mime": packet}), suffix)
        assert got["Make"] == "maker" and got["Exif:UserComment"] == "a remark" and "hello" in got["xmp"]
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b"!\xfe\5a gif\3 re\4mark\0" + b";"
    assert read(gif, "gif")["comment"] == "a gif remark"


def test_places_behind_large_pixels(monkeypatch):
    monkeypatch.setattr(media, "BLOCK_LIMIT", 4096)
    block = build.tiff({0x010F: b"maker", 0x0110: b"m" * 5000})
    moved = bytearray(b"II*\0" + (20_008).to_bytes(4, "little") + b"\0" * 20_000 + block[8:])
    for k in range(2):  # the places of the values move too
        at = 20_010 + 12 * k + 8
        moved[at : at + 4] = (int.from_bytes(moved[at : at + 4], "little") + 20_000).to_bytes(4, "little")
    got = read(bytes(moved), "tif")
    assert got["Make"] == "maker" and "Model" not in got
    exif = b"\0\0\0\0" + build.tiff({0x010F: b"maker"})
    assert read(build.heif({b"Exif": exif}, gap=20_000), "heic")["Make"] == "maker"


def test_jpeg_segments_and_xmp():
    packet = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><a>hello</a></x:xmpmeta>'
    got = read(build.jpeg((0xE0, b"JFIF"), (0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet), (0xFE, b"a comment"), (0xED, b"x\0\1y")), "jpg")
    assert json.loads(got["xmp_parsed"]) == {"xmpmeta": {"a": "hello"}}
    assert got["jpeg:COM"] == "a comment" and got["jpeg:APP13"] == "x y" and "jpeg:APP0" not in got


def test_videos():
    graph = {"prompt": '{"1": {"class_type": "A"}}'}
    for data, suffix in ((build.mp4(graph), "mp4"), (build.mp4(graph, True), "mov"), (build.mkv({"PROMPT": graph["prompt"]}), "webm")):
        assert read(data, suffix) == graph
    assert read(build.mp4({}), "mp4") == {}
    both = json.dumps({"prompt": {"1": {"class_type": "A"}}, "workflow": {"nodes": []}})
    assert set(read(build.mp4({"comment": both}), "mp4")) == {"prompt", "workflow"}


@pytest.mark.parametrize("data, suffix", [(b"", "png"), (b"\0" * 99, "png"), (build.png()[:20], "png"), (b"<html>", "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"junk" * 9, "mp4"), (b"junk" * 9, "webm")])
def test_unreadable(data, suffix):
    with pytest.raises((ValueError, OSError)):
        read(data, suffix)


def test_scraped_packet_saves_a_damaged_file():
    assert read(b"junk<x:xmpmeta>hi</x:xmpmeta>junk", "jpg") == {"xmp_raw": "<x:xmpmeta>hi</x:xmpmeta>"}


def test_sizes_of_boxes():
    data = b"\0\0\0\1skip" + (24).to_bytes(8, "big") + b"12345678" + b"\0\0\0\0free1234"
    assert [(k, e - b) for k, b, e in media.boxes(data, 0, len(data))] == [(b"skip", 8), (b"free", 4)]
    assert list(media.boxes(b"\0\0\1\0free", 0, 8)) == []
