"""Metadata of image and video files, read from their headers by seeking; pixels and media data are never loaded.

``fields(f, suffix, deep)`` gives [(field, text)] in the order of the file, the later value where an image names a field twice.
What cannot be read raises ``Unreadable`` (or OSError); callers turn that into an error column.
"""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as xml
import zlib
from collections.abc import Iterator
from contextlib import suppress
from typing import BinaryIO

from ..functions.text import as_text, clean, decode_value, latin1_as_utf8

#: No block of metadata larger than this is loaded; how far an XMP packet is looked for, and how much of one is taken.
BLOCK_LIMIT, XMP_NEAR, XMP_DEEP, XMP_TAKE = 64 << 20, 128 << 10, 4_000_000, 200_000

#: Names of EXIF tags, of GPS tags, and of the directories below the first.
TAGS = {
    0x00FE: "NewSubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010D: "DocumentName", 0x010E: "ImageDescription",
    0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution",
    0x011C: "PlanarConfiguration", 0x011D: "PageName", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x02BC: "XMLPacket", 0x4746: "Rating", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifOffset", 0x8822: "ExposureProgram", 0x8825: "GPSInfo", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9010: "OffsetTime", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment",
    0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA005: "ExifInteroperabilityOffset",
    0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 0x1B: "GPSProcessingMethod", 0x1C: "GPSAreaInformation", 0x1D: "GPSDateStamp"}
DIRECTORIES = ((0x8769, "Exif", TAGS), (0x8825, "GPS", GPS_TAGS), (0xA005, "Interop", {}))
#: Sizes and formats of the TIFF types; names of MP4 items; boxes that an MP4 file may start with; EBML ids.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d"}
MP4_ITEMS = {"\xa9cmt": "comment", "\xa9nam": "title", "\xa9too": "encoder", "\xa9day": "date", "\xa9ART": "artist", "desc": "description"}
MP4_FIRST = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot", b"uuid")
EBML, SEGMENT, MKV_TAGS, MKV_TAG, MKV_SIMPLE, MKV_NAME, MKV_STRING = 0x1A45DFA3, 0x18538067, 0x1254C367, 0x7373, 0x67C8, 0x45A3, 0x4487


class Unreadable(ValueError):
    """A file that is not what it should be."""


def take(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise Unreadable("the file is cut short")
    return data


# PNG


def _png_text(kind: bytes, body: bytes) -> tuple[str, str] | None:
    key, _, rest = body.partition(b"\0")
    name = key.decode("latin-1")
    if kind == b"tEXt":
        return name, latin1_as_utf8(rest.decode("latin-1"))
    if kind == b"zTXt":
        return name, latin1_as_utf8(_inflate(rest[1:]).decode("latin-1"))
    packed, rest = rest[:1] == b"\1", rest[2:]
    _, _, rest = rest.partition(b"\0")  # language
    _, _, rest = rest.partition(b"\0")  # translated name
    return name, (_inflate(rest) if packed else rest).decode("utf-8", "replace")


def _inflate(data: bytes) -> bytes:
    z = zlib.decompressobj()
    out = z.decompress(data, BLOCK_LIMIT)
    if z.unconsumed_tail:
        raise Unreadable("a text is too large")
    return out


def png(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    f.seek(8)
    if take(f, 8)[4:] != b"IHDR":
        raise Unreadable("no header chunk")
    f.seek(8)
    exif, seen = None, False
    while len(head := f.read(8)) == 8:
        n, kind = struct.unpack(">I4s", head)
        if kind in (b"IDAT", b"IEND"):
            seen |= kind == b"IDAT"
            if not deep or kind == b"IEND":
                break
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            if n > BLOCK_LIMIT:
                raise Unreadable("a text is too large")
            try:
                yield _png_text(kind, take(f, n))
            except zlib.error:
                pass
            f.seek(4, 1)
        elif kind == b"eXIf" and n <= BLOCK_LIMIT:
            exif = take(f, n)
            f.seek(4, 1)
        else:
            f.seek(n + 4, 1)
    else:
        if not seen:
            raise Unreadable("the file ends before its image data")
    if exif:
        yield from tiff_fields(exif)


# TIFF and EXIF


class Window:
    """A file to be sliced like bytes: only the slices are read, and those of over BLOCK_LIMIT bytes are empty."""

    def __init__(self, f: BinaryIO):
        self.f, self.size = f, f.seek(0, 2)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.size)
        if not 0 < stop - start <= BLOCK_LIMIT:
            return b""
        self.f.seek(start)
        return self.f.read(stop - start)


def _directory(data: bytes | Window, at: int, order: str) -> tuple[dict[int, object], int]:
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    table = data[at + 2 : at + 2 + 12 * n]
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", table, 12 * k)
        form = TIFF_TYPES.get(kind)
        size = count * (8 if kind in (5, 10) else struct.calcsize("=" + form) if form else 0)
        if not size or size > len(data):
            continue
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", table, 12 * k + 8)[0]
        raw = data[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            found[tag] = raw.split(b"\0", 1)[0].decode("utf-8", "replace") if b"\0" in raw else raw.decode("utf-8", "replace")
        elif kind in (1, 7):
            found[tag] = raw if kind == 7 or count > 1 else raw[0]
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
            values = tuple(a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2]))
            found[tag] = values if count > 1 else values[0]
        else:
            values = struct.unpack(order + form * count, raw)
            found[tag] = values if count > 1 else values[0]
    after = at + 2 + 12 * n
    return found, struct.unpack(order + "I", data[after : after + 4])[0] if after + 4 <= len(data) else 0


def tiff_fields(data: bytes | Window) -> list[tuple[str, str]]:
    """The fields of a TIFF structure: its first directory and those for Exif, GPS and interoperability."""
    data = data.removeprefix(b"Exif\0\0") if isinstance(data, bytes) else data
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return []
    order = "<" if data[:1] == b"I" else ">"
    try:
        first, _ = _directory(data, struct.unpack(order + "I", data[4:8])[0], order)
    except struct.error:
        return []
    out = [(TAGS.get(t, f"Exif:{hex(t)}"), as_text(v)) for t, v in first.items()]
    places = dict(first)
    for tag, prefix, names in DIRECTORIES:
        try:
            sub, _ = _directory(data, int(places[tag]), order)
        except (KeyError, TypeError, ValueError, struct.error):
            continue
        places = sub | places
        out += [(f"{prefix}:{names.get(t, hex(t))}", as_text(v)) for t, v in sub.items()]
    return out


def tiff(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    data = Window(f)
    got = tiff_fields(data)
    if not got:
        raise Unreadable("no image directory")
    yield from got
    packet = _packet(data[:BLOCK_LIMIT])
    if packet:
        yield from xmp_parsed(packet)


# XMP


def _packet(blob: bytes) -> str:
    start = max(blob.find(b"<x:xmpmeta"), -1)
    start = blob.find(b"<?xpacket") if start < 0 else start
    if start < 0:
        return ""
    end = blob.find(b"</x:xmpmeta>", start)
    return blob[start : end + 12 if end >= 0 else start + XMP_TAKE].decode("utf-8", "ignore")


def xmp_scraped(f: BinaryIO, deep: bool) -> str:
    f.seek(0)
    return _packet(f.read(XMP_DEEP if deep else XMP_NEAR))


def xmp_parsed(packet: str) -> list[tuple[str, str]]:
    """The packet as JSON in the field xmp_parsed; nothing where it is no XML, or declares entities."""
    if "<!" in packet:
        return []

    def local(tag: str) -> str:
        return tag.rpartition("}")[2]

    def value(e):
        out = {local(k): v for k, v in e.attrib.items()}
        for child in e:
            held = out.get(local(child.tag))
            new = value(child)
            out[local(child.tag)] = new if held is None else [*held, new] if isinstance(held, list) else [held, new]
        text = (e.text or "").strip()
        return (out | ({"text": text} if text else {})) if out else text

    try:
        root = xml.fromstring(packet[packet.find("<x:xmpmeta") :] if "<x:xmpmeta" in packet else packet)
    except (xml.ParseError, ValueError):
        return []
    return [("xmp_parsed", as_text({local(root.tag): value(root)}))]


# JPEG, WebP, GIF and the like


def jpeg(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    f.seek(2)
    segments, exif, packet, started = {}, None, "", False
    while len(head := f.read(2)) == 2:
        if head[0] != 0xFF:
            break
        code = head[1]
        while code == 0xFF:
            code = (f.read(1) or b"\0")[0]
        if code in (0x01, *range(0xD0, 0xD9)):
            continue
        if code in (0xDA, 0xD9):
            started = True
            break
        body = take(f, struct.unpack(">H", take(f, 2))[0] - 2)
        started |= 0xC0 <= code <= 0xCF
        name = "COM" if code == 0xFE else f"APP{code - 0xE0}" if 0xE0 <= code <= 0xEF else None
        if name == "APP1" and body.startswith(b"Exif\0\0"):
            exif = exif or body
        if name == "APP1" and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            packet = packet or body.split(b"\0", 1)[1].decode("utf-8", "ignore")
        if name and name not in ("APP0", "APP2"):
            text = clean(body.decode("utf-8", "ignore"))
            if text.strip():
                segments[f"jpeg:{name}"] = text
        if name == "COM":
            yield "comment", decode_value(body)
    if not started:
        raise Unreadable("no image data")
    if exif:
        yield from tiff_fields(exif)
    if packet:
        yield from xmp_parsed(packet)
    yield from segments.items()


def webp(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    f.seek(12)
    seen = False
    while len(head := f.read(8)) == 8:
        kind, n = struct.unpack("<4sI", head)
        seen |= kind in (b"VP8 ", b"VP8L", b"VP8X")
        if kind in (b"EXIF", b"XMP ") and n <= BLOCK_LIMIT:
            body = take(f, n)
            f.seek(n & 1, 1)
            if kind == b"EXIF":
                yield from tiff_fields(body)
            else:
                yield "xmp", decode_value(body)
                yield from xmp_parsed(body.decode("utf-8", "ignore"))
        else:
            f.seek(n + (n & 1), 1)
    if not seen:
        raise Unreadable("no image chunk")


def gif(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    head = (f.seek(0), take(f, 13))[1]
    f.seek(3 << ((head[10] & 7) + 1) if head[10] & 0x80 else 0, 1)
    while mark := f.read(1):
        if mark == b"!":
            kind, parts = take(f, 1), []
            while n := take(f, 1)[0]:
                parts.append(take(f, n))
            if kind == b"\xfe":
                yield "comment", decode_value(b"".join(parts))
        else:  # the first picture, or the end
            break


def bmff(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    """HEIF and AVIF: the Exif and XMP items that the meta box places in the file."""
    whole = Window(f)
    place = next(((a, b) for kind, a, b in boxes(whole, 0, len(whole)) if kind == b"meta"), None)
    if place is None or place[1] - place[0] > BLOCK_LIMIT:
        raise Unreadable("no meta box" if place is None else "the meta box is over 64 MB")
    data = whole[place[0] : place[1]]
    items, places = {}, {}
    for kind, a, b in boxes(data, 4, len(data)):
        if kind == b"iinf":
            skip = 6 if data[a] == 0 else 8
            for k, x, _ in boxes(data, a + skip, b):
                if k == b"infe" and data[x] >= 2:
                    wide = data[x] > 2
                    items[int.from_bytes(data[x + 4 : x + (8 if wide else 6)], "big")] = data[x + (10 if wide else 8) : x + (14 if wide else 12)]
        elif kind == b"iloc":
            places = _locations(data, a)
    for number, kind in items.items():
        blob = b"".join(whole[s : s + n] for s, n in places.get(number, ()))
        if kind == b"Exif" and len(blob) > 4:
            yield from tiff_fields(blob[4 + int.from_bytes(blob[:4], "big") :])
        elif kind == b"mime" and b"<x:xmpmeta" in blob:
            yield "xmp", decode_value(blob)


def _locations(data: bytes, a: int) -> dict[int, list[tuple[int, int]]]:
    version = data[a]
    offset, length, base, index = data[a + 4] >> 4, data[a + 4] & 15, data[a + 5] >> 4, data[a + 5] & 15
    at = a + 6

    def number(n: int) -> int:
        nonlocal at
        at += n
        return int.from_bytes(data[at - n : at], "big")

    found = {}
    for _ in range(number(2 if version < 2 else 4)):
        item = number(2 if version < 2 else 4)
        if version:
            number(2)
        number(2)
        start = number(base)
        extents = []
        for _ in range(number(2)):
            number(index if version else 0)
            extents.append((start + number(offset), number(length)))
        found[item] = extents
    return found


# MP4, QuickTime


def boxes(data: bytes | Window, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body, end) of the boxes of a stretch, as long as their sizes make sense."""
    while start + 8 <= end:
        size, head = int.from_bytes(data[start : start + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        stop = end if size == 0 else start + size
        if stop > end or stop < start + head:
            return
        yield data[start + 4 : start + 8], start + head, stop
        start = stop


def movie_box(f: BinaryIO) -> bytes:
    """The body of the moov box, found by hopping from box to box."""
    end, at = f.seek(0, 2), 0
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", take(f, 8))
        if at == 0 and kind not in MP4_FIRST:
            raise Unreadable("not an MP4 or QuickTime container")
        head = 8
        if size == 1:
            size, head = int.from_bytes(take(f, 8), "big"), 16
        size = end - at if size == 0 else size
        if size < head:
            break
        if kind == b"moov":
            return take(f, min(size, end - at) - head) if size <= BLOCK_LIMIT else b""
        at += size
    if end < 8:
        raise Unreadable("not an MP4 or QuickTime container")
    return b""


def mp4(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    data = movie_box(f)
    metas, todo = [], [(0, len(data))]
    while todo:
        for kind, a, b in boxes(data, *todo.pop(0)):
            if kind == b"udta":
                todo.insert(0, (a, b))
            elif kind == b"meta":
                metas.append((a + (0 if data[a + 4 : a + 8] == b"hdlr" else 4), b))
    for meta in metas:
        # the entries of keys are laid out as boxes are, after a version and a count
        names = dict(enumerate((data[a:b].decode("utf-8", "replace") for x, y in within(data, b"keys", meta) for _, a, b in boxes(data, x + 8, y)), 1))
        for stretch in within(data, b"ilst", meta):
            for item, *body in boxes(data, *stretch):
                tag = item.decode("latin-1")
                name = names.get(int.from_bytes(item, "big")) or MP4_ITEMS.get(tag, tag)
                yield from ((name, decode_value(data[a + 8 : b])) for a, b in within(data, b"data", body))


def within(data: bytes, wanted: bytes, stretch) -> list[tuple[int, int]]:
    """The bodies of a stretch's boxes of a kind."""
    return [(a, b) for kind, a, b in boxes(data, *stretch) if kind == wanted]


# Matroska, WebM


def varint(f: BinaryIO, keep_mark: bool) -> int | None:
    """The next EBML number; None at the end, for a bad one, and for a size that says it is unknown."""
    first = f.read(1)
    if not first or not first[0]:
        return None
    n = 9 - first[0].bit_length()
    raw = first + f.read(n - 1)
    if len(raw) < n:
        return None
    value = int.from_bytes(raw, "big")
    if keep_mark:
        return value
    value &= (1 << 7 * n) - 1
    return None if value == (1 << 7 * n) - 1 else value


def elements(f: BinaryIO, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body, end) of the elements up to ``end``; an unknown size ends them."""
    while f.tell() < end:
        ident, size = varint(f, True), varint(f, False)
        if ident is None or size is None:
            return
        body = f.tell()
        yield ident, body, body + size
        f.seek(body + size)


def mkv(f: BinaryIO, deep: bool) -> Iterator[tuple[str, str]]:
    import io

    size = f.seek(0, 2)
    f.seek(0)
    if varint(f, True) != EBML:
        raise Unreadable("not a Matroska container")
    f.seek(varint(f, False) or 0, 1)
    if varint(f, True) != SEGMENT:
        return
    length = varint(f, False)
    end = size if length is None else min(size, f.tell() + length)
    for ident, body, stop in elements(f, end):
        if ident != MKV_TAGS or stop - body > BLOCK_LIMIT:
            continue
        block = io.BytesIO(f.read(stop - body))

        def simple(a: int, b: int) -> Iterator[tuple[str, str]]:
            name = value = None
            block.seek(a)
            inner = []
            for kind, x, y in elements(block, b):
                if kind == MKV_NAME:
                    name = block.read(y - x).decode("utf-8", "replace")
                elif kind == MKV_STRING:
                    value = block.read(y - x).decode("utf-8", "replace")
                elif kind == MKV_SIMPLE:
                    inner.append((x, y))
            for part in inner:
                yield from simple(*part)
            if name and value is not None:
                yield name.lower(), value.rstrip("\0")

        block.seek(0)
        tags = [(a, b) for kind, a, b in elements(block, stop - body) if kind == MKV_TAG]
        for a, b in tags:
            block.seek(a)
            for x, y in [(x, y) for kind, x, y in elements(block, b) if kind == MKV_SIMPLE]:
                yield from simple(x, y)


#: The fields that hold graphs.
GRAPH_FIELDS = ("prompt", "workflow")


def graphs_in(text: str) -> dict[str, str]:
    """The graphs that a JSON object holds under the names of the fields for them, as texts."""
    text = text.strip()
    data = None
    if text.startswith("{") and any(f'"{k}"' in text for k in GRAPH_FIELDS):
        with suppress(ValueError):
            data = json.loads(text)
    held = {k: data.get(k) for k in GRAPH_FIELDS} if isinstance(data, dict) else {}
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in held.items() if isinstance(v, (str, dict, list))}


def split_comment(fields: dict[str, str]) -> dict[str, str]:
    """The fields, where graphs stand in fields of their own: filters on graphs must reach those that a comment holds."""
    kept, graphs = {}, {}
    for name, text in fields.items():
        new = {k: v for k, v in graphs_in(text).items() if k not in fields and k not in graphs}
        if new:
            graphs |= new
        else:
            kept[name] = text
    return kept | graphs


FORMATS = ((b"\x89PNG\r\n\x1a\n", png, "PNG"), (b"\xff\xd8\xff", jpeg, "JPEG"), (b"GIF87a", gif, "GIF"), (b"GIF89a", gif, "GIF"), (b"II*\0", tiff, "TIFF"), (b"MM\0*", tiff, "TIFF"))


def fields(f: BinaryIO, suffix: str, deep: bool = False) -> list[tuple[str, str]]:
    """The metadata of an open file whose suffix is ``suffix`` (lower case, no dot)."""
    if suffix in ("mp4", "m4v", "mov", "webm", "mkv"):
        found: dict[str, str] = {}
        for name, text in (mkv if suffix in ("webm", "mkv") else mp4)(f, deep):
            found.setdefault(name, text)
        return list(split_comment(found).items())
    head = (f.seek(0), f.read(32))[1]
    reader, form = next(((r, n) for magic, r, n in FORMATS if head.startswith(magic)), (None, ""))
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        reader, form = webp, "WEBP"
    elif head[4:8] == b"ftyp":
        reader, form = bmff, "HEIF"
    try:
        if reader is None:
            if head[:2] == b"BM" and len(head) > 26:
                return []
            raise Unreadable("cannot identify image file")
        found = dict(reader(f, deep))
    except (Unreadable, OSError, ValueError, struct.error, IndexError):
        packet = xmp_scraped(f, deep)
        if packet:
            return [("xmp_raw", packet)]
        raise
    if form != "PNG" and not any("xmp" in k.lower() for k in found):
        packet = xmp_scraped(f, deep)
        if packet:
            found["xmp_raw"] = packet
    return list(found.items())
