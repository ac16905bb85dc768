"""Small media files made by hand: valid headers and metadata, no meaningful pixels."""

import struct
import zlib


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks: bytes, after: tuple[bytes, ...] = ()) -> bytes:
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunks) + chunk(b"IDAT", zlib.compress(b"\0\0")) + b"".join(after) + chunk(b"IEND", b"")


def text(key: str, value: str) -> bytes:
    return chunk(b"tEXt", key.encode() + b"\0" + value.encode("utf-8"))


def itxt(key: str, value: str) -> bytes:
    return chunk(b"iTXt", key.encode() + b"\0\0\0\0\0" + value.encode("utf-8"))


def tiff(tags: dict[int, bytes], exif: dict[int, bytes] | None = None) -> bytes:
    """A little-endian TIFF block of ASCII (or, in the Exif directory, undefined) values."""

    def directory(at: int, entries: dict[int, tuple[int, bytes]]) -> bytes:
        place = at + 2 + 12 * len(entries) + 4
        rows, blob = b"", b""
        for tag, (kind, raw) in sorted(entries.items()):
            value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", place + len(blob))
            blob += raw if len(raw) > 4 else b""
            rows += struct.pack("<HHI", tag, kind, len(raw) // (4 if kind == 4 else 1)) + value
        return struct.pack("<H", len(entries)) + rows + b"\0\0\0\0" + blob

    first = {t: (2, v + b"\0") for t, v in tags.items()}
    if exif is None:
        return b"II*\0" + struct.pack("<I", 8) + directory(8, first)
    size = len(directory(8, first | {0x8769: (4, b"\0\0\0\0")}))
    return b"II*\0" + struct.pack("<I", 8) + directory(8, first | {0x8769: (4, struct.pack("<I", 8 + size))}) + directory(8 + size, {t: (7, v) for t, v in exif.items()})


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    body = b"".join(b"\xff" + bytes([code]) + struct.pack(">H", len(raw) + 2) + raw for code, raw in segments)
    return b"\xff\xd8" + body + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x02\xff\xd9"


def webp(exif: bytes) -> bytes:
    part = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    body = b"WEBP" + part(b"VP8X", b"\0" * 10) + part(b"VP8L", b"\x2f\0\0\0\0") + part(b"EXIF", exif)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(values: dict[str, str], moov_last: bool = False) -> bytes:
    keys = b"".join(struct.pack(">I", len(k) + 8) + b"mdta" + k.encode() for k in values)
    items = b"".join(box(struct.pack(">I", i + 1), box(b"data", b"\0\0\0\1\0\0\0\0" + v.encode())) for i, v in enumerate(values.values()))
    meta = box(b"meta", box(b"hdlr", b"\0" * 25) + box(b"keys", b"\0\0\0\0" + struct.pack(">I", len(values)) + keys) + box(b"ilst", items))
    moov, rest = box(b"moov", box(b"udta", meta)), box(b"mdat", b"x" * 100)
    return box(b"ftyp", b"isom\0\0\2\0") + (rest + moov if moov_last else moov + rest)


def element(ident: int, body: bytes) -> bytes:
    raw = ident.to_bytes((ident.bit_length() + 7) // 8, "big")
    return raw + (0x10000000 | len(body)).to_bytes(4, "big") + body


def mkv(values: dict[str, str]) -> bytes:
    tags = b"".join(element(0x67C8, element(0x45A3, k.encode()) + element(0x4487, v.encode())) for k, v in values.items())
    return element(0x1A45DFA3, b"\0") + element(0x18538067, element(0x1254C367, element(0x7373, tags)))


def heif(items: dict[bytes, bytes], gap: int = 0) -> bytes:
    """A HEIF file with items of the types given, which lie ``gap`` bytes behind its boxes."""
    infe = b"".join(box(b"infe", b"\2\0\0\0" + struct.pack(">HH", k, 0) + kind + b"\0") for k, kind in enumerate(items, 1))
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", len(items)) + infe)

    def meta(start: int) -> bytes:
        rows, at = b"", start
        for k, body in enumerate(items.values(), 1):
            rows += struct.pack(">HHHII", k, 0, 1, at, len(body))
            at += len(body)
        return box(b"meta", b"\0\0\0\0" + iinf + box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">H", len(items)) + rows))

    head = box(b"ftyp", b"heic\0\0\0\0")
    body = b"".join(items.values())
    start = len(head) + len(meta(0)) + 8 + gap
    return head + meta(start) + box(b"mdat", b"\0" * gap + body)
