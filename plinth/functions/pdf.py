"""Text of PDF files with the standard library: Flate streams, text operators, ToUnicode maps. Scans and encrypted files give ''."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _streams(data: bytes) -> list[bytes]:
    out = []
    for m in _STREAM.finditer(data):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"Filter" in m["head"]:
            continue
        out.append(body)
    return out


def _literal(token: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x in (b"\n", b"\r\n") else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def unicode_map(stream: bytes) -> dict[int, str]:
    """Codes of a ToUnicode map: single ones and ranges."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out |= {int(a, 16) + i: chr(int(c, 16) + i) for i in range(min(int(b, 16) - int(a, 16) + 1, 65_536))}
    return out


def _decode(raw: bytes, codes: dict[int, str], wide: bool) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "ignore")
    if codes and wide:
        return "".join(codes.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
    if codes:
        return "".join(codes.get(b, chr(b)) for b in raw)
    return raw.decode("utf-16-be", "ignore") if wide and len(raw) % 2 == 0 else raw.decode("latin-1")


def pdf_text(data: bytes | None) -> str:
    """Text of the pages in the order of their streams, a line per text line; '' for what is no readable PDF."""
    if not data or not data.lstrip().startswith(b"%PDF") or b"/Encrypt" in data:
        return ""
    streams = _streams(data)
    codes: dict[int, str] = {}
    for s in streams:
        if b"beginbfchar" in s or b"beginbfrange" in s:
            codes |= unicode_map(s)
    lines: list[str] = []
    for s in streams:
        if b"BT" not in s or b"begincmap" in s:
            continue
        for block in re.findall(rb"BT(.*?)ET", s, re.S):
            line, held = "", []
            for token in _TOKEN.findall(block):
                if token[:1] == b"(":
                    held.append(_decode(_literal(token), codes, False))
                elif token[:1] == b"<":
                    digits = re.sub(rb"\s", b"", token[1:-1])
                    held.append(_decode(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), codes, True))
                elif token in (b"Tj", b"TJ"):
                    line, held = line + "".join(held), []
                elif token in (b"'", b'"'):
                    lines.append(line)
                    line, held = "".join(held), []
                elif token in (b"Td", b"TD", b"T*", b"Tm"):
                    lines.append(line)
                    line, held = "", []
            lines.append(line + "".join(held))
    return "\n".join(x.strip() for x in lines if x.strip())
