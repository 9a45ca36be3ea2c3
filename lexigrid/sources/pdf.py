"""The text of plain PDFs without a library: content streams, as they are or deflated, with single-byte or UTF-16 strings.

Pages come in the order of their streams in the file. Encrypted files, glyph numbers (composite fonts) and pictures of text need a real
reader; what can't be read as text is left out."""

import re
import zlib

STREAM = re.compile(rb"(?<!end)stream\r?\n")
#: Operands and operators of a content stream; literal strings may hold others in parentheses, two deep.
TOKEN = re.compile(
    rb"\((?:[^\\()]++|\\.|\((?:[^\\()]++|\\.|\((?:[^\\()]++|\\.)*+\))*+\))*+\)|<[0-9A-Fa-f\s]*+>|[\[\]]|[-+]?(?:\d+\.?\d*|\.\d+)|/[^\s/\[\]()<>]*+|[A-Za-z*]+[0-9]?|['\"]", re.S
)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Thousandths of a letter's height by which a gap within a line is a space.
GAP = 200


def _unescaped(m: re.Match) -> bytes:
    x = m[1]
    if x[:1].isdigit():
        return bytes([int(x, 8) & 255])
    return b"" if x in (b"\n", b"\r", b"\r\n") else NAMED.get(x, x)


def _string(token: bytes) -> str:
    data = ESCAPE.sub(_unescaped, token[1:-1]) if token[:1] == b"(" else bytes.fromhex((x := re.sub(rb"\s", b"", token[1:-1]).decode()) + "0" * (len(x) % 2))
    text = data[2:].decode("utf-16-be", "ignore") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "ignore")
    return text if all(c.isprintable() or c.isspace() for c in text) else ""


def page_text(content: bytes) -> str:
    """The strings that a content stream shows; a move to another line is a line end."""
    out: list[str] = []
    operands: list[bytes] = []
    for m in TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"([<]/+-.0123456789":
            operands.append(token)
            continue
        if token in (b"Tj", b"'", b'"') and operands and operands[-1][:1] in b"(<":
            out.append("\n" * (token != b"Tj") + _string(operands[-1]))
        elif token == b"TJ":
            for x in operands:
                if x[:1] in b"(<":
                    out.append(_string(x))
                elif x[:1] == b"-" and float(x) < -GAP:
                    out.append(" ")
        elif token in (b"T*", b"ET", b"Tm") or token in (b"Td", b"TD") and operands and operands[-1].strip(b"+-0.") != b"":
            out.append("\n")
        elif token in (b"Td", b"TD"):
            out.append(" ")
        operands = []
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def plain_pages(data: bytes) -> list[str]:
    """A PdfBackend."""
    if b"/Encrypt" in data:
        return []
    pages, at = [], 0
    while m := STREAM.search(data, at):
        end = data.find(b"endstream", m.end())
        head = data[max(data.rfind(b"obj", 0, m.start()), 0) : m.start()]
        content, at = data[m.end() : end if end >= 0 else len(data)], max(end, m.end())
        if b"/FlateDecode" in head:
            try:
                content = zlib.decompressobj().decompress(content)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" in content and (b"Tj" in content or b"TJ" in content):
            pages.append(page_text(content))
    return pages
