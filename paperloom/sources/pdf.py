"""A decoder of plain PDF files: text at four granularities, image boxes, drawing counts. It renders nothing.

It knows page trees, object streams, Flate streams, simple fonts with their widths, and text, path and image operators. Encrypted files,
other filters and composite fonts' own encodings are for other decoders: such a file fails, or its letters are read as Latin ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJ = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\()|(?P<mark>[\[\]])|/(?P<name>[^\s/<>\[\]()%]*)|(?P<ref>\d+\s+\d+\s+R)(?![^\s/<>\[\]()%])|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s/<>\[\]()%])|(?P<word>[^\s/<>\[\]()%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
# Operators that paint a path; the share of a letter's size above its base line; a width without a font's own.
_PAINT, _ASCENT, _WIDTH = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*"}, 0.8, 500.0


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    pass


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that may hold further ones."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            c = raw[at : at + 1]
            at += 1
            if c.isdigit():
                m = re.match(rb"[0-7]{1,3}", raw[at - 1 : at + 2])
                out.append(int(m[0], 8) & 255 if m else c[0])
                at += len(m[0]) - 1 if m else 0
            elif c not in b"\r\n":
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(raw: bytes, at: int = 0) -> Iterator:
    """Values and operators of a piece of PDF syntax."""
    stack: list[list] = []

    def ends(value):
        if stack:
            stack[-1].append(value)
            return False
        return True

    while at < len(raw):
        m = _TOKEN.match(raw, at)
        if m is None:
            at += 1
            continue
        at, kind, value = m.end(), m.lastgroup, None
        if kind is None:
            continue
        if kind == "open":
            value, at = _string(raw, at)
        elif kind == "hex":
            h = re.sub(rb"\s", b"", m["hex"])
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif kind == "num":
            value = float(m["num"])
        elif kind == "ref":
            value = Ref(m["ref"].split()[0])
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m["name"].decode("latin-1")))
        elif m[0] in (b"<<", b"["):
            stack.append([])
            continue
        elif m[0] in (b">>", b"]"):
            if not stack:
                continue
            own = stack.pop()
            value = dict(zip(own[::2], own[1::2], strict=False)) if m[0] == b">>" else own
        else:
            value = Word(m["word"].decode("latin-1"))
            if value == "ID" and not stack:  # an inline image's bytes
                end = re.compile(rb"\sEI(?=\s|$)").search(raw, at)
                at = end.end() if end else len(raw)
        if ends(value):
            yield value


class Pdf:
    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("the file is encrypted")
        self.values: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJ.finditer(content):
            n, body = int(m[1]), m[2]
            head, _, data = body.partition(b"stream")
            self.values[n] = next(tokens(head), None)
            if data and isinstance(self.values[n], dict):
                self.streams[n] = re.sub(rb"\r?\n?endstream\s*$", b"", data.removeprefix(b"\r").removeprefix(b"\n"))
        for n, value in list(self.values.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                raw, first = self.stream(n), int(value["First"])
                index = [int(x) for x in raw[:first].split()]
                for k, place in zip(index[::2], index[1::2], strict=False):
                    self.values.setdefault(k, next(tokens(raw, first + place), None))

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 50:
            value, seen = self.values.get(int(value)), seen + 1
        return value

    def stream(self, n: int) -> bytes:
        filters = self.get(self.values[n].get("Filter")) or []
        raw = self.streams.get(n, b"")
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"the filter {f} is not known")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> Iterator[dict]:
        root = next((v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("the file has no catalog")

        def walk(node, above: dict, depth: int = 0) -> Iterator[dict]:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 60:
                return
            own = above | {k: v for k, v in node.items() if k in ("MediaBox", "Rotate", "Resources")}
            if "Kids" in node:
                for kid in self.get(node["Kids"]):
                    yield from walk(kid, own, depth + 1)
            else:
                yield own | node

        yield from walk(root.get("Pages"), {})

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents", [])
        parts = self.get(parts) if not isinstance(parts, Ref) or isinstance(self.get(parts), list) else [parts]
        return b"\n".join(self.stream(int(p)) for p in parts or [])


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _page(pdf: Pdf, page: dict) -> tuple[list[tuple], list[tuple], int]:
    """(letter, x0, y0, x1, y1, run of letters) in the order they are shown; image boxes; painted paths. Origin top left."""
    box = [float(x) for x in pdf.get(page["MediaBox"])]
    resources = pdf.get(page.get("Resources")) or {}
    fonts, objects = pdf.get(resources.get("Font")) or {}, pdf.get(resources.get("XObject")) or {}
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, letters, images, paths, run = unit, [], [], [], 0, -1
    tm = line = unit
    font, size, leading, args = {}, 1.0, 0.0, []

    def show(raw: bytes) -> None:
        nonlocal tm
        widths, first = pdf.get(font.get("Widths")) or [], int(font.get("FirstChar", 0))
        for c in raw:
            w = widths[c - first] if 0 <= c - first < len(widths) else _WIDTH
            m = _times(tm, ctm)
            step, high = float(pdf.get(w)) / 1000 * size, abs(m[3]) * size
            x0, base = m[4] - box[0], box[3] - m[5]
            letters.append((bytes([c]).decode("cp1252", "replace"), x0, base - _ASCENT * high, x0 + step * abs(m[0]), base + (1 - _ASCENT) * high, run))
            tm = _times((1, 0, 0, 1, step, 0), tm)

    for t in tokens(pdf.content(page)):
        if not isinstance(t, Word):
            args.append(t)
            continue
        if t == "q":
            saved.append(ctm)
        elif t == "Q":
            ctm = saved.pop() if saved else unit
        elif t == "cm":
            ctm = _times(tuple(args[-6:]), ctm)
        elif t == "BT":
            tm = line = unit
        elif t == "Tf":
            font, size = pdf.get(fonts.get(args[-2])) or {}, float(args[-1])
        elif t == "TL":
            leading = float(args[-1])
        elif t == "Tm":
            tm = line = tuple(args[-6:])
        elif t in ("Td", "TD", "T*", "'", '"'):
            dx, dy = (args[-2], args[-1]) if t in ("Td", "TD") else (0.0, -leading)
            leading = -dy if t == "TD" else leading
            tm = line = _times((1, 0, 0, 1, dx, dy), line)
        if t in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            run += 1
            show(args[-1])
        elif t == "TJ" and args and isinstance(args[-1], list):
            run += 1
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, float):
                    tm = _times((1, 0, 0, 1, -x / 1000 * size, 0), tm)
        elif t in _PAINT:
            paths += 1
        elif t == "Do" and args and (pdf.get(objects.get(args[-1])) or {}).get("Subtype") == "Image":
            xs, ys = sorted((ctm[4], ctm[4] + ctm[0] + ctm[2])), sorted((ctm[5], ctm[5] + ctm[1] + ctm[3]))
            images.append((xs[0] - box[0], box[3] - ys[1], xs[1] - box[0], box[3] - ys[0]))
        args = []
    return letters, images, paths


class PdfDecoder:
    """Rows of the layout tables of one file; a shown string is a span, a base line of spans a line."""

    def decode(self, document_id: str, content: bytes) -> Iterator[tuple[str, dict]]:
        pdf = Pdf(content)
        for number, page in enumerate(pdf.pages(), 1):
            letters, images, paths = _page(pdf, page)
            box = [float(x) for x in pdf.get(page["MediaBox"])]
            at = {"document_id": document_id, "page_number": number}
            lines: list[list[tuple]] = []
            for x in letters:
                if lines and abs(lines[-1][-1][4] - x[4]) < 1:
                    lines[-1].append(x)
                else:
                    lines.append([x])
            texts = []
            for n, line in enumerate(lines):
                texts.append("".join(x[0] for x in line))
                place = at | {"block_no": n, "line_no": 0}
                for s, first in enumerate(dict.fromkeys(x[5] for x in line)):
                    span = [x for x in line if x[5] == first]
                    yield "spans", place | {"span_no": s, "text": "".join(x[0] for x in span)} | _around(span)
                    for k, x in enumerate(span):
                        yield "chars", place | {"span_no": s, "char_no": k, "c": x[0], "x0": x[1], "y0": x[2]}
                for w, word in enumerate(_words(line)):
                    yield "words", place | {"word_no": w, "word": "".join(x[0] for x in word)} | _around(word)
            for n, image in enumerate(images):
                yield "images", at | {"image_no": n} | dict(zip(("x0", "y0", "x1", "y1"), image, strict=True))
            yield "pages", at | {"width_pt": box[2] - box[0], "height_pt": box[3] - box[1], "rotation": int(pdf.get(page.get("Rotate")) or 0) % 360, "text": "\n".join(texts), "drawing_count": paths}


def _around(letters: list[tuple]) -> dict:
    return {"x0": min(x[1] for x in letters), "y0": min(x[2] for x in letters), "x1": max(x[3] for x in letters), "y1": max(x[4] for x in letters)}


def _words(line: list[tuple]) -> list[list[tuple]]:
    """Letters between white space, and between gaps of a third of a letter's height."""
    out: list[list[tuple]] = []
    fresh = True
    for x in line:
        if x[0].isspace():
            fresh = True
            continue
        if fresh or x[1] - out[-1][-1][3] > (x[4] - x[2]) / 3:
            out.append([])
        out[-1].append(x)
        fresh = False
    return out
