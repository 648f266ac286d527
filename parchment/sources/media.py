"""Facts of documents from their bytes: pages of PDFs, sizes of images, and what keeps them from being read."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.config import DEFAULTS

# The padding of PDF passwords, and the most pixels that count as safe to open.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
MOST_PIXELS = DEFAULTS.max_pixels
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}  # JPEG segments with the image's size
MOST_NESTED = 60
MOST_DECODED = 64 << 20


class Ref(int):
    """Number of an indirect object."""


class Pdf:
    """Objects of a PDF by number: from its cross-reference tables and streams, or else from a search through the bytes.

    Object streams of encrypted files are not decrypted; a page tree in one of them raises PermissionError.
    """

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.held = data, {}, {}, {}
        if b"%PDF" not in data[:1024]:
            raise ValueError("no header")
        try:
            self.read_tables(int(re.findall(rb"startxref\s+(\d+)", data)[-1]))
            self.root()
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError, struct.error, zlib.error, RecursionError):
            self.places, self.held = {}, {}
            for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b", data):
                self.places[int(m[1])] = (m.start(), None)
            for m in re.finditer(rb"\btrailer\b", data):
                found = self.value(m.end())[0]
                if isinstance(found, dict) and "Root" in found:
                    self.trailer |= found
            if "Root" not in self.trailer:
                self.trailer["Root"] = next(Ref(i) for i in self.places if self.kind(i) == "Catalog")

    def kind(self, number: int):
        try:
            return self.at(number).get("Type")
        except (ValueError, KeyError, AttributeError, TypeError):
            return None

    def value(self, i: int, depth: int = 0):
        """The value that begins at or after place i, and where it ends."""
        d = self.data
        i = re.compile(rb"(?:[\x00\s]|%[^\r\n]*)*").match(d, i).end()
        if depth > MOST_NESTED:
            raise ValueError("nested too deep")
        if d[i : i + 2] == b"<<":
            out, i = {}, i + 2
            while True:
                key, i = self.value(i, depth + 1)
                if key == ">>":
                    return out, i
                if not isinstance(key, str):
                    raise ValueError("a key is no name")
                out[key], i = self.value(i, depth + 1)
        if d[i : i + 1] == b"[":
            held, i = [], i + 1
            while True:
                x, i = self.value(i, depth + 1)
                if x == "]":
                    return held, i
                held.append(x)
        if m := re.compile(rb">>|\]").match(d, i):
            return m[0].decode(), m.end()
        if m := re.compile(rb"/([^\x00\s/<>\[\](){}%]*)").match(d, i):
            return m[1].decode("latin-1"), m.end()
        if m := re.compile(rb"(\d+)\s+\d+\s+R\b").match(d, i):
            return Ref(m[1]), m.end()
        if m := re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)").match(d, i):
            return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
        if m := re.compile(rb"<([\s0-9A-Fa-f]*)>").match(d, i):
            digits = re.sub(rb"\s", b"", m[1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.end()
        if d[i : i + 1] == b"(":
            return self.text(i + 1)
        if m := re.compile(rb"true|false|null").match(d, i):
            return {b"true": True, b"false": False, b"null": None}[m[0]], m.end()
        raise ValueError("no value")

    def text(self, i: int) -> tuple[bytes, int]:
        out, depth = bytearray(), 1
        for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|([^\\()]+)", re.S).finditer(self.data, i):
            if m[1]:
                out += bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}.get(m[1], m[1])
            elif m[2]:
                depth += 1 if m[2] == b"(" else -1
                if not depth:
                    return bytes(out), m.end()
                out += m[2]
            else:
                out += m[3]
        raise ValueError("a text doesn't end")

    def read_tables(self, at: int) -> None:
        """Places of objects, the newest table first, and the trailers' entries."""
        seen, todo = set(), [at]
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if m := re.compile(rb"\s*xref\b").match(self.data, at):
                i = m.end()
                while m := re.compile(rb"\s*(\d+)\s+(\d+)(?=\s+\d{10} )").match(self.data, i):
                    i, number = m.end(), int(m[1])
                    for k in range(int(m[2])):
                        m = re.compile(rb"\s*(\d{10}) \d{5} ([nf])").match(self.data, i)
                        i = m.end()
                        if m[2] == b"n":
                            self.places.setdefault(number + k, (int(m[1]), None))
                found = self.value(re.compile(rb"\s*trailer").match(self.data, i).end())[0]
            else:
                found, data = self.stream(at)
                sizes, size = found["W"], sum(found["W"])
                index = found.get("Index", [0, found["Size"]])
                rows = [data[k : k + size] for k in range(0, len(data) - size + 1, size)]
                numbers = [n + k for n, count in zip(index[::2], index[1::2], strict=True) for k in range(min(count, len(rows)))]
                for number, row in zip(numbers, rows, strict=False):
                    kind = int.from_bytes(row[: sizes[0]]) if sizes[0] else 1
                    a, b = int.from_bytes(row[sizes[0] : sizes[0] + sizes[1]]), int.from_bytes(row[sizes[0] + sizes[1] :])
                    if kind in (1, 2):
                        self.places.setdefault(number, (a, None) if kind == 1 else (a, b))
            self.trailer = found | self.trailer
            todo += [found[x] for x in ("XRefStm", "Prev") if isinstance(found.get(x), int)]

    def stream(self, at: int) -> tuple[dict, bytes]:
        """Dictionary and decoded bytes of the stream object at a place."""
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        head, i = self.value(m.end())
        start = re.compile(rb"\s*stream\r?\n").match(self.data, i).end()
        size = self.get(head["Length"])
        data = self.data[start : start + size]
        kind = self.get(head.get("Filter"))
        kind = kind[0] if isinstance(kind, list) and len(kind) == 1 else kind
        if kind == "FlateDecode":
            data = zlib.decompressobj().decompress(data, MOST_DECODED)
        elif kind:
            raise ValueError("an unknown filter")
        parms = self.get(head.get("DecodeParms")) or {}
        parms = parms[0] if isinstance(parms, list) else parms
        return head, undone(data, parms.get("Columns", 1)) if parms.get("Predictor", 1) >= 10 else data

    def at(self, number: int):
        if number not in self.held:
            place, nth = self.places[number]
            if nth is None:
                m = re.compile(rb"\s*(\d+)\s+\d+\s+obj").match(self.data, place)
                if not m or int(m[1]) != number:
                    raise ValueError("an object isn't in its place")
                self.held[number] = self.value(m.end())[0]
            else:
                if "Encrypt" in self.trailer:
                    raise PermissionError
                head, data = self.stream(self.places[place][0])
                inner = Pdf.__new__(Pdf)
                inner.data = data
                heads = list(map(int, data[: head["First"]].split()))
                self.held[number] = inner.value(head["First"] + heads[2 * nth + 1])[0]
        return self.held[number]

    def get(self, x):
        for _ in range(MOST_NESTED):
            if not isinstance(x, Ref):
                return x
            x = self.at(x)
        raise ValueError("a reference leads nowhere")

    def root(self) -> dict:
        return self.get(self.get(self.trailer["Root"])["Pages"])

    def locked(self) -> bool:
        """Whether the empty password doesn't open it; newest encryption (revision 6) counts as locked."""
        if "Encrypt" not in self.trailer:
            return False
        e = self.get(self.trailer["Encrypt"])
        if not isinstance(e, dict) or e.get("Filter") != "Standard":
            return True
        revision, user = e["R"], self.get(e["U"])
        if revision == 5:
            return hashlib.sha256(user[32:40]).digest() != user[:32]
        if revision not in (2, 3, 4):
            return True
        name = self.get((self.get(self.trailer.get("ID")) or [b""])[0])
        size = 5 if revision == 2 else e.get("Length", 40) // 8
        key = hashlib.md5(PAD + self.get(e["O"])[:32] + struct.pack("<I", e["P"] & 0xFFFFFFFF) + name + (b"\xff" * 4 if revision == 4 and e.get("EncryptMetadata") is False else b"")).digest()[:size]
        if revision == 2:
            return rc4(key, PAD) != user
        for _ in range(50):
            key = hashlib.md5(key).digest()[:size]
        check = hashlib.md5(PAD + name).digest()
        for i in range(20):
            check = rc4(bytes(k ^ i for k in key), check)
        return check != user[:16]

    def pages(self) -> int:
        """The page tree's count, or else its leaves."""
        top = self.root()
        count = self.get(top.get("Count"))
        if isinstance(count, int) and count >= 0:
            return count
        leaves, todo, seen = 0, [top], set()
        while todo:
            node = todo.pop()
            for kid in self.get(node.get("Kids")) or []:
                if isinstance(kid, Ref) and kid not in seen:
                    seen.add(kid)
                    inner = self.get(kid)
                    if isinstance(inner, dict):
                        leaves += inner.get("Type") == "Page"
                        todo += [inner] * ("Kids" in inner)
        return leaves


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def undone(data: bytes, columns: int) -> bytes:
    """Rows of bytes without the predictor that each names first."""
    out, above = bytearray(), bytearray(columns)
    for k in range(0, len(data) - columns, columns + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + columns])
        for i in range(columns):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            near = min((left, up, corner), key=lambda x, p=left + up - corner: abs(p - x))
            row[i] = row[i] + (0, left, up, (left + up) // 2, near)[kind] & 255
        out += row
        above = row
    return bytes(out)


def pdf_facts(data: bytes) -> tuple[int | None, str | None]:
    """Pages of a PDF, or what is wrong with it."""
    try:
        pdf = Pdf(data)
        if pdf.locked():
            return None, "the PDF has a password"
        pages = pdf.pages()
    except PermissionError:
        return None, "the PDF has a password"
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, StopIteration, OverflowError, RecursionError, struct.error, zlib.error):
        return None, "the PDF is broken"
    return (pages, None) if pages else (None, "the PDF has no pages")


def orientation(tiff: bytes) -> int:
    """EXIF orientation, 1 to 8; 1 if there is none."""
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        at = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
    except (KeyError, struct.error):
        pass
    return 1


def jpeg_facts(data: bytes) -> tuple[int, int, int]:
    """Width, height and orientation of a JPEG that goes on to its end."""
    i, size, turn = 2, None, 1
    while True:
        while data[i] == 0xFF and data[i + 1] == 0xFF:
            i += 1
        if data[i] != 0xFF:
            raise ValueError("no segment")
        mark = data[i + 1]
        if mark == 0xDA:
            if size is None or data.rfind(b"\xff\xd9") < i:
                raise ValueError("cut off")
            return *size, turn
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            i += 2
            continue
        length = struct.unpack_from(">H", data, i + 2)[0]
        body = data[i + 4 : i + 2 + length]
        if mark in FRAMES and size is None:
            size = struct.unpack_from(">HH", body, 1)[::-1]
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            turn = orientation(body[6:])
        i += 2 + length


def png_facts(data: bytes) -> tuple[int, int, int]:
    """Width, height and orientation of a PNG that goes on to its end."""
    i, size, turn = 8, None, 1
    while True:
        length, kind = struct.unpack_from(">I4s", data, i)
        body = data[i + 8 : i + 8 + length]
        if len(body) < length:
            raise ValueError("cut off")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            turn = orientation(body)
        elif kind == b"IEND":
            return *size, turn
        i += 12 + length


def image_facts(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int | None, int | None, int | None, str | None]:
    """Width and height as shown (turned by the orientation), the orientation, and what is wrong."""
    try:
        width, height, turn = png_facts(data) if data[:1] == b"\x89" else jpeg_facts(data)
    except (ValueError, IndexError, TypeError, struct.error):
        return None, None, None, "the image is broken or cut off"
    if not width or not height or width * height > most_pixels:
        return None, None, None, "the image is empty or too large to open"
    return (height, width, turn, None) if turn >= 5 else (width, height, turn, None)


def media_facts(files: DataFrame, suffix_col: str = "suffix", content_col: str = "content", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """`files` without the content, with n_pages, width, height, orientation, error_class and error from it.

    PDFs have pages, images one page and a size. PdfError and UnreadableImage say what keeps a file from being
    read; other types and files without content have neither facts nor errors, their rules are those for
    uploads. Rows are independent; a file is in one task's memory at a time with its batch.
    """
    names = ["n_pages", "width", "height", "orientation", "error_class", "error"]
    kept = [x for x in files.columns if x not in (content_col, *names)]
    schema = T.StructType([*(files.schema[x] for x in kept), *(T.StructField(x, T.IntegerType()) for x in names[:4]), *(T.StructField(x, T.StringType()) for x in names[4:])])

    def facts(suffix: str | None, data: bytes | None) -> tuple:
        suffix = (suffix or "").lower()
        if not data or suffix not in (".pdf", ".png", ".jpg", ".jpeg"):
            return None, None, None, None, None, None
        if suffix == ".pdf":
            pages, fault = pdf_facts(data)
            return pages, None, None, None, fault and "PdfError", fault
        width, height, turn, fault = image_facts(data, most_pixels)
        return None if fault else 1, width, height, turn, fault and "UnreadableImage", fault

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffixes = batch.column(suffix_col).to_pylist()
            found = [facts(suffix, data.as_py()) for suffix, data in zip(suffixes, batch.column(content_col), strict=True)]
            columns = [pa.array([x[i] for x in found], pa.int32() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *columns], schema.names)

    return files.select(*dict.fromkeys((*kept, suffix_col, content_col))).mapInArrow(run, schema)
