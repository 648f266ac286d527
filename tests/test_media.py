"""PDF and image facts from files written by hand, and the data source of documents."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from parchment.config import Settings
from parchment.operators import export
from parchment.sources.documents import DocumentReader, intake, read_documents
from parchment.sources.media import PAD, Pdf, image_facts, orientation, pdf_facts, rc4, undone


def classic(objects, trailer=b"", prev=b""):
    """A PDF with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n% \xe2\xe3\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (number, place)
    return bytes(out + b"trailer\n<</Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer + prev, at))


TREE = {1: b"<</Type/Catalog /Pages 2 0 R>>", 2: b"<</Type/Pages /Count 3 /Kids [3 0 R 4 0 R]>>", 3: b"<</Type/Page>>", 4: b"<</Type/Pages/Count 2/Kids[5 0 R 6 0 R]>>", 5: b"<</Type/Page>>", 6: b"<</Type/Page /T (a \\) (b) \\101)>>"}


def modern(pages, predictor=True):
    """A PDF whose catalog and page tree lie in an object stream, found by a cross-reference stream."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[]>>" % pages]
    heads = b"1 0 2 %d " % (len(inner[0]) + 1)
    body = zlib.compress(heads + b" ".join(inner))
    out = bytearray(b"%PDF-1.5\n")
    place = len(out)
    out += b"3 0 obj<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n" % (len(heads), len(body), body)
    at = len(out)
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, place, 0), (1, at, 0)]
    table = [bytes([k]) + struct.pack(">HB", a, b) for k, a, b in rows]
    if predictor:
        raw = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(table, [bytes(4), *table], strict=False))
    else:
        raw = b"".join(table)
    data = zlib.compress(raw)
    parms = b"/DecodeParms<</Predictor 12/Columns 4>>" if predictor else b""
    return bytes(out + b"4 0 obj<</Type/XRef/W[1 2 1]/Size 5/Root 1 0 R/Filter[/FlateDecode]%s/Length %d>>stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (parms, len(data), data, at))


def encrypted(password, revision=3):
    owner, name, p, size = b"o" * 32, b"id", -44, 5 if revision == 2 else 16
    key = hashlib.md5((password + PAD)[:32] + owner + struct.pack("<i", p) + name).digest()[:size]
    if revision == 2:
        user = rc4(key, PAD)
    else:
        for _ in range(50):
            key = hashlib.md5(key).digest()[:size]
        user = hashlib.md5(PAD + name).digest()
        for i in range(20):
            user = rc4(bytes(k ^ i for k in key), user)
        user += bytes(16)
    e = b"<</Filter/Standard/V %d/R %d/Length %d/P %d/O<%s>/U<%s>>>" % (revision - 1, revision, size * 8, p, owner.hex().encode(), user.hex().encode())
    return classic(TREE | {9: e}, b"/Encrypt 9 0 R /ID [(id) (id)]")


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (classic(TREE), (3, None)),
        (classic(TREE).replace(b"startxref\n", b"startxref\n9"), (3, None)),
        (classic(TREE)[:-90], (3, None)),
        (classic({1: TREE[1], 2: b"<</Type/Pages /Kids [3 0 R 4 0 R]>>", **{k: TREE[k] for k in (3, 4, 5, 6)}}), (3, None)),
        (classic(TREE | {2: b"<</Type/Pages /Count 7 0 R>>", 7: b"12"}), (12, None)),
        (modern(4), (4, None)),
        (modern(5, predictor=False), (5, None)),
        (encrypted(b""), (3, None)),
        (encrypted(b"", 2), (3, None)),
        (encrypted(b"secret"), (None, "the PDF has a password")),
        (encrypted(b"secret", 2), (None, "the PDF has a password")),
        (classic(TREE, b"/Encrypt <</Filter/Other>>"), (None, "the PDF has a password")),
        (classic(TREE | {2: b"<</Type/Pages /Count 0/Kids[]>>"}), (None, "the PDF has no pages")),
        (b"%PDF-1.7 nothing else", (None, "the PDF is broken")),
        (b"no header", (None, "the PDF is broken")),
        (classic({1: b"<</Type/Catalog /Pages 1 0 R>>"}).replace(b"/Pages 1 0 R", b"/Pages 8 0 R"), (None, "the PDF is broken")),
        (classic({1: b"<</Type/Catalog /Pages 2 0 R>>", 2: b"2 0 R"}), (None, "the PDF is broken")),
        (classic({1: b"<<" * 200, 2: TREE[2]}), (None, "the PDF is broken")),
    ],
)
def test_pages_of_pdfs(data, want):
    assert pdf_facts(data) == want


def test_newer_tables_come_first():
    old = classic(TREE)
    at = len(old)
    new = b"2 0 obj\n<</Type/Pages/Count 8>>\nendobj\nxref\n2 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R/Prev %d>>\nstartxref\n%d\n" % (at, old.rindex(b"xref\n0 1"), at + old[:0].__len__() + len(b"2 0 obj\n<</Type/Pages/Count 8>>\nendobj\n"))
    assert Pdf(old + new).pages() == 8 and pdf_facts(old) == (3, None)
    assert undone(bytes([1, 5, 1, 1, 4, 1, 1, 1, 3, 4, 4, 4]), 3) == bytes([5, 6, 7, 6, 7, 8, 7, 11, 13])


def exif(turn, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)


def jpeg(width, height, turn=None, end=b"\xff\xd9", order="<"):
    out = b"\xff\xd8\xff\xe0\x00\x04ab"
    if turn is not None:
        body = b"Exif\0\0" + exif(turn, order)
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8, 8, height, width, 0) + b"\xff\xda\x00\x02" + b"data" + end


def png(width, height, turn=None, end=True):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", width, height) + b"\x08\x02\0\0\0") + (chunk(b"eXIf", exif(turn, ">")) if turn else b"") + chunk(b"IDAT", b"x" * 9) + (chunk(b"IEND", b"") if end else b"")


@pytest.mark.parametrize("turn", range(1, 9))
@pytest.mark.parametrize("make", [jpeg, png])
def test_all_orientations(make, turn):
    assert image_facts(make(30, 20, turn)) == ((20, 30) if turn >= 5 else (30, 20)) + (turn, None)


def test_images_without_facts():
    assert image_facts(jpeg(30, 20, 6, order=">"))[:2] == (20, 30) and image_facts(jpeg(30, 20, 99))[2] == orientation(b"XX") == orientation(b"II*\0\x08\0\0\0\x09") == 1
    for data in (b"", b"\xff\xd8", jpeg(3, 4, end=b""), jpeg(3, 4)[:20], png(3, 4, end=False), png(3, 4)[:-14], b"\x89PNG\r\n\x1a\n"):
        assert image_facts(data) == (None, None, None, "the image is broken or cut off")
    for data in (png(0, 5), png(20_000, 20_000)):
        assert image_facts(data)[3] == "the image is empty or too large to open"


def test_files_come_through_to_their_outcomes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    held = {"a.pdf": classic(TREE), "b.PNG": png(4000, 1000), "c.jpg": jpeg(10, 30, 6), "d.pdf": b"", "e.txt": b"text", "f.pdf": b"%PDF- broken", "sub/g.png": b"%PDF-1.4", "h.jpg": jpeg(3, 3)[:-4], "i.pdf": modern(9), "j.pdf": encrypted(b"x"), "k.pdf": b"%PDF" + b"x" * 4000}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    settings = Settings(max_upload_bytes=3000, max_pages=5)
    names = [*held, "none.pdf"]
    files = read_documents(spark, str(tmp_path), names, settings=settings)
    rows = {r.file_name: r for r in intake(files, settings).collect()}
    faults = {k: r.fault and (r.fault.code, r.fault.error) for k, r in rows.items()}
    assert {k for k, x in faults.items() if x is None} == {"a.pdf", "b.PNG", "c.jpg", "i.pdf"}
    assert faults["d.pdf"] == (400, "empty file") and faults["e.txt"] == (415, "unsupported file type") and faults["none.pdf"] == (500, "the file was not found") and faults["k.pdf"] == (413, "file too large")
    assert faults["f.pdf"] == (400, "the PDF is broken") and faults["g.png"] == (415, "content does not match the file type") and faults["h.jpg"] == (400, "the image is broken or cut off") and faults["j.pdf"] == (400, "the PDF has a password")
    assert [(rows[k].n_pages, rows[k].n_used, rows[k].width, rows[k].height) for k in ("a.pdf", "b.PNG", "c.jpg", "i.pdf")] == [(3, 3, None, None), (1, 1, 1600, 400), (1, 1, 30, 10), (9, 5, None, None)]
    assert rows["i.pdf"].warnings == ["The document has 9 pages; only the first 5 were used."] and rows["a.pdf"].warnings == []
    uploads = intake(files, settings).withColumn("doc_id", F.col("path"))
    documents = uploads.where("fault IS NULL").select("doc_id", F.when(F.col("file_name") == "c.jpg", "no JSON").alias("error"), "n_pages")
    got = {r.file_name: (r.place, r.status, r.code) for r in export.outcomes(uploads, documents, "path").collect()}
    assert got["a.pdf"] == (0, "ok", None) and got["c.jpg"] == (2, "error", 422) and got["none.pdf"][1:] == ("error", 500) and len(got) == 12
    every = read_documents(spark, str(tmp_path), content=False)
    assert every.count() == 11 and every.where("content IS NOT NULL").count() == 0 and every.where("length = 0").count() == 1


def test_pieces_of_a_listing(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.pdf").write_bytes(b"x" * 10)
    options = {"path": str(tmp_path), "files_per_part": "4"}
    assert [len(p.held) for p in DocumentReader(options).partitions()] == [4, 4, 2]
    assert [len(p.held) for p in DocumentReader(options | {"bytes_per_part": "25"}).partitions()] == [2] * 5
    assert [p.held for p in DocumentReader({"path": tmp_path.as_uri(), "files": "zz.pdf"}).partitions()] == [[(str(tmp_path / "zz.pdf"), None)]]
    with pytest.raises(ValueError, match="path"):
        DocumentReader({})
