"""Scanned PDFs, written here object by object."""

import io
import zlib

import numpy as np
import pytest

from folium.models import png
from folium.sources import files, pdf


def picture(k, shape=(6, 5)):
    return np.random.default_rng(k).integers(0, 256, (*shape, 3)).astype(np.uint8)


def image(data, width, height, extra=b"/ColorSpace /DeviceRGB /BitsPerComponent 8", filters=b"/FlateDecode"):
    return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d %s /Filter %s /Length %d >>\nstream\n%s\nendstream" % (width, height, extra, filters, len(data), data)


def made(images, packed=False, nested=False, resources=None):
    """A PDF of one image a page: a table, or cross-reference and object streams; pages in a flat tree or in branches of two."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    n = len(images)
    page, picture_of = lambda k: 10 + 2 * k, lambda k: 11 + 2 * k
    for k, content in enumerate(images):
        parent = 2 if not nested else 1000 + k // 2
        objects[page(k)] = b"<< /Type /Page /Parent %d 0 R %s >>" % (parent, b"/Resources << /XObject << /Im%d %d 0 R >> >>" % (k, picture_of(k)) if content else b"")
        if content:
            objects[picture_of(k)] = content
    if nested:
        for b in range(0, n, 2):
            kids = b" ".join(b"%d 0 R" % page(k) for k in range(b, min(b + 2, n)))
            objects[1000 + b // 2] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (min(2, n - b), kids)
        kids = b" ".join(b"%d 0 R" % (1000 + b // 2) for b in range(0, n, 2))
    else:
        kids = b" ".join(b"%d 0 R" % page(k) for k in range(n))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >> %% (odd) comment" % (n, kids)
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\n"), {}
    inside = {k: v for k, v in objects.items() if b"stream" not in v} if packed else {}
    for k, v in objects.items():
        if k not in inside:
            places[k] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    if packed:
        heads, body = [], b""
        for i, (k, v) in enumerate(inside.items()):
            heads += [k, len(body)]
            body += v.split(b" %")[0] + b"\n"
            places[k] = (2, 5000, i)
        head = b" ".join(b"%d" % x for x in heads) + b"\n"
        data = zlib.compress(head + body)
        places[5000] = (1, len(out), 0)
        out += b"5000 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (len(inside), len(head), len(data), data)
        at = len(out)
        rows = np.array([[t, *x.to_bytes(4, "big"), *g.to_bytes(2, "big")] for _, (t, x, g) in sorted(places.items())], np.uint8)
        up = rows.astype(int)
        up[1:] -= rows[:-1]
        data = zlib.compress(b"".join(b"\x02" + bytes((r % 256).tolist()) for r in up))
        index = b" ".join(b"%d 1" % k for k in sorted(places))
        out += b"6000 0 obj\n<< /Type /XRef /Size 6001 /W [1 4 2] /Index [%s] /Root 1 0 R /Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 7 >>] /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (index, len(data), data)
    else:
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, x) for k, (_, x, _) in sorted(places.items()))
        out += b"trailer\n<< /Size 6000 /Root 1 0 R /ID [(a\\)b(c)) <0A1>] >>\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at


def rgb(k):
    return image(zlib.compress(picture(k).tobytes()), 5, 6)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("nested", [False, True])
def test_pages_of_both_kinds_of_files(packed, nested):
    got = pdf.pages(made([rgb(k) for k in range(7)], packed, nested))
    assert len(got) == 7
    for k, content in enumerate(got):
        assert (png.decode(content) == picture(k)).all()


def test_kinds_of_images():
    grey, bits = picture(1)[:, :, 0], np.random.default_rng(2).integers(0, 2, (6, 5)).astype(np.uint8)
    up = np.concatenate([np.full((6, 1), 2), np.diff(picture(3).reshape(6, -1).astype(int), axis=0, prepend=0) % 256], axis=1).astype(np.uint8)
    palette = b"<" + b"".join(b"%02X" % v for v in range(12)) + b">"
    codes = np.random.default_rng(4).integers(0, 4, (6, 5)).astype(np.uint8)
    jpeg = b"\xff\xd8 not parsed \xff\xd9"
    content = made(
        [
            image(zlib.compress(grey.tobytes()), 5, 6, b"/ColorSpace /DeviceGray /BitsPerComponent 8"),
            image(zlib.compress(np.packbits(bits, axis=1).tobytes()), 5, 6, b"/ColorSpace /DeviceGray /BitsPerComponent 1"),
            image(zlib.compress(np.packbits(bits, axis=1).tobytes()), 5, 6, b"/ImageMask true /Decode [1 0]"),
            image(zlib.compress(up.tobytes()), 5, 6, b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /DecodeParms << /Predictor 15 /Colors 3 /Columns 5 >>"),
            image(zlib.compress(codes.tobytes()), 5, 6, b"/ColorSpace [/Indexed /DeviceRGB 3 " + palette + b"] /BitsPerComponent 8"),
            image(jpeg, 5, 6, filters=b"/DCTDecode"),
            image(zlib.compress(jpeg), 5, 6, filters=b"[/FlateDecode /DCTDecode]"),
        ]
    )
    got = pdf.pages(content)
    assert (png.decode(got[0])[:, :, 0] == grey).all() and (png.decode(got[1])[:, :, 2] == bits * 255).all() and (png.decode(got[2])[:, :, 1] == 255 - bits * 255).all()
    assert (png.decode(got[3]) == picture(3)).all() and (png.decode(got[4]) == codes[:, :, None] * 3 + np.arange(3)).all()
    assert got[5] == got[6] == jpeg


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got


@pytest.mark.parametrize("packed", [False, True])
def test_first_page_reads_little(packed):
    big = [image(zlib.compress(picture(k, (300, 200)).tobytes()), 200, 300) for k in range(20)]
    file = Counted(made(big, packed))
    rows = list(pdf.read_pages(file, "/x/a b.pdf", first_only=True))
    assert [(r[0], r[2], r[3], r[5]) for r in rows] == [("a_b", 1, 20, None)] and (png.decode(rows[0][4]) == picture(0, (300, 200))).all()
    assert file.n < len(file.getvalue()) / 10


def test_broken_files_are_rows():
    whole = made([rgb(0), None, image(b"zz", 5, 6), image(b"", 5, 6, filters=b"/JPXDecode"), rgb(4)])
    rows = list(pdf.read_pages(io.BytesIO(whole), "a.pdf"))
    assert [r[5] for r in rows] == [None, "page without an image", "broken PDF stream", "PDF filter JPXDecode is not supported", None]
    assert (png.decode(rows[4][4]) == picture(4)).all()
    for content in (b"", b"text", whole[:300], whole.replace(b"/Root 1 0 R", b"/Rot 1 0 R"), whole.replace(b"/Kids", b"/Kid "), whole.replace(b"/Size", b"/Encrypt 1 /Size")):
        rows = list(pdf.read_pages(io.BytesIO(content), "a.pdf"))
        assert rows and all(r[5] for r in rows), content[:20]
        assert list(pdf.read_pages(io.BytesIO(content), "a.pdf", 1, 2)) in ([], rows[-1:]) or content.count(b"/Kid ")


def test_random_damage_never_raises():
    whole, rng = made([rgb(k) for k in range(3)], True), np.random.default_rng(6)
    for _ in range(300):
        bad = bytearray(whole)
        for at in rng.integers(0, len(whole), 4):
            bad[at] = rng.integers(0, 256)
        list(pdf.read_pages(io.BytesIO(bytes(bad)), "a.pdf"))


def test_data_source(spark, tmp_path):
    """Small files share a partition, large ones are several; each page comes once."""
    for name, n in (("a", 3), ("sub/b c", 40), ("d", 0)):
        path = tmp_path / f"{name}.pdf"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(made([rgb(k) for k in range(n)], n == 40, True))
    (tmp_path / "bad.PDF").write_bytes(b"none")
    spark.dataSource.register(pdf.ScannedPdf)
    read = spark.read.format("scanned_pdf").option("split", 2000).load(str(tmp_path))
    rows = read.collect()
    assert sorted((r.document_id, r.page) for r in rows) == sorted([("a", k) for k in (1, 2, 3)] + [("b_c", k) for k in range(1, 41)] + [("bad", 1)])
    assert all((png.decode(r.image) == picture(r.page - 1)).all() for r in rows if r.document_id != "bad") and [r.error for r in rows if r.error] == ["no PDF"]
    assert read.rdd.getNumPartitions() > 4
    first = spark.read.format("scanned_pdf").option("first_only", True).load(str(tmp_path)).collect()
    assert sorted((r.document_id, r.page, r.n_pages) for r in first) == [("a", 1, 3), ("b_c", 1, 40), ("bad", 1, None)]
    one = files.raw_pages(files.input_files(spark, str(tmp_path)), pdf.pages).where("document_id = 'a'").orderBy("page").collect()
    assert [(r.page, bytes(r.image)) for r in one] == [(r.page, bytes(r.image)) for r in sorted((r for r in rows if r.document_id == "a"), key=lambda r: r.page)]
