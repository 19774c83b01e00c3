import numpy as np
import pytest
from pyspark.sql import functions as F

from tintwerk.operators import export, pixels
from tintwerk.sources import files

GREY = "page_key long, width int, height int, pixels binary, words array<struct<x0:double,y0:double,x1:double,y1:double,line:int>>"


def page(h=1200, w=1000, ground=250):
    return np.full((h, w), ground, np.uint8)


def written(a, lines=range(100, 1100, 60)):
    for y in lines:
        a[y : y + 20, 100:900:] = 30
    return a


def turned(a, degrees):
    """Nearest pixels of an image turned counter-clockwise."""
    h, w = a.shape
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - h / 2, x - w / 2
    fy, fx = np.rint(y * np.cos(t) + x * np.sin(t) + h / 2).astype(int), np.rint(x * np.cos(t) - y * np.sin(t) + w / 2).astype(int)
    inside = (fy >= 0) & (fy < h) & (fx >= 0) & (fx < w)
    return np.where(inside, a[np.clip(fy, 0, h - 1), np.clip(fx, 0, w - 1)], 250).astype(np.uint8)


def rows_of(spark, *images, words=()):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes()), list(words)) for i, a in enumerate(images)], GREY)


def test_skew():
    for degrees in (-3.0, -0.4, 0.0, 1.7, 4.5):
        assert pixels.skew_of(turned(written(page()), degrees)) == pytest.approx(-degrees, abs=0.21)
    assert pixels.skew_of(page()) == 0.0


def test_backgrounds():
    even = written(page())
    assert (pixels.cleared(even) == even).all()
    shaded = (written(page()) * np.linspace(0.5, 1, 1000)[None, :]).astype(np.uint8)
    out = pixels.cleared(shaded)
    assert out[20:80].min() > 235 and out[105:115, 120:880].max() < 120
    faint = np.where(written(page()) < 100, 140, 250).astype(np.uint8)
    assert pixels.cleared(faint)[105:115, 120:880].max() < 30


def test_lines_go_and_strokes_stay():
    r = np.random.default_rng(3)
    ink = r.random((60, 80)) < 0.3
    ink[10, 5:70], ink[:, 40] = True, True
    got = pixels.without_lines(ink, 12)
    want = ink.copy()
    for m in (want, want.T):
        for row in m:
            at = 0
            while at < len(row):
                end = at
                while end < len(row) and row[end]:
                    end += 1
                if end - at >= 12:
                    row[at:end] = False
                at = max(end, at + 1)
    assert (got == want).all() and not got[10, 5:70].all()


def test_unread_and_missed_regions(spark):
    a = page()
    a[100:120, 100:500] = 20  # a word that was read
    for k in range(0, 160, 8):  # a scrawl
        a[600 + k // 4 : 612 + k // 4, 300 + k : 303 + k] = 20
        a[640 - k // 4 : 652 - k // 4, 304 + k : 307 + k] = 20
    a[900:904, 50:950] = 20  # a line
    word = (100.0, 100.0, 500.0, 120.0, 0)
    got = pixels.unread_regions(rows_of(spark, a, page(), words=[word])).collect()
    assert len(got) == 1 and got[0].page_key == 0 and got[0].x0 <= 300 <= 460 <= got[0].x1 and got[0].y0 <= 604 and got[0].y1 >= 648
    b = page()
    b[100:120, 100:500] = 20
    b[400:424, 200:420:3] = 20
    b[400:424, 201:421:3] = 20
    read = pixels.reread(rows_of(spark, b, words=[word]), lambda crop: [("Wort", 25.0, 22.0, 60.0, 40.0, 7)] if (crop < 100).any() else []).collect()
    assert [(x.text, x.line) for x in read] == [("Wort", 1)] and 195 < read[0].x0 + 20 < 260 and 380 < read[0].y0 + 20 < 425
    assert pixels.reread(rows_of(spark, page()), lambda crop: [("x", 0.0, 0.0, 1.0, 1.0, 0)]).count() == 0
    assert {r.angle for r in pixels.skews(rows_of(spark, page())).collect()} == {0.0} and pixels.clear_backgrounds(rows_of(spark, b)).count() == 1


def test_colour(spark):
    grey, red = np.full((50, 50, 3), 90, np.uint8), np.full((50, 50, 3), 90, np.uint8)
    red[:10, :, 0] = 250
    got = pixels.coloured(spark.createDataFrame([(0, bytearray(grey.tobytes())), (1, bytearray(red.tobytes())), (2, bytearray())], "page_key long, pixels binary")).collect()
    assert {r.page_key: r.colour for r in got} == {0: False, 1: True, 2: False}


def test_labels_fit(spark):
    rows = [("Mandant", "Mdt.", 100.0, 14.0), ("Mandant", "Mdt.", 14.0, 14.0), ("X", "X", 3.0, 14.0), ("", "", 50.0, 5.0)]
    table = spark.createDataFrame(rows, "label string, short string, w double, h double")
    got = table.select(export.fitted_label(*map(F.col, ("label", "short", "w", "h"))).alias("f")).collect()
    wide = (833 + 556 * 4 + 556 + 278) / 1000
    assert (got[0].f.text, got[0].f.size) == ("Mandant", pytest.approx(10.08)) and wide * 10.08 < 98
    assert got[1].f.text == "Mdt." and got[1].f.size == pytest.approx(12 / ((833 + 556 + 278 + 278) / 1000), rel=1e-6)
    assert (got[2].f.text, got[2].f.size) == ("X", pytest.approx(10.08)) and got[3].f.size == pytest.approx(3.6)


def test_documents_and_notes(spark):
    rows = [("/a/b.txt", bytearray(b"Seite eins\fSeite zwei")), ("/a/a.txt", bytearray("Erste äö".encode())), ("/a/leer.txt", bytearray(b" \n")), ("/a/x.pdf", bytearray(b"%PDF"))]
    pages, notes = files.load_pages(spark.createDataFrame(rows, "path string, content binary"))
    assert sorted((p.doc_seq, p.page_no, [w.text for w in p.words]) for p in pages.collect()) == [(1, 0, ["Erste", "äö"]), (2, 0, ["Seite", "eins"]), (2, 1, ["Seite", "zwei"])]
    assert {n.path: n.note for n in notes.collect()} == {"/a/leer.txt": "no pages", "/a/x.pdf": "ValueError: no reader for .pdf"}
    known = spark.createDataFrame([("file:///a/b/../b.pdf",)], "path string")
    new = files.new_files(spark.createDataFrame([("/a/./b.pdf",), ("/a//c.pdf",), ("/a/c.pdf",)], "path string"), known)
    assert {files_.path.replace("//", "/") for files_ in new.collect()} == {"/a/c.pdf"}
