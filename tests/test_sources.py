import io
import json
import zipfile

from reelspark.sources import captions, epub
from reelspark.sources.files import copy_files, inside, list_files, load_settings, write_bytes, write_texts


def test_json3(spark):
    events = [
        {"tStartMs": 0, "dDurationMs": 5, "segs": [{"utf8": "a "}, {"utf8": "\n b"}]},
        {"tStartMs": 5, "aAppend": 1, "segs": [{"utf8": "no"}]},
        {"tStartMs": 6},
        {"segs": [{"utf8": " \n"}]},
        {"segs": [{"utf8": "c"}]},
    ]
    files = spark.createDataFrame([("x", json.dumps({"events": events})), ("bad", "{"), ("none", None)], "path string, value string")
    assert [tuple(r) for r in captions.json3_cues(files).orderBy("seq").collect()] == [("x", 0, 0, 5, "a b"), ("x", 4, 0, 0, "c")]


def test_vtt_and_srt():
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>Hi</c>  there\n\n00:00:02.000 --> 00:00:03.000\nHi there\n\n00:03.000 --> 00:04.000\nno hour\n\n00:00:05.000 --> 00:00:06.000\n00:00:07.000 --> 00:00:08.000\nlast"
    assert captions.parse_vtt(vtt) == [(0, 1000, 2000, "Hi there"), (1, 7000, 8000, "last")]
    srt = "1\n00:00:00,000 --> 00:00:03,5\nLine one\nLine two\n\n2\n00:00:03,500 --> 00:00:07,000\n\n\nno time\n"
    assert captions.parse_srt(srt) == [(0, 0, 3005, "Line one Line two"), (1, 3500, 7000, "")]


def test_markdown_and_lists(spark):
    text = "# 01. Title\n\n[YouTube](u)\n\nOne\ntwo\n\nThree\n"
    row = spark.createDataFrame([(text,)], "t string").select(captions.md_paragraphs("t")).first()[0]
    assert row == ["One two", "Three"]
    lines = spark.createDataFrame([(1, "a\tT\tx"), (2, "none"), (3, "b\tU")], "line_no int, value string")
    assert [tuple(r) for r in captions.playlist_entries(lines).orderBy("idx").collect()] == [(1, "a", "T\tx"), (2, "b", "U")]
    files = spark.createDataFrame([("v", "v.vtt"), ("v", "v-orig.json3"), ("w", "w-orig.vtt")], "video_id string, name string")
    assert [tuple(r) for r in captions.pick_captions(files).collect()] == [("v", "v.vtt")]
    assert captions.pick_captions(files, auto=True).count() == 2


PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
CHAPTER = """<html><body><h1 id="top">Intro</h1><p>Before.</p><figure><img src="img/a.png" alt="A"/><figcaption>Cap</figcaption></figure>
<p>After.</p><h2 id="t1">Topic</h2><p>Text <img src="../OPS/img/gone.png"/> inside.</p><div><h2 id="t2">Two</h2></div></body></html>"""


def book(nav=True, ncx=False, hostile=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", ('<!DOCTYPE x [<!ENTITY a "b">]>' if hostile else "") + '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        nav_item = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
        ncx_item = '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else ""
        z.writestr(
            "OPS/book.opf",
            f'<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:title>Other</dc:title><dc:creator>Me</dc:creator></metadata><manifest>{nav_item}{ncx_item}'
            '<item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="a" href="img/a.png" media-type="image/png"/><item id="s" href="s.css" media-type="text/css"/></manifest>'
            f'<spine{" toc=\"ncx\"" if ncx else ""}><itemref idref="c1"/><itemref idref="missing"/></spine></package>',
        )
        z.writestr("OPS/c1.xhtml", CHAPTER)
        z.writestr("OPS/img/a.png", PNG)
        z.writestr("OPS/s.css", "p {}")
        z.writestr("OPS/nav.xhtml", '<html><body><nav epub:type="toc"><ol><li><a href="c1.xhtml">Ch 1</a><ol><li><a href="c1.xhtml#t1">Topic A</a></li><li><a href="c1.xhtml#t2">B/C?</a></li></ol></li></ol></nav></body></html>')
        z.writestr("OPS/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c1.xhtml"/><navPoint><content src="c1.xhtml#t1"/></navPoint></navPoint></navMap></ncx>')
    return out.getvalue()


def test_epub_package(spark):
    books = spark.createDataFrame([("a", bytearray(book())), ("n", bytearray(book(False, True))), ("f", bytearray(book(False))), ("h", bytearray(book(hostile=True))), ("x", bytearray(b"no zip"))], "path string, content binary")
    rows = {r.path: r for r in epub.packages(books).collect()}
    assert (rows["a"].title, rows["a"].creator, rows["a"].language, rows["a"].spine) == ("Book", "Me", None, ["OPS/c1.xhtml"])
    assert [t.breadcrumb for t in rows["a"].toc] == [["Ch 1"], ["Ch 1", "Topic A"], ["Ch 1", "B/C?"]]
    assert [t.label for t in rows["n"].toc] == ["One", "(untitled)"]
    assert [t.label for t in rows["f"].toc] == ["c1"]
    assert "UnsafeXml" in rows["h"].error and rows["x"].error
    pages = {r.out_path: r.html for r in epub.book_pages(books.where("path = 'a'")).collect()}
    assert sorted(pages) == ["01. Ch 1/00. Ch 1.html", "01. Ch 1/01. Topic A.html", "01. Ch 1/02. B C.html"]
    assert "Before." in pages["01. Ch 1/00. Ch 1.html"] and "Topic" not in pages["01. Ch 1/00. Ch 1.html"]
    assert 'src="../assets/a.png"' in pages["01. Ch 1/00. Ch 1.html"] and "assets/s.css" in pages["01. Ch 1/01. Topic A.html"]


def test_epub_images(spark):
    seen = epub.image_occurrences(spark.createDataFrame([("a", bytearray(book()))], "path string, content binary"))
    a, gone = sorted(seen.collect(), key=lambda r: r.seq)
    assert (a.source_image, a.caption, a.in_figure, a.nearest_heading, a.context_before, a.context_after, a.width, a.height) == ("OPS/img/a.png", "Cap", True, "Intro", "Before.", "After.", 3, 2)
    assert (gone.present, gone.breadcrumb, gone.context_after) == (False, ["Ch 1", "Topic A"], "Text inside.")
    assert tuple(epub.image_stats(seen).first()) == ("a", 1, 2, 1, 1)
    assert epub.image_index(seen).count() == 2
    payload = json.loads(epub.book_payloads(spark.createDataFrame([("a", bytearray(book())), ("x", bytearray(b""))], "path string, content binary")).first().payload)
    assert (payload["book"], payload["image_count"], payload["occurrence_count"], [i["source_image"] for i in payload["images"]]) == ("Book", 1, 2, ["OPS/img/a.png"])


def test_epub_parts():
    assert epub.unique_names(["a/x.png", "b/x.png", "c/x_1.png", "a/x.png"]) == {"a/x.png": "x.png", "b/x.png": "x_1.png", "c/x_1.png": "x_1_1.png"}
    parts = epub.split_by_anchor('<body><p>0</p><div><p id="a"></p><p id="b"></p></div><p>1</p></body>', ["a", "b", "zz"])
    assert parts[None] == ["<p>0</p>"] and len(parts["a"]) == 1 and parts["b"] == [parts["a"][0], "<p>1</p>"]
    assert epub.toc_json([{"label": "x", "children": [{"label": "y", "children": []}]}]) == [{"label": "x", "children": [{"label": "y"}]}]
    assert epub.image_size(b"GIF89a\x05\x00\x06\x00") == (5, 6) and epub.image_size(b"?") == (None, None)


def test_image_contexts():
    """A paragraph inside an item ends the item's capture; a figure's images share its caption; links are quoted."""
    html = '<ul><li>one <p>two</p> three</li></ul><img src="a"/><p>x</p><figure><img src="b"/><figure><img src="c"/></figure>all <b>text</b></figure><p></p><li>y</li>'
    a, b, c = epub.chapter_images(html, {}, ["T"])
    assert (a["context_before"], a["context_after"], b["context_before"], b["context_after"]) == ("two", "x", "x", "y")
    assert b["caption"] == c["caption"] == "all text" and not a["in_figure"] and c["breadcrumb"] == ["T"]
    assert 'src="../assets/a%20b.png"' in epub.render_page("t", ['<img src="i/a%20b.png">'], "c.xhtml", {"i/a b.png": "a b.png"}, 1, [])


def test_book_assets_and_payload(spark, tmp_path):
    books = spark.createDataFrame([("a", bytearray(book())), ("x", bytearray(b""))], "path string, content binary")
    assert [r.error for r in write_bytes(epub.book_assets(books), f"file://{tmp_path}/out").collect()] == [None, None]
    assert (tmp_path / "out/assets/a.png").read_bytes() == PNG and (tmp_path / "out/assets/s.css").read_text() == "p {}"
    assert tuple(epub.book_totals(books).first()) == (1, 1, 3, 2)
    payload = json.loads(epub.book_payloads(books).first().payload)
    assert payload["toc"] == [{"label": "Ch 1", "children": [{"label": "Topic A"}, {"label": "B/C?"}]}]
    assert [r.error for r in copy_files(spark, f"{tmp_path}/out", f"{tmp_path}/copy", ("*.png", "*.txt")).collect()] == [None]
    assert (tmp_path / "copy/assets/a.png").read_bytes() == PNG and not (tmp_path / "copy/assets/s.css").exists()


def test_several_patterns(spark, tmp_path):
    for name in ("a.md", "b.txt", "c.html", "index.html", "d.png"):
        (tmp_path / name).write_text(name)
    got = captions.read_files(spark, str(tmp_path), ("*.md", "*.txt", "*.html"), exclude=("index.html",)).collect()
    assert sorted(r.value for r in got) == ["a.md", "b.txt", "c.html"]
    assert list_files(spark, str(tmp_path), "*.html", ("index.html",)).count() == 1


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.html", "x"), ("../out.html", "y"), (None, "z")], "out_path string, html string")
    errors = {r.out_path: r.error for r in write_texts(rows, str(tmp_path)).collect()}
    assert errors["a/b.html"] is None and errors["../out.html"] and (tmp_path / "a/b.html").read_text() == "x"
    assert list_files(spark, str(tmp_path), "*.html").count() == 1
    (tmp_path / ".env").write_text("# no\nA = 1\nB=2\n")
    assert load_settings(str(tmp_path / ".env"), {"B": "0"}) == {"A": "1", "B": "0"}
    assert inside("/x", "a/../b") and not inside("/x", "../xy")
