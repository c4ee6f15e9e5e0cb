import io
import json
import zipfile

import pytest

from quillmill.sources import epub, files
from quillmill.sources.markup import cleaned

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><h1>One</h1><script>bad()</script>
<p style="color: red; behavior: url(x)" onclick="bad()">Text &amp; more <img src="../img/a.png" alt="A cat"/></p><p><a href="javascript:x">link</a></p></body></html>"""


def book(**changes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr(
            "OPS/p.opf",
            """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:date>May 1897</dc:date>
            <dc:identifier>urn:isbn:123</dc:identifier></metadata><manifest><item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="img/a.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>""",
        )
        z.writestr("OPS/text/a.xhtml", PAGE)
        z.writestr("OPS/img/a.png", b"png")
    return out.getvalue()


def test_markup():
    markup, text, paragraphs = cleaned(PAGE, {"a.png": "data:image/png;base64,AA"})
    assert "script" not in markup and "onclick" not in markup and "javascript" not in markup and "behavior" not in markup
    assert 'style="color: red;"' in markup and 'src="data:image/png;base64,AA"' in markup
    assert text == "One Text & more link" and paragraphs.split("\n\n") == ["One", "Text & more [Image: A cat]", "link"]
    assert cleaned("") == ("", "", "")


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    rows = {r["path"][-6:]: r for r in epub.read(spark, str(tmp_path)).collect()}
    good, bad = rows["a.epub"], rows["b.epub"]
    assert (good["title"], good["author"], good["language"], good["year"], good["isbn"]) == ("T", "A", "en", 1897, "urn:isbn:123")
    assert good["sections"] == ["One Text & more link"] and good["images"]["a.png"].startswith("data:image/png;base64,") and good["error"] is None
    assert bad["sections"] == [] and bad["error"]


def test_epub_source(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    spark.dataSource.register(epub.EpubSource)
    assert [r["title"] for r in spark.read.format("epub").load(str(tmp_path)).collect()] == ["T"]


def test_files(spark, tmp_path):
    (tmp_path / "batch.json").write_text(json.dumps([{"gutenberg_id": 11}, {"filepath": "x.epub", "genre": "poetry", "questions": 5}]))
    rows = files.batch_config(spark, str(tmp_path / "batch.json")).collect()
    assert [(r["gutenberg_id"], r["genre"], r["questions"], r["age_range"]) for r in rows] == [(11, "fiction", 3, "8-12"), (None, "poetry", 5, "8-12")]
    files.snapshot({"t": spark.range(3)}, str(tmp_path / "snap"))
    assert files.restore(spark, str(tmp_path / "snap"), ["t"])["t"].count() == 3
    files.write_prompts(spark.createDataFrame([("p",)], "prompt string"), str(tmp_path / "prompts"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "prompts")).collect()] == ["p"]
    assert files.run_script(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a;\nCREATE OR REPLACE TEMP VIEW v2 AS SELECT a FROM v1;") == 2
    assert files.alive(spark)
