import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.functions.text import safe_file_name
from quillstone.operators import layout, lines
from quillstone.sources import checkpoints, epub


def test_settings(monkeypatch):
    for value, want in ((None, 5), ("x", 5), ("0", 5), ("9", 9)):
        monkeypatch.delenv("SOME_SIZE", raising=False) if value is None else monkeypatch.setenv("SOME_SIZE", value)
        assert cli.env_int("SOME_SIZE", 5, 1) == want


@pytest.fixture
def folder(tmp_path):
    book = tmp_path / "scan"
    book.mkdir()
    good = "天地玄黃宇宙洪荒，日月盈昃辰宿列張。"
    page = lambda t: {"markdown": {"text": t, "images": {}}}
    pages = ["# 第一章 開始\n" + good * 3 + "他認為", "蔣介石走了。\n" + good, "# 第二章 結束\n" + good, "12\n" + good + "\n# 第三章 尾聲", good, "# 附錄\n" + good]
    checkpoints.write_checkpoint(str(book / "chunk_0_4.pdf.json"), {"result": {"layoutParsingResults": [page(t) for t in pages[:4]]}})
    checkpoints.write_checkpoint(str(book / "chunk_4_6.pdf.json"), {"result": {"layoutParsingResults": [page(t) for t in pages[4:]]}})
    return tmp_path


def test_rebuild_verify_chapterize_scan(spark, folder):
    out = str(folder / "books")
    assert cli.rebuild(spark, str(folder / "scan"), out, "書").count() == 1
    texts = [r.text for r in epub.content_texts(epub.read_entries(spark, out)).orderBy("ord").collect()]
    assert [t.split()[0] for t in texts] == ["第一章", "第二章", "第三章"] and "12" not in " ".join(texts)
    assert cli.main(["verify", out]) == 0
    marked = str(folder / "marked")
    cli.chapterize(spark, out, marked).collect()
    assert cli.verify(spark, marked).first().ok
    assert cli.scan(spark, out).count() == 0
    found = cli.scan_boundaries(spark, str(folder / "scan")).collect()
    assert [(r.pdf_page, r.score) for r in found] == [(1, 0.9)]
    assert cli.main(["boundaries", str(folder / "scan"), "--json", str(folder / "report")]) == 0
    assert spark.read.json(str(folder / "report")).count() == 1
    (folder / "named").mkdir()
    (folder / "named" / "scan.epub").write_bytes(next((folder / "books").glob("*.epub")).read_bytes())
    assert [r.status for r in cli.scan_boundaries(spark, str(folder / "scan"), books=str(folder / "named")).collect()] == ["joined"]


def test_rebuild_joins_pages_and_keeps_metadata(spark, tmp_path):
    page = lambda t: {"markdown": {"text": t, "images": {}}}
    texts = ["# 第一章 甲\n他在這一年裡寫下了許多沒有寫完的", "故事，後來終於寫完。\n\n新段。", "# 第二章 乙\n末句沒有寫完", "# 第三章 丙\n完。"]
    (tmp_path / "scan").mkdir()
    checkpoints.write_checkpoint(str(tmp_path / "scan" / "chunk_0_4.pdf.json"), {"result": {"layoutParsingResults": [page(t) for t in texts]}})
    cover = b"\x89PNG..."
    cli.rebuild(spark, str(tmp_path / "scan"), str(tmp_path / "out"), "書", author="某", language="ja", cover=cover).collect()
    entries = epub.read_entries(spark, str(tmp_path / "out"))
    files = {r.path: bytes(r.payload) for r in entries.collect()}
    assert files["EPUB/cover.png"] == cover and "<dc:creator>某</dc:creator><dc:language>ja</dc:language>".encode() in files["EPUB/content.opf"]
    first, second, third = (files[f"EPUB/chapter_00{k}.xhtml"].decode() for k in (1, 2, 3))
    assert "<p>他在這一年裡寫下了許多沒有寫完的 故事，後來終於寫完。</p><p>新段。</p>" in first
    assert "<p>末句沒有寫完</p>" in second and "<p>完。</p>" in third and 'class="toc-page-start"' in first
    bad = entries.withColumn("payload", F.when(F.col("path") == "EPUB/chapter_003.xhtml", F.concat("payload", F.lit("$ \\underset{\\cdot}{x} $").cast("binary"))).otherwise(F.col("payload")))
    with pytest.raises(RuntimeError, match="underset"):
        cli.publish(bad, str(tmp_path / "none"), strict=True)
    assert not (tmp_path / "none").exists()
    assert cli.main(["repair", str(tmp_path / "out"), str(tmp_path / "repaired")]) == 0 and cli.main(["verify", str(tmp_path / "repaired")]) == 0
    cli.chapterize(spark, str(tmp_path / "repaired"), str(tmp_path / "units")).collect()
    kept = {r.path: bytes(r.payload) for r in epub.read_entries(spark, str(tmp_path / "units")).collect()}
    assert kept["EPUB/cover.png"] == cover and b"<dc:language>ja</dc:language>" in kept["EPUB/content.opf"] and cli.main(["chapterize", str(tmp_path / "units"), "--verify-only"]) == 0


def test_verify_reports_issues(spark, folder):
    bad = folder / "bad"
    bad.mkdir()
    with zipfile.ZipFile(bad / "x.epub", "w") as z:
        z.writestr("a.xhtml", "x")
    assert cli.main(["verify", str(bad)]) == 1


def test_layout(spark):
    rows = [
        ("b", 1, 0, 10.0, 10.0, 0.0, 0.0, "Head", 792.0), ("b", 1, 1, 300.0, 100.0, 0.0, 0.0, "right\nside-\nways , x", 792.0), ("b", 1, 2, 10.0, 100.0, 0.0, 0.0, "left", 792.0), ("b", 1, 3, 10.0, 700.0, 0.0, 0.0, "7", 792.0),
        ("b", 300, 0, 300.0, 90.0, 0.0, 0.0, "second", 792.0), ("b", 300, 1, 10.0, 200.0, 0.0, 0.0, "first", 792.0), ("b", 300, 2, 10.0, 300.0, 0.0, 0.0, "  \n", 792.0),
    ]
    t = spark.createDataFrame(rows, "book string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, page_height double")
    got = [(r.page, r.ord, r.text) for r in layout.page_blocks(t, 300).orderBy("page", "ord").collect()]
    assert got == [(1, 1, "left"), (1, 2, "right sideways , x"), (300, 1, "first"), (300, 2, "second")]
    join = lambda x: spark.range(1).select(lines.join_pdf_lines(F.array(*map(F.lit, x))).alias("t")).first().t
    assert join(["a-", "b", ", c", "d–", "e"]) == "ab, c d– e" and join(["x"]) == "x"


def test_sections(spark):
    assert layout.parse_sections(["A: B:1-3"], 5) == [("A: B", 1, 3)]
    for bad in ("x", "x:1", "x:3-1", "x:1-9"):
        with pytest.raises(ValueError):
            layout.parse_sections([bad], 5)
    outline = spark.createDataFrame([("a", 1, 1, "one", 2), ("a", 2, 2, "sub", 3), ("a", 3, 1, "two", 5), ("a", 4, 1, "out", 99)], "book string, ord int, level int, title string, page int")
    books = spark.createDataFrame([("a", 9), ("b", 60)], "book string, page_count int")
    got = layout.default_sections(outline, books)
    assert sorted(map(tuple, got.collect())) == [("a", "one", 2, 4), ("a", "two", 5, 9), ("b", "Pages 1-50", 1, 50), ("b", "Pages 51-60", 51, 60)]
    pages = spark.createDataFrame([("a", 4), ("a", 5), ("a", 1)], "book string, page int")
    assert {(r.page, r.section) for r in layout.section_pages(pages, got).collect()} == {(4, "one"), (5, "two")}
    rest = layout.coverage(pages, spark.createDataFrame([("a", 5), ("a", 7)], "book string, page int"), "page").first()
    assert (list(rest.missing), list(rest.surplus)) == ([1, 4], [7])


def test_paragraphs_and_names(spark):
    t = spark.createDataFrame([("Figure 1 x", False, False), ("y" * 100, False, False), ("a<b", True, True)], "t string, f boolean, i boolean")
    got = [r.x for r in t.select(layout.paragraph_html(F.col("t"), F.col("f"), F.col("i")).alias("x")).collect()]
    assert got == ['<p class="noindent">Figure 1 x</p>', "<p>" + "y" * 100 + "</p>", '<p class="index-entry">a&lt;b</p>']
    v = spark.createDataFrame([(1, 1, 0, ""), (2, 1, 0, ""), (3, 0, 5, ""), (4, 0, 0, "Table 1.2"), (5, 0, 0, "table 1")], "page int, images int, drawings int, text string")
    assert [r.v for r in v.select(layout.is_visual(*map(F.col, v.columns)).alias("v")).collect()] == [False, True, True, True, False]
    assert spark.range(1).select(safe_file_name(F.lit("第一章: A b"), F.lit(2)).alias("n")).first().n == "第一章Ab_2.xhtml"


def test_rebuild_with_a_made_toc(spark, tmp_path):
    page = lambda t: {"markdown": {"text": t, "images": {}}}
    texts = ["〔第十三章〕\n尼克森及晚年\n正文開始。", "前文。\n尾聲\n後文。", "革命\n第一部\n末文。"]
    (tmp_path / "scan").mkdir()
    checkpoints.write_checkpoint(str(tmp_path / "scan" / "chunk_0_3.pdf.json"), {"result": {"layoutParsingResults": [page(t) for t in texts]}})
    marks = [
        {"title": "第十三章 尼克森和晚年歲月", "page": 1, "aliases": ["尼克森及晚年"]}, {"title": "結束", "page": 2, "match": "尾聲"},
        {"title": "第一部 革命", "page": 3, "page_start": True},
    ]
    checkpoints.write_checkpoint(str(tmp_path / "toc.json"), {"headings": marks})
    cli.rebuild(spark, str(tmp_path / "scan"), str(tmp_path / "out"), "書", str(tmp_path / "toc.json")).collect()
    got = [r.text for r in epub.content_texts(epub.read_entries(spark, str(tmp_path / "out"))).orderBy("ord").collect()]
    assert [t.split()[0] for t in got] == ["第十三章", "結束", "第一部"]
    assert "正文開始。" in got[0] and "前文。" in got[0] and "尼克森及晚年" not in got[0] and "後文。" in got[1] and "末文。" in got[2]
