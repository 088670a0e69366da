import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.functions import html as H
from quillstone.functions import text as T
from quillstone.operators import boundaries, constraints, footnotes, headings, images, lines, mapping, ngrams, noise, ordering, patching, toc
from quillstone.sources import checkpoints, epub


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def brute_reflow(text):
    import re

    special = re.compile(r"^(#{1,6}\s|>|\s*[-*]\s|[0-9]+\.)")
    chapter = re.compile(T.CHAPTER)
    out, cur, blank = [], "", 0
    for raw in text.split("\n"):
        line = raw.rstrip(" ")
        if not line:
            blank += 1
            continue
        if special.match(line) or (chapter.match(line) and len(line) <= 25):
            out += [cur] * bool(cur) + [line]
            cur = ""
        elif not cur:
            cur = line
        else:
            end = cur.rstrip(" ")
            terminal = end.endswith(T.TERMINAL)
            wrap = len(line) <= 30 and re.search("[㐀-鿿]$", end) and re.match("[㐀-鿿]", line.lstrip(" "))
            if blank >= 2:
                close = terminal
            elif blank == 1:
                close = not wrap and (terminal or (len(line) > 20 and line.endswith(T.TERMINAL) and not end.endswith("，")))
            else:
                close = terminal or end.endswith(T.NO_JOIN)
            if close:
                out.append(cur)
                cur = line
            else:
                cur = end + " " + line
        blank = 0
    return out + [cur] * bool(cur)


@pytest.mark.parametrize("text", [
    "", "one", "a\nb", "a.\nb", "a\n\nb", "中文\n\n接著", "# h\nbody\n\n\nmore", "x,\ny", "open\n\nThis is a longer sentence that ends.", "半句，\n\n這是一個比較長的句子一共要有超過二十個字的長度才行。", "第三章 題\n文", "- a\n- b\n\n\nc",
])
def test_reflow(spark, text):
    assert one(spark, lines.reflow, text) == brute_reflow(text)


def test_reflow_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", lines.reflow(F.col("text")).alias("p")).collect():
        assert r.p == brute_reflow(r.text)


def test_page_join(spark):
    p = spark.createDataFrame([("b", 1, ["Open tail"]), ("b", 2, []), ("b", 3, ["goes on.", "x"]), ("b", 4, ["new"])], "book string, page int, p array<string>")
    got = {(r.page, r.paragraph_no): r.continues for r in lines.join_pages(p, "book", "page", "p").collect()}
    assert got == {(1, 0): False, (3, 0): True, (3, 1): False, (4, 0): True}


def strip(spark, page, marks=()):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(page)], "doc_id int, line_no int, line string")
    m = spark.createDataFrame([(1, x) for x in marks], "doc_id int, fingerprint string")
    return [r.line for r in lines.strip_page_headers(t, m).orderBy("line_no").collect()]


def test_page_headers(spark):
    assert strip(spark, ["書 名", "12", "正文在此", "五"], ["書名"]) == ["", "", "正文在此", ""]
    assert strip(spark, ["第三章 開始", "第三章講述了中英談判的漫長過程，其中有許多細節值得在這裡說明", "x"]) == ["", "第三章講述了中英談判的漫長過程，其中有許多細節值得在這裡說明", "x"]
    assert strip(spark, ["正文", "「對話」", "正文"]) == ["正文", "「對話」", "正文"]
    assert strip(spark, ["「書名」", "正文", "  ", ""]) == ["", "正文", ""]
    assert strip(spark, ["12"]) == ["12"]


def test_segments(spark):
    text = "lead\n# 7\nHead\nbody\n# 8\n3\nmore\nHead"
    t = lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    h = lines.running_headers(t)
    assert {(r.line, r.kind) for r in h.collect()} == {("# 7", "h1"), ("# 8", "h1"), ("Head", "plain")}
    s = lines.trim_segments(lines.split_segments(t, h), h)
    assert {r.segment: r.text for r in s.collect()} == {0: "lead", 1: "body", 2: "more"}


def test_noise_keeps_real_markup(spark):
    keep = "a $ \\begin{array}{c} x \\end{array} $ b $ \\downarrow $ c"
    assert one(spark, noise.clean_ocr_noise, keep) == keep
    assert one(spark, noise.clean_ocr_noise, "x\r\n\r\n\r\n\r\ny $ \\underset{\\cdot}{字} $ ") == "x\n\ny 字"
    assert one(spark, noise.clean_ocr_noise, "20 $ \\frac{1}{2} $7年 甲 $ \\downarrow $ 乙") == "2017年 甲、乙"
    assert one(spark, noise.clean_ocr_noise, None) == ""


def test_captions(spark):
    clean = lambda t: one(spark, noise.clean_captions, t)
    assert clean("<details>\n<summary>photo</summary>\nx\n</details>正文") == "正文"
    assert clean("photography is fine") == "photography is fine"
    assert clean("natural_image: A long description of a man that stands in front of a house") == ""
    assert clean("他在一九九七年採用「一國兩制」的基本方針政\n\n國在香港既有的利益") == "他在一九九七年採用「一國兩制」的基本方針政國在香港既有的利益\n\n"
    assert one(spark, lambda t: noise.clean_alt_text(t, keep_image=False), "![photo](a.png)") == "[](a.png)"


def test_footnotes(spark):
    blocks = [("footnote", "1 note"), ("text", "x"), ("vision_footnote", "in page"), ("footnote", " ")]
    p = spark.createDataFrame([(1, "in  page $ ^{1} $", blocks)], "page int, text string, blocks array<struct<block_label:string,block_content:string>>")
    notes = footnotes.page_footnotes(p, ["page"], "blocks", "text")
    assert [r.note for r in notes.collect()] == ["1 note"]
    m = footnotes.inline_markers(p, ["page"], "text")
    n = footnotes.number_notes(notes, m, ["page"])
    assert footnotes.link_notes(n, m, ["page"]).first().note == "1 note"
    assert footnotes.notes_html(n, ["page"], "page").first().html == '<section class="footnotes"><p id="fn-p1-1"><a href="#fnref-p1-1">1</a> note</p></section>'


def test_headings_and_chapters(spark):
    lines_of = [("b", 1, 1, "x"), ("b", 1, 2, "甲"), ("b", 2, 1, "文"), ("b", 3, 1, "# 乙"), ("b", 3, 2, "文"), ("b", 4, 1, "乙")]
    t = spark.createDataFrame(lines_of, "book string, page int, line_no int, line string")
    c = spark.createDataFrame([("b", 1, "甲"), ("b", 3, "乙")], "book string, page int, title string")
    got = [(r.chapter_no, r.chapter_title) for r in headings.split_chapters(t, c).orderBy("page", "line_no").collect()]
    assert got == [(0, "Content"), (1, "甲"), (1, "甲"), (2, "乙"), (2, "乙"), (2, "乙")]
    assert {r.fingerprint for r in headings.header_fingerprints(c.withColumn("title", F.lit("第一章 開 始"))).collect()} == {"第一章開始", "第一章", "開始"}
    assert one(spark, headings.heading_key, "## 3 （第一章） 甲  乙") == "第一章 甲 乙"


def test_printed_numbers(spark):
    read = lambda t: one(spark, lambda c: ordering.printed_number(c, ("Page ([0-9]+)", "([0-9]+) of")), t)
    assert (read("x Page 7"), read("Page 900 8 of 9"), read("none"), read(None)) == (7, 8, None, None)


def test_patching():
    import re

    cls = re.compile("[㐀-鿿]")
    assert patching.diff_hunks("abc", "abc", cls) == []
    assert patching.diff_hunks("甲乙丙", "甲丁丙", cls) == [(1, 3, 1, 3)]
    tail = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"
    assert patching.patch_start(tail, "閏餘成歲律呂調陽雲騰致雨" + tail, cls) == ("閏餘成歲律呂調陽雲騰致雨" + tail, 1)
    assert patching.patch_start(tail, tail, cls) == (tail, 0)
    island = "宇宙洪荒日月盈昃"
    assert patching.diff_hunks("甲" + island + "丙", "乙" + island + "丁", cls) == [(0, 1, 0, 1), (9, 10, 9, 10)]
    assert patching.diff_hunks("甲" + island[:7] + "丙", "乙" + island[:7] + "丁", cls) == [(0, 9, 0, 9)]
    assert patching.diff_hunks("天地甲玄黃", "天地乙玄黃", cls) == [(2, 5, 2, 5)] and patching.diff_hunks("", "甲", cls) == [(0, 0, 0, 1)]


def test_best_stretch_is_that_of_all_pairs():
    import random
    from difflib import SequenceMatcher

    from quillstone.functions.align import best_stretch

    rng = random.Random(3)
    for _ in range(60):
        target, text = ("".join(rng.choice("abcde") for _ in range(n)) for n in (rng.randint(1, 9), rng.randint(1, 30)))
        pairs = [(SequenceMatcher(None, target, text[i : i + len(target)], autojunk=False).ratio(), -i) for i in range(max(1, len(text) - len(target) + 1))]
        ratio, _, at = best_stretch([target], text)
        assert (ratio, -at) == max(pairs)
    assert best_stretch([], "abc") is None and best_stretch(["abc"], "xyz", least=0.5) is None
    assert patching.parse_page_ranges("71, 75-77") == [71, 75, 76, 77]
    for bad in ("", "x", "5-3", "0"):
        with pytest.raises(ValueError):
            patching.parse_page_ranges(bad)
    assert patching.chunk_bounds(23, 10, 25) == (20, 25, 2)


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "page int, text string")
    assert sorted(patching.upsert_pages(a, spark.createDataFrame([(2, "z")], a.schema), ["page"]).collect()) == [(1, "x"), (2, "z")]


def test_boundary_scores(spark):
    pages = [(1, 1, "他認為"), (1, 2, "蔣介石走了。"), (1, 3, "另起"), (1, 5, "不相鄰"), (1, 6, "<img src='a'>圖後")]
    got = boundaries.score_boundaries(spark.createDataFrame(pages, "book int, page int, text string"), "book", "page")
    assert {r.page: (r.score, list(r.reasons)) for r in got.collect()} == {
        1: (0.90, ["open_tail_no_terminal", "open_tail_suffix", "rare_boundary_bigram", "new_sentence_like_head"]),
        5: (0.75, ["open_tail_no_terminal", "rare_boundary_bigram", "image_adjacent_boundary", "next_page_starts_with_image"]),
    }


def test_boundaries_of_several_books(spark):
    """Each book is measured by its own pairs: another one that has the pair of a seam often changes nothing."""
    a = [("a", 1, "甲乙"), ("a", 2, "丙丁。")]
    b = [("b", 1, "乙丙乙丙乙丙。"), ("b", 2, "乙"), ("b", 3, "丙。")]

    def scores(rows):
        pages = spark.createDataFrame(rows, "book string, page int, text string")
        from quillstone.operators import ngrams

        found = boundaries.score_boundaries(pages, "book", "page", "text", ngrams.bigram_model(pages, ["book"], order_col="page"))
        return {(r.book, r.page): r.score for r in found.collect()}

    alone, both = scores(a), scores(a + b)
    assert alone == {("a", 1): 0.55} and both == {("a", 1): 0.55, ("b", 2): 0.40}


def test_line_ends_stay(spark):
    clean = lambda t: one(spark, noise.clean_captions, t)
    assert clean("a\nb") == "a\nb" and clean("a\n\n\nb\n") == "a\n\n\nb\n" and clean("") == "" and clean(None) == ""
    assert clean("話！\n\n就在這時刻他說他要講幾句\n後") == "\n\n就在這時刻他說他要講幾句話！\n後"
    assert clean("話！\n就在這時刻他說他要講幾句") == "話！\n就在這時刻他說他要講幾句"  # the last two lines begin no pair
    assert clean("他在一九九七年採用「一國兩制」的基本方針政\n國在香港既有的利益\n\n後") == "他在一九九七年採用「一國兩制」的基本方針政國在香港既有的利益\n\n\n後"
    assert clean("前\nphoto\n後") == "前\n後"


def test_bad_bytes_are_left_out(spark):
    from quillstone.functions.text import utf8

    rows = [(1, bytearray("甲\ufffd乙".encode())), (2, bytearray("甲".encode() + b"\xff\xe4" + "乙".encode())), (3, None)]
    t = spark.createDataFrame(rows, "k int, payload binary").select("k", utf8(F.col("payload")).alias("t")).orderBy("k")
    assert [r.t for r in t.collect()] == ["甲\ufffd乙", "甲乙", None]


def test_continuity(spark):
    c = spark.createDataFrame([("甲乙", "丙丁"), ("甲乙", "戊"), ("x", "y"), ("己", "庚")], "a string, b string")
    got = [r.status for r in boundaries.continuity(c, "a", "b", "甲乙丙丁").collect()]
    assert got == ["joined", "tail_only", "unknown", "absent"]
    many = spark.createDataFrame([("x", "甲乙", "丙丁"), ("y", "甲乙", "丙丁"), ("z", "甲", "乙"), ("x", "己", "丙")], "book string, a string, b string")
    books = spark.createDataFrame([("x", "甲乙，丙丁"), ("y", "甲乙")], "book string, text string")
    got = {(r.book, r.a): r.status for r in boundaries.continuity_in_books(many, books, "book", "a", "b").collect()}
    assert got == {("x", "甲乙"): "joined", ("y", "甲乙"): "tail_only", ("z", "甲"): "unknown", ("x", "己"): "head_only"}


def test_mapping(spark):
    p = spark.createDataFrame([(1, "甲乙丙丁戊己庚"), (2, "甲乙丙丁戊己辛壬癸子丑")], "page int, text string")
    s = spark.createDataFrame([("a", "甲乙丙丁戊己"), ("b", "甲乙丙丁戊己x辛壬癸子丑寅"), ("c", "甲乙丙丁戊己庚")], "sid string, span string")
    got = {r.sid: r.page for r in mapping.spans_to_pages(s, p, "sid", "span", "page", "text").collect()}
    assert got == {"c": 1}


def test_images(spark):
    t = "![a](imgs/a.png) <div><img src=\"imgs/b.png\"></div> ![c](http://x/c.png)"
    assert one(spark, images.image_references, t) == ["imgs/a.png", "http://x/c.png", "imgs/b.png"]
    assert one(spark, lambda c: images.strip_images(c, F.array(F.lit("imgs/b.png"))), t) == "![a](imgs/a.png)  ![c](http://x/c.png)"
    assert one(spark, lambda c: images.rewrite_single(c, F.array(F.lit("imgs/z.png"))), "![](imgs/a.png)") == "![](imgs/z.png)"
    p = spark.createDataFrame([(1, t)], "page int, text string")
    a = spark.createDataFrame([("imgs/a.png",)], "path string")
    assert [r.path for r in images.missing_assets(p, a, ["page"], "text").collect()] == ["imgs/b.png"]


def test_html_functions(spark):
    assert one(spark, H.html_unescape, "&eacute;&#20013;") == "é中"
    assert one(spark, H.normalize_pdf_text, "ﬁ­n é") == "fin é"
    assert H.resolve_member("EPUB/nav.xhtml", "../x/a%20b.xhtml#c%20d") == ("x/a b.xhtml", "c d")
    assert H.resolve_member("EPUB/nav.xhtml", "mailto:x") == (None, None)


def test_models_and_common(spark):
    d = spark.createDataFrame([("a", 1, "甲乙x丙"), ("a", 2, ""), ("a", 3, "丁")], "b string, o int, text string")
    got = {r.bigram: r.n for r in ngrams.bigram_model(d, ["b"], order_col="o").collect()}
    assert got == {"甲乙": 1, "乙丙": 1, "丙丁": 1}
    assert ngrams.common_chars(ngrams.char_model(d, ["b"]), ["b"], 2).count() == 2


def test_suspicious_spans(spark):
    good = "天地玄黃宇宙洪荒。" * 30
    d = spark.createDataFrame([("b", 1, good + "居之者忽音但一通乃祔筆八。" + good)], "book string, doc_id int, text string")
    found = ngrams.suspicious_spans(d, ["book"]).collect()
    assert [r.excerpt for r in found] == ["居之者忽音但一通乃祔筆八。"] and found[0].score >= 0.7


def test_checkpoints(spark, tmp_path):
    for start, end, texts in ((0, 2, ["a", "b"]), (10, 12, ["d"]), (2, 10, ["c"])):
        checkpoints.write_checkpoint(str(tmp_path / f"chunk_{start}_{end}.pdf.json"), {"result": {"layoutParsingResults": [{"markdown": {"text": t}} for t in texts]}})
    (tmp_path / "other.json").write_text("{}")
    got = [(r.text, r.pdf_page, r.seq_page) for r in checkpoints.read_checkpoints(spark, str(tmp_path)).orderBy("seq_page").collect()]
    assert got == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 11, 4)]


def test_json_lines_and_toc(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in checkpoints.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    rows = [{"title": "甲", "page": 3, "match": "乙"}, {"title": "丙", "page": 5, "at": "page_start"}]
    for name, value in (("list", rows), ("object", {"headings": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        got = checkpoints.read_toc(spark, str(tmp_path / f"{name}.json")).orderBy("ord").collect()
        assert [(r.title, r.source, r.page_start) for r in got] == [("甲", ["甲", "乙"], False), ("丙", ["丙"], True)]


def test_books(spark, tmp_path):
    rows = [("one.epub", k, p, c, bytearray(d), True) for k, p, c, d in epub.build_book("書", [("第一章 甲", "<p>文</p>"), ("第二章 乙", "<p>文</p>")])][::-1]
    written = epub.write_books(spark.createDataFrame(rows, epub.ENTRY), str(tmp_path / "out")).collect()
    assert len(written) == 1 and zipfile.ZipFile(written[0].path).infolist()[0].filename == "mimetype"
    (tmp_path / "out" / "bad.epub").write_bytes(b"no archive")
    entries = epub.read_entries(spark, str(tmp_path / "out"))
    good = entries.filter(F.col("book").endswith("one.epub"))
    assert good.filter("path = 'mimetype'").first().compress_type == 0
    issues = constraints.package_issues(entries)
    assert {r.book.rsplit("/", 1)[1] for r in issues.collect()} == {"bad.epub"}
    assert constraints.structure_issues(epub.structure(good), good, epub.text_elements(good)).count() == 0
    assert [r.text for r in epub.content_texts(good).orderBy("ord").collect()] == ["第一章 甲 第一章 甲 文", "第二章 乙 第二章 乙 文"]
    ok = {r.book.rsplit("/", 1)[1]: r.ok for r in constraints.report(issues, entries).collect()}
    assert ok == {"one.epub": True, "bad.epub": False}


def test_toc(spark):
    e = spark.createDataFrame(
        [("b", "x", i, 0, 0, t, s, d, None) for i, (t, s, d) in enumerate([("p", "第一章", None), ("p", "開頭", "frag"), ("h1", "第二章", "two"), ("p", "乙", None)])], epub.ELEMENTS
    )
    links = [("b", 1, "第一章 甲", "x", "frag"), ("b", 2, "第二章 乙", "x", "two"), ("b", 3, "第三章", "x", "frag"), ("b", 4, "第四章", "x", "none")]
    got = toc.retarget(spark.createDataFrame(links, "book string, link_no int, label string, path string, fragment string"), e).orderBy("link_no").collect()
    assert [(r.action, r.elem_no, r.fragment) for r in got] == [("look_back", 0, None), ("keep", 2, "two"), ("insert", 1, "frag-chapter"), ("missing", None, "none")]
    nxt = [("b", "y", 0, 0, 0, "h1", "第二章", None, None), ("b", "y", 1, 0, 0, "p", "乙 文", None, None)]
    spine = spark.createDataFrame([("b", "x", 1), ("b", "y", 2)], "book string, path string, spine_no int")
    assert toc.trailing_previews(e.union(spark.createDataFrame(nxt, epub.ELEMENTS)), spine).first().first_elem == 2


def test_reviewer(spark):
    from quillstone.operators import review

    calls = []
    answers = iter([None, {"error": "HTTP error: 503"}, {"is_garbled": True, "confidence": 0.5}])
    assert review.ask(lambda c: next(answers), {}, sleep=calls.append) == ({"is_garbled": True, "confidence": 0.5}, None) and calls == [1, 2]
    assert review.ask(lambda c: {"error": "invalid JSON: x"}, {}, sleep=calls.append) == (None, "invalid JSON: x")
    calls.clear()
    assert review.ask(lambda c: None, {}, sleep=calls.append) == (None, "no response") and calls == [1, 2, 4, 8, 8, 8, 8]
    assert review.parse_answer('```json\n{"a": 1}\n```') == {"a": 1} and "error" in review.parse_answer("no")
    c = spark.createDataFrame([("good",), ("bad",)], "excerpt string")
    client = lambda r: {"is_garbled": True} if r["excerpt"] == "good" else {"error": "unexpected response shape"}
    got = {r.excerpt: (r.review and r.review.is_garbled, r.error) for r in review.review(c, client).collect()}
    assert got == {"good": (True, None), "bad": (None, "unexpected response shape")}
    with pytest.raises(Exception, match="review failed"):
        review.review(c, client, strict=True).collect()


def test_recognition_backend():
    from quillstone.operators import review

    class Fake:
        def __init__(self, states, failures=0):
            self.states, self.failures = iter(states), failures

        def submit(self, chunk):
            return "job"

        def poll(self, job):
            return next(self.states)

        def fetch(self, place):
            self.failures -= 1
            if self.failures >= 0:
                raise OSError("reset")
            return {"place": place}

    quiet = lambda s: None
    assert review.wait_for(Fake([("running", None), ("done", "x")], 2), b"", sleep=quiet) == {"place": "x"}
    with pytest.raises(RuntimeError):
        review.wait_for(Fake([("failed", None)]), b"", sleep=quiet)
    with pytest.raises(RuntimeError):
        review.wait_for(Fake([("done", "x")], 9), b"", sleep=quiet)
    clock = iter(range(0, 9000, 1000))
    with pytest.raises(TimeoutError):
        review.wait_for(Fake([("running", None)] * 9), b"", sleep=quiet, clock=lambda: next(clock))


def test_rewriting():
    from quillstone.operators import rewrite

    text = '<p id="a-start">x</p><h2 class="t" name="b">y</h2>'
    assert rewrite.unique_id(text, "a", "start") == "a-start-2" and rewrite.unique_id(text, "c", "start") == "c-start"
    assert rewrite.add_id("<p>x</p>", 0, "n") == '<p id="n">x</p>'
    marked = rewrite.page_starts(text, ["b", "a-start"])
    assert marked == '<p id="a-start" class="toc-page-start">x</p><h2 class="t toc-page-start" name="b">y</h2>'
    assert rewrite.page_starts(marked, []) == text and rewrite.page_starts(marked, ["b", "a-start"]) == marked
    assert rewrite.page_starts(marked, ["b"]) == '<p id="a-start">x</p><h2 class="t toc-page-start" name="b">y</h2>'
    assert rewrite.styled(rewrite.styled("p {}")) == rewrite.styled("p {}") and "p {}" in rewrite.styled("p {}")
    assert rewrite.relocate('<img src="../i/a.png"/><a href="#x"/><a href="http://h/"/>', "E/t/c.xhtml", "E") == '<img src="i/a.png"/><a href="#x"/><a href="http://h/"/>'
    assert rewrite.insert_marker("<p>x</p>", 0, "h2", "n", "第一章") == '<h2 id="n">第一章</h2><p>x</p>'
    assert rewrite.replace_fragment("a.xhtml#x", "y") == "a.xhtml#y"


def test_chapterize_and_page_starts(spark):
    from quillstone.operators import rewrite

    rows = [("b", k, p, c, bytearray(d), True) for k, p, c, d in epub.build_book("書", [("第一章 甲", "<p>前</p>"), ("附", "<p>後</p>"), ("第二章 乙", "<p>末</p>")])]
    e = spark.createDataFrame(rows, epub.ENTRY)
    s = epub.structure(e)
    spine = s.filter("kind = 'spine'").select("book", F.col("member").alias("path"), F.col("ord").alias("spine_no"))
    marks = toc.reading_boundaries(s.filter("kind = 'nav'"))
    children = epub.body_children(e)
    assert toc.boundary_errors(children, marks).count() == 0
    picture = spark.createDataFrame([("b", 90, "EPUB/i/a.png", 0, bytearray(b"png"), True), ("b", 91, "EPUB/style/x.css", 8, bytearray(b"p {}"), True)], epub.ENTRY)
    e = e.union(picture)
    new = rewrite.chapterize(toc.reading_segments(children, marks, spine), marks, e)
    files = {r.path: bytes(r.payload) for r in new.collect()}
    assert files["EPUB/i/a.png"] == b"png" and files["EPUB/style/x.css"] == b"p {}" and "EPUB/chapter_001.xhtml" not in files
    assert "書".encode() in files["EPUB/content.opf"] and b"reading_002.xhtml" in files["EPUB/content.opf"] and "<title>書</title>".encode() in files["EPUB/nav.xhtml"]
    made = epub.structure(new)
    assert constraints.structure_issues(made, new, epub.text_elements(new)).count() == 0
    assert constraints.reading_issues(made, epub.text_elements(new)).count() == 0
    assert [r.text for r in epub.content_texts(new).orderBy("ord").select("text").collect()] == ["第一章 甲 第一章 甲 前 附 後", "第二章 乙 第二章 乙 末"]
    assert {r.detail for r in constraints.reading_issues(s, epub.text_elements(e), unwanted=("附",)).collect()} == {"nav: 附", "ncx: 附", "EPUB/chapter_002.xhtml: 附"}
    started = rewrite.start_pages(e, s).filter("path = 'EPUB/chapter_001.xhtml'").first().payload.decode()
    assert 'class="toc-page-start"' in started


def test_suspicious_headings(spark):
    e = spark.createDataFrame([("b", "x", 0, 0, 0, "h1", "第一章 這是一個很長的標題沒有問題。", None, None), ("b", "x", 1, 0, 0, "h2", "這是一個被誤認為標題的句子。", None, None), ("b", "x", 2, 0, 0, "h2", "居之者忽音但一通乃祔筆八", None, None)], epub.ELEMENTS)
    spans = spark.createDataFrame([("b", "x", "甲居之者忽音但一通乙")], "book string, path string, span string")
    got = {r.elem_no: r.reason for r in constraints.suspicious_headings(e, spans).collect()}
    assert got == {1: "ends like a sentence", 2: "overlaps a corrupted span"}


def test_context(spark):
    t = spark.createDataFrame([("abcXYdef", "XY"), ("abc", "zz")], "text string, excerpt string")
    got = [(r.context_before, r.context_after) for r in ngrams.with_context(t, "text", "excerpt", 2, 2).collect()]
    assert got == [("bc", "de"), (None, None)]


def test_rebuild(spark):
    from quillstone.operators import rewrite

    p = spark.createDataFrame([("b", 1, "第二章", 2, "y"), ("b", 0, "第一章", 1, "x<"), ("b", 1, "第二章", 3, "z")], "book string, chapter_no int, chapter_title string, ord int, paragraph string")
    assert [r.text for r in epub.content_texts(rewrite.rebuild(p, "書")).orderBy("ord").collect()] == ["第一章 第一章 x<", "第二章 第二章 y z"]


def test_heading_cleanup(spark):
    def elements(rows):
        return spark.createDataFrame([("b", "x", i, 0, 0, t, s, d, None) for i, (t, s, d) in enumerate(rows)], epub.ELEMENTS)

    e = elements([("h1", "扙艶", None), ("p", "第一章", None), ("p", "開始", None)])
    assert [(r.elem_no, r.label) for r in toc.known_headings(e, ("扙艶",)).collect()] == [(0, "第一章 開始")]
    assert toc.known_headings(elements([("h1", "扙艶", None), ("p", "第一章", None), ("p", "第二章", None)]), ("扙艶",)).first().label == "第一章"
    assert toc.known_headings(elements([("h1", "好", None), ("p", "第一章", None)]), ("扙艶",)).count() == 0
    stale = [("p", "註", "fn-p1-1"), ("h2", "第一章 舊題", None), ("p", "第二章", None), ("h2", "第二章 新題", None)]
    assert [r.elem_no for r in toc.stale_bibliography_titles(elements(stale)).collect()] == [1]
    assert toc.stale_bibliography_titles(elements(stale[1:])).count() == 0
    parts = [("p", "第一章", None), ("h1", "第一編", "part"), ("p", "總論", None), ("p", "題", "id"), ("p", "x", None)]
    t = spark.createDataFrame([("b", "x", 1)], "book string, path string, elem_no int")
    assert [(r.elem_no, r.last_elem) for r in toc.part_moves(elements(parts), t).collect()] == [(1, 2)]


def test_semantic_windows(spark):
    good = "天地玄黃宇宙洪荒。" * 30
    d = spark.createDataFrame([("b", 1, good + "居之者忽音但一通乃祔筆八甲乙丙丁戊己庚辛壬癸。" + good)], "book string, doc_id int, text string")
    found = ngrams.semantic_windows(d, ["book"]).collect()
    assert found and all(any(c in r.excerpt for c in "居之者忽甲乙丙丁") for r in found)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)


def test_chapters_of_a_made_toc(spark, tmp_path):
    toc_rows = [
        {"title": "第十三章 尼克森和晚年歲月", "page": 1, "aliases": ["尼克森及晚年"]}, {"title": "第二章 結束", "page": 2, "match": "尾聲"},
        {"title": "第一部 革命", "page": 4, "page_start": True}, {"title": "空頁", "page": 6, "at": "page_start"},
    ]
    (tmp_path / "toc.json").write_text(json.dumps(toc_rows))
    c = checkpoints.read_toc(spark, str(tmp_path / "toc.json")).withColumn("book", F.lit("b"))
    rows = [("b", 1, 1, "〔第十三章〕"), ("b", 1, 2, "尼克森及晚年"), ("b", 2, 1, "文"), ("b", 2, 2, "尾聲"), ("b", 4, 1, "革命"), ("b", 4, 2, "第一部"), ("b", 7, 1, "文")]
    t = spark.createDataFrame(rows, "book string, page int, line_no int, line string")
    got = [(r.chapter_no, r.chapter_title, r.heading) for r in headings.split_chapters(t, c).orderBy("page", "line_no").collect()]
    one_, two, three = "第十三章 尼克森和晚年歲月", "第二章 結束", "第一部 革命"
    assert got == [(1, one_, True), (1, one_, False), (1, one_, False), (2, two, True), (3, three, False), (3, three, False), (4, "空頁", False)]
    s = spark.createDataFrame([("b", 1, 1, "# 其他"), ("b", 1, 2, "## 第一章 甲"), ("b", 2, 1, "文")], t.schema)
    assert [(r.chapter_no, r.chapter_title) for r in headings.split_chapters(s, None).orderBy("page", "line_no").collect()] == [(0, "Content"), (1, "第一章 甲"), (1, "第一章 甲")]


def test_semantic_windows_cut_the_text(spark):
    good = "天地玄黃，宇宙洪荒。" * 30
    text = good + "居之者，忽音<b>但一</b>通乃祔 筆八甲乙丙丁戊己。庚辛壬癸子丑寅卯辰巳午未。" + good + "申酉戌亥東南西北春夏譯者秋冬金木水火"
    found = ngrams.semantic_windows(spark.createDataFrame([("b", 1, text)], "book string, doc_id int, text string"), ["book"], limit=None).collect()
    assert any(r.llm_excerpt != r.excerpt for r in found) and any("<b>" in r.llm_excerpt for r in found)
    for r in found:
        assert "".join(c for c in r.llm_excerpt if "㐀" <= c <= "鿿") == r.excerpt and "譯者" not in r.excerpt
        at = text.index(r.llm_excerpt)
        assert r.context_before == text[max(0, at - 120) : at].strip() and r.context_after == text[at + len(r.llm_excerpt) :][:120].strip()


def test_toc_repairs(spark):
    """Links that point past, before, or nowhere; ids that are taken; a part behind its first chapter's marker; a preview at an end."""
    from quillstone.operators import repair

    page = lambda body: f"<html><head><title>t</title></head><body>{body}</body></html>"
    nav = [("第一章 甲", "a.xhtml#t1"), ("第二章 乙", "a.xhtml#t2"), ("第三章 丙", "a.xhtml#t3"), ("第四章 丁", "b.xhtml"), ("第二編 戊", "b.xhtml#p"), ("附錄", "b.xhtml#x"), ("第九節", "a.xhtml#t3")]
    members = {
        "EPUB/a.xhtml": page('<h1 id="t1">第一章 甲</h1><p id="t2-start">x</p><h2>第二章</h2><p id="t2">乙</p><h3 id="t3">丙</h3><p>文</p><p>第四章</p>'),
        "EPUB/b.xhtml": page('<h2>第四章</h2><p>丁</p><p>文</p><p>第五章</p><h1 id="p">第二編 戊</h1><p>引</p><p id="x">己</p>'),
        "EPUB/nav.xhtml": page("<nav><ol>" + "".join(f'<li><a href="{h}">{t}</a></li>' for t, h in nav) + "</ol></nav>"),
        "EPUB/toc.ncx": "<ncx><navMap>" + "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{h}"/></navPoint>' for t, h in nav) + "</navMap></ncx>",
        "EPUB/content.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="EPUB/content.opf"/></rootfiles></container>',
    }
    rows = [(b, k, p, 8, bytearray(d.encode()), True) for b in ("x", "y") for k, (p, d) in enumerate(members.items())]
    got = {(r.book, r.path): bytes(r.payload).decode() for r in repair.repair_toc(spark.createDataFrame(rows, epub.ENTRY)).collect()}
    assert len(got) == len(rows)
    for b in ("x", "y"):
        assert got[b, "EPUB/a.xhtml"] == page(
            '<h1 id="t1">第一章 甲</h1><p id="t2-start">x</p><h2 id="t2-start-2">第二章</h2><p id="t2">乙</p><h3 id="t3-chapter">第三章</h3><h3 id="t3">丙</h3><p>文</p>'
        )
        assert got[b, "EPUB/b.xhtml"] == page('<h2 id="toc-auto-start">第四章</h2><p>丁</p><p>文</p><h1 id="p">第二編 戊</h1><p>引</p><p>第五章</p><p id="x">己</p>')
        hrefs = ["a.xhtml#t1", "a.xhtml#t2-start-2", "a.xhtml#t3-chapter", "b.xhtml#toc-auto-start", "b.xhtml#p", "b.xhtml#x", "a.xhtml#t3"]
        import re

        assert re.findall('href="([^"]*)"', got[b, "EPUB/nav.xhtml"]) == hrefs == re.findall('src="([^"]*)"', got[b, "EPUB/toc.ncx"])
        assert got[b, "EPUB/content.opf"] == members["EPUB/content.opf"]


def test_result_archives(spark, tmp_path):
    from quillstone.sources import results

    body = lambda x: (x + "正文的一行文字，" * 12)[:95]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("full.md", f"# 書名\n{body('甲')}\n# 書名\n12\n# 書名\n{body('乙')}\nphoto\n")
        z.writestr("b.md", body("丙"))
        z.writestr("c.md", "short")
        z.writestr("images/x.PNG", b"png")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = results.pages(results.read_archives(spark, str(tmp_path))).orderBy("page_no").collect()
    assert [r.text for r in got] == [body("丙"), body("甲"), body("乙")] and [r.page_no for r in got] == [0, 1, 2]
    assert all(r.images == {"images/x.PNG": "data:image/png;base64,cG5n"} and r.book.endswith("a.zip") for r in got)


def test_heading_edits(spark):
    from quillstone.operators import repair

    pages = {"a.xhtml": '<body><h2 class="x">壞字</h2><p>第三章</p><p>題 &amp; 目</p></body>', "b.xhtml": '<body><p id="fn-1">註</p><h2>第二章 舊</h2><p>第三章</p><p>文</p></body>'}
    e = spark.createDataFrame([("k", i, p, 8, bytearray(d.encode()), True) for i, (p, d) in enumerate(pages.items())], epub.ENTRY)
    got = {r.path: bytes(r.payload).decode() for r in repair.apply_edits(e, repair.heading_edits(e, ("壞字",))).collect()}
    assert got["a.xhtml"] == '<body><h2 class="x">第三章 題 &amp; 目</h2><p>第三章</p><p>題 &amp; 目</p></body>'
    assert got["b.xhtml"] == '<body><p id="fn-1">註</p><p>第三章</p><p>文</p></body>'
