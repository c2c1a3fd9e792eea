import io
import zipfile

from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.functions.convert import Matcher, convert_chars
from scriptloom.operators import epub, word
from scriptloom.operators import subtitles as s
from scriptloom.plans import batch, samples
from scriptloom.sources import encoding, files
from scriptloom.streaming import feed
from tests.test_convert import run

D = samples.dictionary("new_glyphs")


def conv(x):
    return convert_chars(x, D)


def test_srt(spark):
    text = "1\r\n00:00 --> 00:01\r\n奧{\\i奧}奧\r\n奧\r\n\r\n奧 after a blank line\n2\n00 --> 01\n奧\n33\n奧 after digits\n３\n00 --> 01\n奧"
    want = "1\n00:00 --> 00:01\n奥{\\i奧}奥\n奥\n\n奧 after a blank line\n2\n00 --> 01\n奥\n33\n奧 after digits\n３\n00 --> 01\n奥"
    assert run(spark, [text, None, "", "奧"], lambda x: s.convert_srt(x, conv)) == [want, None, "", "奧"]
    bom = "﻿1\n00 --> 01\n奧"
    assert run(spark, [bom], lambda x: s.convert_srt(x, conv)) == [bom]


def test_ass(spark):
    line = "Dialogue: 0,a,b,奧,,0,0,0,,奧,{\\b奧}奧{"
    text = f"Title: 奧\n[ events ]\n{line}\n[Events]\n{line}\n {line}\nComment: 奧,1\nComment: 1,2,3,4,5,6,7,8,9,奧\n[Fonts]\n{line}"
    done = "Dialogue: 0,a,b,奧,,0,0,0,,奥,{\\b奧}奥{"
    want = f"Title: 奧\n[ events ]\n{line}\n[Events]\n{done}\n {line}\nComment: 奧,1\nComment: 1,2,3,4,5,6,7,8,9,奥\n[Fonts]\n{line}"
    assert run(spark, [text], lambda x: s.convert_ass(x, conv)) == [want]


def test_lrc(spark):
    text = "[ti:奧]\n[xx:奧]\n  [AR:奧] \n[00:01.2][00:02]奧<1>奧 \n\n奧"
    want = "[ti:奥]\n[xx:奧]\n  [AR:奥]\n[00:01.2][00:02]奥<1>奥\n\n奧"
    assert run(spark, [text], lambda x: s.convert_lrc(x, conv)) == [want]


def test_epub():
    raw = queries.make_epub("奧<svg><text>奧</text>奧</svg>&amp;奧")
    new, problems = epub.convert_epub(raw, Matcher([D.first()]).convert)
    archive = zipfile.ZipFile(io.BytesIO(new))
    assert archive.namelist()[0] == "mimetype" and archive.infolist()[0].compress_type == zipfile.ZIP_STORED and not problems
    assert archive.read("o/c 1.xhtml").decode() == "<html><body><p>奥<svg><text>奥</text>奧</svg>&amp;奥</p><script>奧</script></body></html>"


def test_docx():
    m = Matcher([D.first()])
    new = zipfile.ZipFile(io.BytesIO(word.convert_docx(queries.make_docx(["奧", "x", "\U00024b6d顚"]), m))).read("word/document.xml").decode()
    assert "<w:t>奥</w:t>" in new and "<w:t>x</w:t>" in new and "<w:t>㚟‌顛</w:t>" in new
    assert word.convert_runs(["\U00024b6d"], m) == ["\U00024b6d"]
    assert word.convert_runs([" ", "奧", "b"], m, keep_format=False) == ["", " 奥b", ""]
    assert word.spread([("ab", "xyz"), ("c", "c")], [1, 3]) == ["xyz", "c"]


def test_encodings():
    text = "這是一個測試，繁體中文"
    for name in ("utf-8", "gb18030", "utf-8-sig", "utf-16"):
        assert encoding.decode(text.encode(name)).lstrip("﻿") == text
    assert encoding.detect("简体中文的文章".encode("gbk")) == "gb18030"
    assert encoding.decode(text.encode("cp950"), "cp950") == text
    assert encoding.decode(None) is None and encoding.decode(b"") == ""


def test_encodings_after_a_long_preface():
    preface = "plain words " * 400
    for text, name in (("這是一個測試，繁體中文的文章，我們在這裏說明", "cp950"), ("简体中文的文章，我们在这里说明", "gb18030")):
        assert encoding.detect((preface + text).encode(name)) == encoding.detect(text.encode(name)) == name
        assert encoding.decode((preface + text).encode(name)) == preface + text


def test_batch_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.TXT").write_text("奧", encoding="utf-8")
    (source / "b.epub").write_bytes(queries.make_epub("奧"))
    (source / "c.docx").write_bytes(b"broken")
    (source / "d.pdf").write_bytes(b"x")
    found = files.read_files(spark, str(source))
    assert files.read_folder(spark, str(source)).count() == 3
    done = batch.convert_files(found, [D]).cache()
    assert {r.output_name: r.status for r in done.collect()} == {"convert_a.TXT": "ok", "convert_b.epub": "ok", "convert_c.docx": "error", "convert_d.pdf": "skipped"}
    assert files.tally(done).asDict() == {"success": False, "message": "partial", "success_count": 2, "total_files": 4}
    files.write_files(done.filter("status = 'ok'"), str(tmp_path / "out")).collect()
    assert (tmp_path / "out/convert_a.TXT").read_text(encoding="utf-8") == "奥"
    names = spark.createDataFrame([("/a/x.txt",), ("/b/x.txt",), ("/b/y.txt",)], "path string")
    assert [r.paths for r in files.collisions(names).collect()] == [["/a/x.txt", "/b/x.txt"]]
    query = feed.convert_stream(spark, str(source), [D], str(tmp_path / "stream"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 4


def test_names(spark):
    rows = run(spark, ["/x/a.Epub", "/x/b", "/x/c.doc"], lambda x: F.concat_ws("|", files.route(x), files.output_name(x)))
    assert rows == ["epub|convert_a.Epub", "skipped|convert_b", "unsupported_doc|convert_c.doc"]


def test_text_around_a_text_box():
    """A paragraph inside another (a text box) is converted apart from what stands around it."""
    from scriptloom.functions.convert import Matcher
    from scriptloom.operators import word

    box = "<w:p><w:r><w:t>奧A</w:t></w:r><w:r><w:txbxContent><w:p><w:t>奧B</w:t></w:p><w:p/></w:txbxContent></w:r><w:r><w:t>奧</w:t><w:t/></w:r></w:p><w:p/><w:p><w:t>奧</w:t></w:p>"
    matcher = Matcher([{"奧": "奥", "A奧": "Z"}])
    done = word._by_paragraph(box, lambda t: word.convert_runs(t, matcher))
    assert done == box.replace("奧A", "奥Z").replace("奧B", "奥B").replace("<w:t>奧</w:t><w:t/>", "<w:t></w:t><w:t/>").replace("<w:t>奧</w:t>", "<w:t>奥</w:t>")
    assert word.convert_runs(["x", "乾"], matcher, keep_format=False) == ["x", "乾"]
    assert word.convert_runs([" ", "乾", "奧"], matcher, keep_format=False) == ["", " 乾奥", ""]


def test_manifests_without_documents():
    import io
    import zipfile

    from scriptloom.operators import epub

    def paths(item):
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as out:
            out.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
            out.writestr("p.opf", f"<package><manifest>{item}</manifest></package>")
            out.writestr("a.html", "x")
            out.writestr("b.XHTML", "x")
        return epub.document_paths(zipfile.ZipFile(sink))

    assert paths('<item href="x.css" media-type="text/css"/>') == ["a.html", "b.XHTML"]
    assert paths('<item href="a.html" media-type=" Text/HTML "/>') == ["a.html"]


def test_null_texts(spark, tmp_path):
    from scriptloom import queries

    spark.createDataFrame([(1, None, "en", "s"), (2, "the one", "en", "s"), (3, "", None, None)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("encodings", "epub_files", "docx_files", "hmm_states", "max_match_words", "convert_segments", "srt_cues", "ass_events", "lrc_lines", "txt_by_line"):
        assert len(queries.QUERIES[name](spark, str(tmp_path)).collect()) == 3, name
