"""Dictionaries of real size: the trie, segmenters in batches, and what is built on them."""

import io
import itertools
import math
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.functions import convert as c
from scriptloom.functions import segment, trie
from scriptloom.functions.convert import Matcher
from scriptloom.functions.dictionary import Dictionary
from scriptloom.operators import epub, subtitles, word
from scriptloom.plans import samples
from tests.test_convert import run

ODD = "abcd中\U0001f642"


def some_text(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def test_trie_equals_the_matcher():
    rng = random.Random(1)
    for _ in range(300):
        tables = [{some_text(rng, ODD, 3) + rng.choice(ODD): some_text(rng, "xyz\U00020000", 2) + "x" for _ in range(rng.randint(0, 12))} for _ in range(rng.randint(1, 3))]
        texts = [some_text(rng, ODD + "e", 30) for _ in range(rng.randint(1, 8))]
        matcher, converter = Matcher(tables), trie.Converter(tables)
        assert converter(texts) == [matcher.convert(t) for t in texts]
        assert [converter.tokens(t) for t in texts] == [list(matcher.tokens(t)) for t in texts]
        new, uneven = converter.with_lengths(texts)
        assert uneven.tolist() == [any(len(a) != len(b) for a, b in matcher.tokens(t)) for t in texts]
        words = set(tables[0])
        batch = trie.Batch(texts)
        trie.MaxMatch(words).cut(batch)
        assert batch.words() == [[a for a, _ in Matcher([{w: w for w in words}]).tokens(t)] for t in texts]
        assert batch.counts().tolist() == [len(x) for x in batch.words()] and "".join(map("".join, batch.words())) == "".join(texts)


def test_union_keeps_the_meaning_of_a_chain():
    assert trie.union([{"a": "1", "bc": "2"}, {"ab": "3", "b": "4", "bcd": "5", "a": "6"}]) == {"a": "1", "bc": "2", "b": "4"}
    assert trie.union([]) == {} and trie.Converter([])(["x", ""]) == ["x", ""]


def test_passes_do_not_change_results(monkeypatch):
    rng = random.Random(4)
    texts = [some_text(rng, "abc", 9) for _ in range(50)]
    converter = trie.Converter([{"ab": "X", "bca": "YYY", "c": "zz"}])
    want = converter(texts)
    monkeypatch.setattr(trie, "PASS_CHARS", 4)
    assert converter(texts) == want and len(list(trie.passes(texts))) > 20 and list(trie.passes([])) == []


def paths(text, words):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if n == 1 or text[:n] in words:
            yield from ([text[:n], *rest] for rest in paths(text[n:], words))


def test_graph_cut_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        frequency = {some_text(rng, "abc", 3) + rng.choice("abc"): rng.choice([0, 1, 5, 100, rng.randint(1, 999)]) for _ in range(rng.randint(0, 15))}
        texts = [some_text(rng, "abcd", 9) for _ in range(4)]
        total = math.log(max(1, sum(frequency.values())))
        chance = lambda path: sum(math.log(frequency.get(w, 0) or 1) - total for w in path)  # noqa: B023, E731
        batch = trie.Batch(texts)
        segment.GraphCut(frequency).cut(batch)
        for text, found in zip(texts, batch.words(), strict=True):
            assert "".join(found) == text and found in list(paths(text, frequency)) and abs(chance(found) - max(map(chance, paths(text, frequency)))) < 1e-9


def some_model(rng, letters):
    emit = {s: {x: -rng.random() * 9 for x in letters if rng.random() < 0.8} for s in segment.STATES}
    trans = {"B": {"E": -0.5, "M": -0.9}, "E": {"B": -0.6, "S": -0.8}, "M": {"E": -0.33, "M": -1.26}, "S": {"B": -0.7, "S": -0.67}}
    return segment.HiddenMarkov({"B": -0.3, "E": segment.LOWEST, "M": segment.LOWEST, "S": -1.4}, trans, emit)


def test_viterbi_in_step_equals_one_by_one():
    rng = random.Random(3)
    model = some_model(rng, "abcdef")
    texts = [some_text(rng, "abcdefx", 40) + "a" for _ in range(200)]
    batch, sizes = trie.Batch(texts), np.array([len(t) for t in texts])
    found = np.zeros(len(batch.codes), bool)
    segment.Viterbi(model).breaks(batch.codes, batch.ends - sizes, batch.ends, found)
    batch.breaks = found
    assert batch.words() == [model.cut(t) for t in texts] and [model.count(t) for t in texts] == [len(x) for x in batch.words()]


def test_runs_of_unknown_characters():
    """Passing over them gives what decoding them one by one gives."""

    def plain(text):
        low = segment.LOWEST
        now = {s: model.start[s] + model.emit[s].get(text[0], low) for s in segment.STATES}
        back = []
        for x in text[1:]:
            came, new = {}, {}
            for s in segment.STATES:
                one, two = segment.BEFORE[s]
                a, b = now[one] + model.trans[one].get(s, low), now[two] + model.trans[two].get(s, low)
                came[s], new[s] = (two, b) if b > a else (one, a)
                new[s] += model.emit[s].get(x, low)
            now = new
            back.append(came)
        out = ["S" if now["S"] > now["E"] else "E"]
        for came in reversed(back):
            out.append(came[out[-1]])
        return "".join(reversed(out))

    rng = random.Random(5)
    model = some_model(rng, "ab")
    for _ in range(1500):
        text = "".join(rng.choice("abx" if rng.random() < 0.3 else "xyz") for _ in range(rng.randint(1, 60)))
        assert model.states(text) == plain(text)


def test_singles_go_to_the_model():
    model = segment.HiddenMarkov.parse(["0 -100 -100 0", "-100 0 -100 -100", "-100 -100 -100 0", "0 0 0 0", "0 -100 -100 0", "甲:-1,丙:-1", "乙:-1,丁:-1", "己:-1", "戊:-1"])
    cut = segment.GraphCut({"子丑": 100, "寅": 3}, model)
    texts = ["甲乙子丑丙丁", "甲", "", "子丑甲乙", "乙甲乙"]
    batch = trie.Batch(texts)
    cut.cut(batch)
    assert batch.words()[:4] == [["甲乙", "子丑", "丙丁"], ["甲"], [], ["子丑", "甲乙"]] and cut("甲乙子丑丙丁") == batch.words()[0]


@pytest.fixture(scope="module")
def large():
    rng = random.Random(6)
    words = list({"".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.choice([2, 2, 2, 3, 3, 4]))) for _ in range(350_000)})
    texts = ["".join(rng.choice(words) if rng.random() < 0.6 else chr(0x4E00 + rng.randrange(3000)) for _ in range(300)) for _ in range(300)]
    return words, texts


def test_350_000_words(large):
    """Built in seconds, equal to the matcher, and not slower for their number."""
    words, texts = large
    start = time.perf_counter()
    cut, graph = trie.MaxMatch(words), segment.GraphCut({w: n + 1 for n, w in enumerate(words)})
    assert time.perf_counter() - start < 20  # about two seconds; the limit is for slow machines
    batch = trie.Batch(texts[:20])
    cut.cut(batch)
    matcher = Matcher([{w: w for w in words}])
    assert batch.words() == [[a for a, _ in matcher.tokens(t)] for t in texts[:20]]
    start = time.perf_counter()
    for part in trie.passes(texts):
        for cutter in (cut, graph):
            cutter.cut(trie.Batch(part))
    assert time.perf_counter() - start < 20  # about a tenth of a second


def test_both_engines_at_real_size(spark, monkeypatch):
    phrases, chars = samples.many_phrases(), samples.many_characters()
    rng = random.Random(7)
    keys = [*phrases.entries, *chars.entries]
    texts = ["".join(rng.choice(keys) if rng.random() < 0.8 else rng.choice("ax々") for _ in range(60)) for _ in range(40)] + ["", None]
    want = [Matcher([phrases.first(), chars.first()]).convert(t) for t in texts]
    assert len(phrases.entries) > 500 and len(chars.entries) == 3600
    for limit in (0, 100_000):  # both sides of the switch
        monkeypatch.setattr(c, "EXPRESSION_PHRASES", limit)
        assert run(spark, texts, lambda x: c.convert_chain(x, [phrases, chars])) == want
        assert run(spark, texts, lambda x: c.Conversion([phrases, chars])(x)) == want
        assert run(spark, texts, lambda x: c.convert_chars(x, chars)) == [Matcher([chars.first()]).convert(t) for t in texts]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_formats_with_many_phrases(spark, monkeypatch, limit):
    """Subtitles and lyrics hand their parts over at once; results equal those of small dictionaries."""
    monkeypatch.setattr(c, "EXPRESSION_PHRASES", limit)
    conversion = c.Conversion([Dictionary("d", {"奧x": ("Ω!",), "奧": ("奥",)})], normalize=True)
    assert conversion.many == (limit == 0)
    srt = "1\n00:00 --> 00:01\n奧{\\i奧}奧x\n奧\n\n奧\n2\n00 --> 01\n豈"
    assert run(spark, [srt, None, ""], lambda x: subtitles.convert_srt(x, conversion)) == ["1\n00:00 --> 00:01\n奥{\\i奧}Ω!\n奥\n\n奧\n2\n00 --> 01\n豈", None, ""]
    ass = "[Events]\nDialogue: 0,a,b,奧,,0,0,0,,奧,{\\b奧}奧{\n[Fonts]\n奧"
    assert run(spark, [ass], lambda x: subtitles.convert_ass(x, conversion)) == [ass.replace("0,,奧,{\\b奧}奧{", "0,,奥,{\\b奧}奥{")]
    assert run(spark, ["[ti:奧]\n[00:01.2]奧<1>奧x", None], lambda x: subtitles.convert_lrc(x, conversion)) == ["[ti:奥]\n[00:01.2]奥<1>Ω!", None]
    assert run(spark, ["奧\nx奧x"], lambda x: subtitles.convert_txt_by_line(x, conversion)) == ["奥\nxΩ!"]


def test_patterns_take_the_longest_key(spark):
    rng = random.Random(8)
    for _ in range(4):
        table = {some_text(rng, "ab中", 3) + rng.choice("ab中"): some_text(rng, "xy", 2) + "z" for _ in range(14)}
        texts = [some_text(rng, "ab中c", 20) for _ in range(60)]
        assert run(spark, texts, lambda x: c.convert_chain(x, [Dictionary("d", {k: (v,) for k, v in table.items()})])) == [Matcher([table]).convert(t) for t in texts]


def test_docx_paragraphs_together():
    """Runs by slices where lengths are equal, dealt out where not: as the matcher alone does."""
    rng = random.Random(9)
    table = {"奧": "奥", "乾淨": "干净", "瞭解x": "了", "龍": "龙龙"}
    paragraphs = [[some_text(rng, "奧乾淨瞭解x龍 a", 5) for _ in range(rng.randint(1, 6))] for _ in range(300)]
    matcher, converter = Matcher([table]), trie.Converter([table])
    for keep in (True, False):
        assert word.convert_paragraphs(paragraphs, converter, keep) == [word.convert_runs(p, matcher, keep) for p in paragraphs]
    raw = queries.make_docx(["奧", "x龍", "乾", "淨"])
    read = lambda b: zipfile.ZipFile(io.BytesIO(b)).read("word/document.xml")
    assert read(word.convert_docx(raw, converter)) == read(word.convert_docx(raw, matcher))


def test_notes_and_tables(spark):
    """Notes by run, cells by paragraph, and notes left alone if so asked."""
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as out:
        out.writestr("word/document.xml", "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>乾</w:t></w:r><w:r><w:t>淨</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
        out.writestr("word/footnotes.xml", "<w:p><w:r><w:t>乾</w:t></w:r><w:r><w:t>淨</w:t></w:r><w:r><w:t>乾淨</w:t></w:r></w:p>")
    converter = trie.Converter([{"乾淨": "干净"}])
    for notes, want in ((True, "干净"), (False, "乾淨")):
        done = zipfile.ZipFile(io.BytesIO(word.convert_docx(sink.getvalue(), converter, notes=notes)))
        assert done.read("word/document.xml").decode().count("<w:t>干</w:t></w:r><w:r><w:t>净</w:t>") == 1
        notes_xml = done.read("word/footnotes.xml").decode()
        assert "<w:t>乾</w:t></w:r><w:r><w:t>淨</w:t>" in notes_xml and f"<w:t>{want}</w:t>" in notes_xml


def test_books_as_rows(spark):
    """The bytes of convert_epub, for odd books too, from many tasks."""
    converter = trie.Converter([samples.dictionary("new_glyphs").first()])
    books = {f"/b/{n}": queries.make_book(["奧" * n, "x", "讪&<"]) for n in range(4)}
    books["/b/large"] = queries.make_book([f"奧 {n}" for n in range(300)])
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as out:
        out.writestr("a.html", "<p>奧</p>".encode("utf-16"))
        out.writestr("mimetype", "application/epub+zip")
        out.comment = b"x"
    books["/b/late mimetype"] = sink.getvalue()
    sink = io.BytesIO()
    zipfile.ZipFile(sink, "w").close()
    books["/b/empty"] = sink.getvalue()
    books |= {"/b/broken": b"no archive"}
    table = spark.createDataFrame([*books.items(), ("/b/null", None)], "path string, content binary").repartition(2)
    got = {r.path: r for r in epub.convert_books(table, converter).collect()}
    assert set(got) == set(books)
    for path, content in books.items():
        if path == "/b/broken":
            assert got[path].content is None and got[path].error.startswith("BadZipFile")
        else:
            new, problems = epub.convert_epub(content, converter)
            assert bytes(got[path].content) == new and got[path].error == ("; ".join(problems) or None), path
    entries = table.lateralJoin(F.udtf(epub._Entries, returnType=epub.ENTRY_DDL)(F.col("content").outer())).repartition(4, "path", "ordinal")
    assert entries.filter("path = '/b/large'").select(F.spark_partition_id()).distinct().count() == 4


def test_graph_segments_by_brute_force(spark, tmp_path):
    """The query against paths and matches one text at a time."""
    texts = ["thererthon a test", "", None, "x" * 50, "on at en nd ti es", "theheatonerinan" * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cut, matcher = queries.graph_cutter(), Matcher([samples.many_phrases().first(), samples.many_characters().first()])
    paired = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", samples.paired_text(F.col("text")).alias("text")).collect()}
    got = {r.doc_id: r for r in queries.convert_graph_segments(spark, str(tmp_path)).collect()}
    import hashlib

    for i, text in paired.items():
        if text is None:
            assert got[i].words is None and got[i].converted_md5 is None
        else:
            segments = cut(text)
            assert got[i].words == len(segments)
            assert got[i].converted_md5 == hashlib.md5("".join(map(matcher.convert, segments)).encode()).hexdigest()


def test_user_words_and_setup():
    """40,000 user words take the highest frequency, in seconds."""
    start = time.perf_counter()
    cut = queries.graph_cutter()
    assert time.perf_counter() - start < 5
    own = samples.many_words()[0]
    assert cut(own) == [own]


def test_document_frequencies(spark):
    table = spark.createDataFrame([("ab ab c",), ("ab",), (None,), ("",), ("ab",)], "text string")
    cut = trie.MaxMatch(["ab", " "])
    got = {r.word: (r.uses, r.texts) for r in segment.document_frequencies(table, "text", cut, [" ", "zz"]).collect()}
    assert got == {"ab": (4, 3), "c": (1, 1)}
    assert {r.word for r in segment.document_frequencies(table, "text", cut).collect()} == {"ab", "c", " "}


def test_stop_word_files(spark, tmp_path, monkeypatch):
    (tmp_path / "stop").write_text("的\n\n 了 \n", encoding="utf-8")
    assert segment.read_stop_words(spark, str(tmp_path / "stop")) == ["的", "了"]
    monkeypatch.setattr(segment, "BROADCAST_KEYS", -1)  # the join that does not broadcast
    table = spark.createDataFrame([("的 的x",)], "text string")
    assert {r.word: r.uses for r in segment.document_frequencies(table, "text", trie.MaxMatch([]), ["的"]).collect()} == {" ": 1, "x": 1}


def test_sql_function_with_a_profile(spark):
    c.register_all(spark, {"a": trie.Converter([{"乾": "干"}]), "b": c.in_steps([[Dictionary("d", {"乾": ("乹",)})], [Dictionary("e", {"乹": ("軋",)})]])})
    spark.createDataFrame([("乾x", "a"), ("乾", "b"), (None, "a"), ("乾", None)], "text string, p string").createOrReplaceTempView("given")
    assert [r[0] for r in spark.sql("SELECT convert_text(text, p) FROM given").collect()] == ["干x", "軋", None, None]
    assert [r[0] for r in spark.sql("SELECT convert_text(text, 'a') FROM given").collect()] == ["干x", "干", None, "干"]
    with pytest.raises(Exception, match="no profile"):
        spark.sql("SELECT convert_text(text, 'none') FROM given").collect()


def test_all_pairs_of_letters(spark):
    text = "".join(a + b for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2))
    assert run(spark, [text, "aB c\nde", None], samples.paired_text) == ["".join(chr(samples.FIRST + n) for n in range(676)), "aB c\n" + chr(samples.FIRST + samples.paired("de")), None]
