"""Functions over Arrow batches hold a piece of a batch as Python objects, not all of it."""

import random

import pyarrow as pa
import pytest

from scriptloom.functions import convert as c
from scriptloom.functions import pieces, segment
from scriptloom.functions.trie import MaxMatch
from scriptloom.operators import epub, subtitles
from scriptloom.plans import batch, samples
from scriptloom.queries import make_book, make_docx
from scriptloom.sources import encoding


def test_pieces_cover_a_batch_in_order():
    texts, ids = pa.array(["x" * (n % 90) for n in range(1000)] + [None, "y" * 5000]), pa.array(range(1002))
    got = list(pieces.pieces((texts, ids), 1000))
    assert pa.concat_arrays([t for t, _ in got]).equals(texts) and pa.concat_arrays([i for _, i in got]).equals(ids)
    assert all(sum(a.nbytes for a in p) <= 1000 or len(p[0]) == 1 for p in got)
    assert [len(p[0]) for p in pieces.pieces((texts[:0],))] == [0]


class Seen:
    """A converter or cutter that notes how much it is given at once."""

    def __init__(self):
        self.most = 0

    def __call__(self, texts):
        self.most = max(self.most, sum(map(len, texts)))
        return [t.upper() for t in texts]

    def cut(self, found):
        self.most = max(self.most, len(found.codes))


@pytest.mark.parametrize("made", [c.converter_udf, c.assembling_udf, segment.words_udf, segment.word_count_udf])
def test_functions_take_pieces(spark, made, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_BYTES", 2000)
    seen, texts = Seen(), ["ab" * 50, None, ""] * 200
    given = pa.array(texts)
    if made is c.assembling_udf:
        given = pa.array([None if t is None else [{"fixed": "-", "gap": t}, {"fixed": "|", "gap": ""}] for t in texts], pa.list_(pa.struct([("fixed", pa.string()), ("gap", pa.string())])))
    out = list(made(seen).func(iter([given, given[:0], given[7:]])))
    assert len(out) > 20 and 0 < seen.most <= 2000
    whole = [x for part in out for x in part.to_pylist()]
    assert len(whole) == 600 + 593 and whole[0] is not None and whole[1] is None
    if made is c.assembling_udf:
        assert whole[:3] == ["-" + "AB" * 50 + "|", None, "-|"]


def test_containers_and_encodings_by_pieces(spark, monkeypatch):
    rows = [(f"/in/{n}.{'docx' if n % 2 else 'txt'}", make_docx(["瞭解" * 50]) if n % 2 else "瞭解".encode() * 50) for n in range(40)]
    found = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    done = batch.convert_files(found, [samples.dictionary("simple_phrases")]).collect()
    assert [r.status for r in done] == ["ok"] * 40 and done[0].content.decode() == "了解" * 50
    monkeypatch.setattr(pieces, "PIECE_BYTES", 2000)
    sizes = [len(x) for x in batch._container_udf(c.Conversion([samples.dictionary("simple_phrases")]).converter(), True, True).func(iter([(pa.array([x for _, x in rows[1::2]]), pa.array(["docx"] * 20))]))]
    assert sum(sizes) == 20 and len(sizes) > 3
    got = found.select("path", encoding.examined(found.content).alias("x")).filter("path like '%txt'").select("x.*").collect()
    assert all(r.encoding == "utf-8" and r.text == "瞭解" * 50 and r.label == "utf-8" and r.confidence > 0.9 for r in got)


def test_max_match_counts_stay(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_BYTES", 10)
    assert [x for part in segment.word_count_udf(MaxMatch(["ab"])).func(iter([pa.array(["abab", None, "xab"])])) for x in part.to_pylist()] == [2, None, 2]


def test_books_convert_documents_of_many_entries_at_once(spark, monkeypatch):
    """The matcher is called for a piece of the rows, not for each entry."""
    calls = []
    whole = epub._convert_cut
    monkeypatch.setattr(epub, "_convert_cut", lambda cuts, convert: calls.append(len(cuts)) or whole(cuts, convert))
    convert = c.Conversion([samples.dictionary("simple_phrases")]).converter()
    entries = list(epub.entries(make_book(["瞭解", "x & 瞭解"] * 50)))
    names, documents, raws = [e.name for e in entries], [e.document for e in entries], [e.raw for e in entries]
    got, errors = epub._converted(names, documents, list(raws), [None] * len(raws), convert)
    assert calls == [100] and got == [epub.converted(e, convert).raw for e in entries] and errors == [None] * len(raws)
    bad = raws[:3] + [b"\xff\xfe\x00"] + raws[4:]
    got, errors = epub._converted(names, documents, list(bad), [None] * len(raws), convert)
    assert [(g, e) for g, e in zip(got, errors, strict=True)] == [(n.raw, n.error) for n in (epub.converted(e._replace(raw=r), convert) for e, r in zip(entries, bad, strict=True))]


@pytest.mark.parametrize("kind", ["srt", "ass", "lrc", "by line"])
def test_formats_cut_in_tasks_as_expressions_cut_them(spark, kind):
    """Random files of what the formats look for: one function for a piece of files, the same text as by expressions."""
    rng = random.Random(3)
    bits = ["1", "２", "²", "12", "00:01 --> 00:02", "\n", "\n\n", "\r\n", "\r", " ", "　", " ", "\x85", "\x1c", "{\\i1}", "{", "}", "{\n}", "瞭解", "乾乾淨淨", "乾", "[Events]", "[EventS] ", "[eventſ]", "[x]", "[ti:瞭解]", "[TI:乾 ]", "[xx:乾]", "[00:01.2]", "[00:01]", "[0٣:01]", "<1>", "<٣>", "<", "Dialogue: 0,a,b,奧,,0,0,0,,", "comment:,,,,,,,,,", "\nDialogue:,", ",", "-->", "x"]
    rows = [(n, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for n in range(1500)]
    rows += [(1500, None), (1501, ""), (1502, "1\n00:00 --> 00:01\n瞭{\\b1}解 瞭解\n\n2\n-->\n"), (1503, "[Events]\nDialogue: 0,a,b,奧,,0,0,0,,{\\b1}瞭{x}解瞭解"), (1504, "[ti:瞭解]\n[00:01.23]<1>瞭解<2>\n  [00:01]瞭解  ")]
    table = spark.createDataFrame(rows, "n int, text string").coalesce(1)
    chain = [samples.dictionary("simple_phrases"), samples.dictionary("standard_chars_keep")]
    function = subtitles.convert_txt_by_line if kind == "by line" else subtitles.TEXT_FORMATS[kind]
    both = table.select("n", "text", function(table.text, c.Conversion(chain)).alias("a"), function(table.text, lambda x: c.convert_chain(x, chain)).alias("b"))
    assert "ArrowEvalPython" in both._jdf.queryExecution().executedPlan().toString()
    got = both.collect()
    assert [(r.text, r.a) for r in got] == [(r.text, r.b) for r in got] and any(r.a != r.text for r in got)
