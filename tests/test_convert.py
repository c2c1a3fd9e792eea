import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.functions import convert as c
from scriptloom.functions import segment
from scriptloom.functions.convert import Matcher, convert_chain, tagged
from scriptloom.functions.dictionary import Dictionary, MissingResource
from scriptloom.operators import subtitles
from scriptloom.plans import samples
from scriptloom.plans.profile import Profile, profile_name


def run(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.out for r in rows.select("i", column(F.col("text")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("name", "source", "target"),
    [
        ("new_glyphs", "奧顚讪讫驭", "奥顛訕訖馭"),
        ("new_glyphs_keep", "奧顚讪讫驭", "奥顛讪讫驭"),
        ("new_glyphs", "彔录麺", "录録麺"),
        ("new_glyphs_keep", "麺", "麵"),
        ("new_glyphs", "a\U00024b6db", "a㚟‌b"),
        ("simplified_chars", "启绿了", "啓緑了"),
        ("standard_chars_keep", "啟淨讪讫驭", "啓净讪讫驭"),
    ],
)
def test_golden_characters(spark, name, source, target):
    d = samples.dictionary(name)
    assert run(spark, [source, None, ""], lambda x: c.convert_chars(x, d)) == [target, None, ""]
    assert c.Matcher([d.first()]).convert(source) == target


@pytest.mark.parametrize(("source", "target"), [("不瞭解", "不了解"), ("乾乾淨淨", "干干净净"), ("乾元", "乾元"), ("乾紅", "干红"), ("乾淨", "乾净"), ("一目瞭然瞭解\n乾", "一目了然了解\n乾")])
def test_golden_phrases(spark, source, target):
    chain = [samples.dictionary("simple_phrases"), samples.dictionary("standard_chars_keep")]
    assert run(spark, [source, None, ""], lambda x: c.convert_chain(x, chain)) == [target, None, ""]
    assert run(spark, [source, None, ""], c.matcher_udf(chain)) == [target, None, ""]


@given(st.text("乾淨元不瞭解紅a\n", max_size=30))
def test_matcher_is_longest_match_first_dictionary_first(text):
    tables = [samples.dictionary("simple_phrases").first(), samples.dictionary("standard_chars_keep").first()]
    out, at = "", 0
    while at < len(text):
        hits = [max((k for k in t if text.startswith(k, at)), key=len, default=None) for t in tables]
        key = next((k for k in hits if k), None)
        table = tables[hits.index(key)] if key else {}
        out += table[key] if key else text[at]
        at += len(key or "x")
    assert c.Matcher(tables).convert(text) == out


def test_compat_table_is_canonical(spark):
    table = c.compat_table()
    assert len(table) > 900 and all(unicodedata.normalize("NFC", k) == v for k, v in table.items())
    assert run(spark, ["豈\U0002f800x", None], c.normalize_compat) == ["豈丽x", None]


def test_dictionary_parsing(spark, tmp_path):
    d = Dictionary.parse("x", ["# c", "", "乾\t干 乾", "甲\t甲", "彔\t录", "录\t録", "\U00024b6d\t㚟‌", "bad line"])
    assert d.first()["乾"] == "干" and len(d.entries) == 5
    hazards = d.hazards()
    assert hazards == {"expanding": ["\U00024b6d"], "chained": ["彔"], "multiple": ["乾"], "guards": ["甲"]}
    (tmp_path / "d.txt").write_text("奧\t奥\n", encoding="utf-8")
    assert Dictionary.load(spark, str(tmp_path / "d.txt")).first() == {"奧": "奥"}
    with pytest.raises(MissingResource):
        Dictionary.load(spark, str(tmp_path / "none.txt"))


def test_profile(spark, tmp_path):
    text = '{"name": "n", "normalization": [{"dict": {"type": "text", "file": "c.txt"}}], "segmentation": {"type": "jieba", "resources": {"dict_path": "w"}}, "conversion_chain": [{"dict": {"type": "group", "match_policy": "short_circuit", "dicts": [{"type": "text", "file": "p.txt"}, {"type": "text", "file": "q.txt"}]}}]}'
    p = Profile.parse(text)
    assert p.chain == ("p.txt", "q.txt") and p.segmentation == "jieba"
    assert p.missing(lambda f: f == "q.txt") == ["w", "p.txt"]
    (tmp_path / "p.txt").write_text("乾元\t乾元\n", encoding="utf-8")
    (tmp_path / "q.txt").write_text("乾\t干\n", encoding="utf-8")
    chain = p.dictionaries(spark, str(tmp_path))
    cut = p.cut(lambda name: {"w": ["乾元 5"]}[name])
    assert cut("乾元乾豈") == ["乾元", "乾", "豈"]
    assert run(spark, ["乾元乾豈"], lambda x: p.column(x, chain, cut)) == ["乾元干豈"]
    with pytest.raises(MissingResource):
        p.column(F.col("text"), chain)
    assert profile_name("s2t", "ancient") == "s2t_jieba_traditional"


def test_segmentation():
    assert segment.max_match("不瞭解乾元x", {"瞭解", "不瞭解", "乾元"}) == ["不瞭解", "乾元", "x"]
    text = ["0 -100 -100 0", "-100 0 -100 -100", "-100 -100 -100 0", "0 0 0 0", "0 -100 -100 0", "甲:-1,丙:-1", "乙:-1,丁:-1", "", "戊:-1"]
    text[7] = "己:-1"
    model = segment.HiddenMarkov.parse(text)
    assert model.cut("") == [] and "".join(model.cut("甲乙戊")) == "甲乙戊"
    assert segment.graph_cut("甲乙丙", {"甲乙": 5, "乙丙": 1, "丙": 2}) == ["甲乙", "丙"]


def test_replacement_ratio(spark):
    assert run(spark, ["a�", "", "ab"], c.replacement_ratio) == [0.5, 0.0, 0.0]


@given(st.text("乾瞭解 ", min_size=1, max_size=6))
def test_states_are_the_most_probable(text):
    model = segment.HiddenMarkov(
        {"B": -0.3, "E": segment.LOWEST, "M": segment.LOWEST, "S": -1.4},
        {"B": {"E": -0.5, "M": -0.9}, "E": {"B": -0.6, "S": -0.8}, "M": {"E": -0.33, "M": -1.26}, "S": {"B": -0.7, "S": -0.67}},
        {"B": {"瞭": -1.0, "乾": -3.1, " ": -8.3, "解": -2.7}, "E": {"解": -1.1, "乾": -2.3, "瞭": -4.9, " ": -9.2}, "M": {"乾": -2.2, "瞭": -3.7, "解": -3.3, " ": -9.9}, "S": {"乾": -1.7, " ": -0.2, "瞭": -2.9, "解": -2.6}},
    )

    def chance(path):
        steps = sum(model.trans[p][s] for p, s in itertools.pairwise(path))
        return model.start[path[0]] + model.emit[path[0]][text[0]] + steps + sum(model.emit[s][x] for s, x in zip(path[1:], text[1:], strict=True))

    paths = (p for p in itertools.product("BEMS", repeat=len(text)) if p[-1] in "ES" and all(a in segment.BEFORE[b] for a, b in itertools.pairwise(p)))
    assert abs(chance(model.states(text)) - max(map(chance, paths))) < 1e-9


def test_states_of_whole_texts(spark, tmp_path):
    texts = ["the an", "the an er de the\nthe x", "", None, "a"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    half = -0.7
    model = segment.HiddenMarkov({"B": half, "E": segment.LOWEST, "M": segment.LOWEST, "S": half}, {s: dict.fromkeys("BEMS", half) for s in "BEMS"}, {"B": {"瞭": -1.0}, "E": {"解": -1.0}, "M": {}, "S": {"乾": -1.0}})
    source = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", samples.sample_text(F.col("text")).alias("text")).collect()
    want = {r.doc_id: None if r.text is None else len(model.cut(r.text)) for r in source}
    got = {r.doc_id: r.words for r in queries.hmm_states(spark, str(tmp_path)).collect()}
    assert {i: n for i, n in got.items() if n not in (None, -1)} == {i: n for i, n in want.items() if n is not None} and want[1] > want[0] > 3


def test_steps_follow_one_another(spark):
    step = '{{"dict": {{"type": "text", "file": "{}"}}}}'
    p = Profile.parse('{"name": "n", "conversion_chain": [' + step.format("a") + "," + step.format("b") + "]}")
    chain = [Dictionary.parse("a", ["彔\t录"]), Dictionary.parse("b", ["录\t録"])]
    assert p.steps == (("a",), ("b",)) and run(spark, ["彔录"], lambda x: p.column(x, chain)) == ["録録"]
    group = Profile.parse('{"conversion_chain": [{"dict": {"type": "group", "dicts": [{"file": "a"}, {"file": "b"}]}}]}')
    assert group.steps == (("a", "b"),) and run(spark, ["彔录"], lambda x: group.column(x, chain)) == ["录録"]


def test_segments_end_matches(spark):
    p = Profile.parse('{"segmentation": {"type": "mmseg", "dict": {"type": "text", "file": "w"}}, "conversion_chain": [{"dict": {"file": "d"}}]}')
    chain = [Dictionary.parse("d", ["乾乾淨淨\t干干净净", "一目瞭然\t一目了然"])]
    cut = p.cut(lambda _: ["乾乾\tx", "一目瞭然\tx"])
    assert run(spark, ["乾乾淨淨一目瞭然", "", None], lambda x: p.column(x, chain, cut)) == ["乾乾淨淨一目了然", "", None]


@pytest.mark.parametrize("tag", [subtitles.BRACE_TAG, subtitles.NUMBER_TAG])
def test_tags_by_brute_force(spark, tag):
    import random
    import re

    rng = random.Random(9)
    chain = [Dictionary.parse("d", ["乾淨\t干净", "乾\t干"])]
    texts = ["".join(rng.choice("乾淨{}<>1a\n") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    matcher, pattern = Matcher([chain[0].first()]), re.compile(f"({tag[0]})")
    want = ["".join(x if k % 2 else matcher.convert(x) for k, x in enumerate(pattern.split(t))) for t in texts]
    assert run(spark, texts, lambda x: tagged(x, *tag, lambda y: convert_chain(y, chain))) == want


def test_many_characters_and_phrases(spark):
    """Thousands of characters and hundreds of phrases: the expression equals the matcher."""
    chars = {chr(0x4E00 + i): chr(0x6E00 + i) for i in range(3000)}
    phrases = {chr(0x4E00 + i) + chr(0x4E00 + (7 * i) % 500) + "x" * (i % 3): f"<{i}>" for i in range(500)}
    chain = [Dictionary("p", {k: (v,) for k, v in phrases.items()}), Dictionary("c", {k: (v,) for k, v in chars.items()})]
    texts = ["".join(chr(0x4E00 + (31 * i * j + j) % 3200) + "x" * (j % 2) for j in range(200)) for i in range(60)] + list(phrases)
    matcher = Matcher([d.first() for d in chain])
    assert run(spark, texts, lambda x: convert_chain(x, chain)) == [matcher.convert(t) for t in texts]
