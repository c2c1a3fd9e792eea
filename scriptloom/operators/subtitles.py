"""Subtitles and lyrics as column expressions over whole files; no shuffle, no row per line.

A format cuts a file into parts, each a fixed text and a text to convert; all texts of a file are then
converted at once, by an expression or by one call of the matcher, and put together.

SRT: a cue is a line of digits, a line with ``-->`` and text lines up to a blank line or another line of
digits; only those text lines are converted. ASS and SSA: the tenth field of Dialogue and Comment lines
of the [Events] section. LRC: the contents of some ID tags, and what follows leading time tags. Style
tags stay, and no match runs across one. Line ends become ``\\n``.

Given a ``Conversion``, a format cuts files in an Arrow function instead, by the same patterns, and all texts of a
piece of a batch go through the matcher together; with any other function the parts are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.convert import Conversion, Convert, assembled, part, parts
from scriptloom.functions.pieces import piecewise

#: Protected spans and how they open: style overrides in braces, and numbers in angle brackets of lyrics (fixed values).
BRACE_TAG, NUMBER_TAG = (r"\{[^}]*\}", r"\{"), (r"<\d+>", "<")
#: ID tags of lyrics whose content is text (fixed values).
ID_TAGS = ("ti", "ar", "al", "by", "re", "ve", "offset")
_DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
_BLANK = r"[\s\x{85}\x{A0}\x{1C}-\x{1F}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# The same patterns for files cut in tasks; a dot and a digit mean there what they mean in expressions.
_B = "[ \t-\r\x85\xa0\x1c-\x1f\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_D = r"[\d\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]"
_dot = "[^\n\r\x85\u2028\u2029]"
_ends, _brace, _number = re.compile("\r\n?"), re.compile(r"(\{[^}]*\})"), re.compile("(<[0-9]+>)")
_block, _cue = re.compile(rf"\n(?={_B}*{_D}*{_B}*(?:\n|\Z))"), re.compile(rf"{_B}*{_D}+{_B}*\Z")
_section, _events = re.compile(rf"\n(?={_B}*\[[^\n]*\]{_B}*(?:\n|\Z))"), re.compile(rf"{_B}*\[(?ai:events)\]{_B}*(?:\n|\Z)")
_event = re.compile(r"((?ai:Dialogue|Comment):(?:[^,]*,){9})(.*)\Z", re.S)
_edge, _around = re.compile(rf"{_B}*"), re.compile(rf"\A{_B}+|{_B}+\Z")
_ident, _timed = re.compile(rf"\[([a-zA-Z]+):({_dot}+)\]\Z"), re.compile(rf"((?:\[[0-9]+:[0-9]+(?:\.[0-9]+)?\])+)({_dot}*)\Z")


class Cut:
    """A file in order, and which of its strings are texts to convert."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gaps: list[int] = []

    def fixed(self, text: str) -> None:
        self.out.append(text)

    def gap(self, text: str) -> None:
        if text:
            self.gaps.append(len(self.out))
            self.out.append(text)

    def tagged(self, text: str, tag: re.Pattern) -> None:
        for i, piece in enumerate(tag.split(text)):
            (self.fixed if i % 2 else self.gap)(piece)


def cut_lines(text: str) -> Cut:
    cut = Cut()
    for i, line in enumerate(text.split("\n")):
        cut.fixed("\n" if i else "")
        cut.gap(line)
    return cut


def cut_srt(text: str) -> Cut:
    cut = Cut()
    for j, block in enumerate(_block.split(_ends.sub("\n", text))):
        cut.fixed("\n" if j else "")
        lines = block.split("\n")
        if len(lines) < 2 or "-->" not in lines[1] or not _cue.match(lines[0]):
            cut.fixed(block)
            continue
        cut.fixed("\n".join(lines[:2]))
        for line in lines[2:]:
            cut.fixed("\n")
            cut.tagged(line, _brace)
    return cut


def cut_ass(text: str) -> Cut:
    cut = Cut()
    for j, section in enumerate(_section.split(_ends.sub("\n", text))):
        cut.fixed("\n" if j else "")
        if not _events.match(section):
            cut.fixed(section)
            continue
        for i, line in enumerate(section.split("\n")):
            cut.fixed("\n" if i else "")
            if found := _event.match(line):
                cut.fixed(found[1])
                cut.tagged(found[2], _brace)
            else:
                cut.fixed(line)
    return cut


def cut_lrc(text: str) -> Cut:
    cut = Cut()
    for i, line in enumerate(_ends.sub("\n", text).split("\n")):
        cut.fixed("\n" if i else "")
        bare, indent = _around.sub("", line), _edge.match(line)[0]
        if found := _ident.match(bare):
            if found[1].lower() in ID_TAGS:
                cut.fixed(f"{indent}[{found[1]}:")
                cut.gap(found[2])
                cut.fixed("]")
            else:
                cut.fixed(line)
        elif found := _timed.match(bare):
            cut.fixed(indent + found[1])
            cut.tagged(found[2], _number)
        else:
            cut.fixed(line)
    return cut


def _applied(text: Column, convert: Convert, cut: Callable[[str], Cut], pieces: Callable[[Column], Column]) -> Column:
    if not isinstance(convert, Conversion):
        return assembled(pieces(text), convert)
    converter = convert.converter()

    def whole(texts: pa.Array) -> pa.Array:
        cuts = [None if t is None else cut(t) for t in texts.to_pylist()]
        live = [c for c in cuts if c is not None]
        done = iter(converter([c.out[k] for c in live for k in c.gaps]))
        for c in live:
            for k in c.gaps:
                c.out[k] = next(done)
        return pa.array([None if c is None else "".join(c.out) for c in cuts], pa.string())

    @F.arrow_udf("string")
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return piecewise(batches, whole)

    return converted(text)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def txt_parts(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(part(F.lit(""), text)))


def convert_txt(text: Column, convert: Convert) -> Column:
    """The whole text at once."""
    return convert(text)


def convert_txt_by_line(text: Column, convert: Convert) -> Column:
    """Line by line: no match runs across a line end."""
    return _applied(text, convert, cut_lines, lambda t: F.transform(F.split(t, "\n"), lambda x, i: part(_joint(i), x)))


def _joint(i: Column) -> Column:
    """The line end before every line but the first. (A function within a function must not use the outer one's variables, or Python functions cannot take the result.)"""
    return F.when(i > 0, "\n").otherwise("")


def _fixed(text: Column) -> Column:
    return F.array(part(text))


def srt_parts(text: Column) -> Column:
    # Blocks begin at blank lines and at lines of digits; the text lines of a cue are the rest of one block.
    blocks = F.split(unix_lines(text), rf"\n(?={_BLANK}*{_DIGIT}*{_BLANK}*(?:\n|\z))")

    def block(b: Column, j: Column) -> Column:
        lines = F.split(b, "\n")
        cue = F.get(lines, 0).rlike(rf"\A{_BLANK}*{_DIGIT}+{_BLANK}*\z") & F.coalesce(F.get(lines, 1).contains("-->"), F.lit(False))
        texts = F.flatten(F.transform(lines, lambda x, i: F.when(i < 2, _fixed(F.concat(_joint(i), x))).otherwise(F.concat(_fixed(F.lit("\n")), parts(x, *BRACE_TAG)))))
        return F.concat(_fixed(_joint(j)), F.when(cue, texts).otherwise(_fixed(b)))

    return F.flatten(F.transform(blocks, block))


def convert_srt(text: Column, convert: Convert) -> Column:
    return _applied(text, convert, cut_srt, srt_parts)


def _ass_line(line: Column) -> Column:
    """Parts of a line of the events section: field ten of Dialogue and Comment, if there are ten fields."""
    pattern = r"(?is)\A((?:Dialogue|Comment):(?:[^,]*,){9})(.*)\z"
    return F.when(line.rlike(pattern), F.concat(_fixed(F.regexp_extract(line, pattern, 1)), parts(F.regexp_extract(line, pattern, 2), *BRACE_TAG))).otherwise(_fixed(line))


def convert_ass_line(line: Column, convert: Convert) -> Column:
    return assembled(_ass_line(line), convert)


def ass_parts(text: Column) -> Column:
    sections = F.split(unix_lines(text), rf"\n(?={_BLANK}*\[[^\n]*\]{_BLANK}*(?:\n|\z))")
    events = rf"(?is)\A{_BLANK}*\[events\]{_BLANK}*(?:\n|\z)"

    def section(s: Column, j: Column) -> Column:
        lines = F.flatten(F.transform(F.split(s, "\n"), lambda x, i: F.concat(_fixed(_joint(i)), _ass_line(x))))
        return F.concat(_fixed(_joint(j)), F.when(s.rlike(events), lines).otherwise(_fixed(s)))

    return F.flatten(F.transform(sections, section))


def convert_ass(text: Column, convert: Convert) -> Column:
    return _applied(text, convert, cut_ass, ass_parts)


# The forms of ID tags and of time tags in lyrics.
_IDENT = r"\A\[([a-zA-Z]+):(.+)\]\z"
_TIMED = r"\A((?:\[\d+:\d+(?:\.\d+)?\])+)(.*)\z"


def _lyric_parts(line: Column) -> Column:
    """A line with what its white space encloses, named once: each use of an expression would evaluate it again."""
    return F.struct(line.alias("line"), F.regexp_replace(line, rf"\A{_BLANK}+|{_BLANK}+\z", "").alias("bare"))


def _lyric(x: Column) -> Column:
    line, bare = x["line"], x["bare"]
    indent = F.regexp_extract(line, rf"\A({_BLANK}*)", 1)
    known = F.lower(F.regexp_extract(bare, _IDENT, 1)).isin(*ID_TAGS)
    whole = F.array(part(F.concat(indent, F.lit("["), F.regexp_extract(bare, _IDENT, 1), F.lit(":")), F.regexp_extract(bare, _IDENT, 2)), part(F.lit("]")))
    lyric = F.concat(_fixed(F.concat(indent, F.regexp_extract(bare, _TIMED, 1))), parts(F.regexp_extract(bare, _TIMED, 2), *NUMBER_TAG))
    return F.when(bare == "", _fixed(line)).when(bare.rlike(_IDENT), F.when(known, whole).otherwise(_fixed(line))).when(bare.rlike(_TIMED), lyric).otherwise(_fixed(line))


def lrc_parts(text: Column) -> Column:
    lines = F.transform(F.split(unix_lines(text), "\n"), _lyric_parts)
    return F.flatten(F.transform(lines, lambda x, i: F.concat(_fixed(_joint(i)), _lyric(x))))


def convert_lrc(text: Column, convert: Convert) -> Column:
    return _applied(text, convert, cut_lrc, lrc_parts)


#: Parts and converters of text formats by extension.
PARTS = {"txt": txt_parts, "srt": srt_parts, "ass": ass_parts, "ssa": ass_parts, "lrc": lrc_parts}
TEXT_FORMATS = {"txt": convert_txt, "srt": convert_srt, "ass": convert_ass, "ssa": convert_ass, "lrc": convert_lrc}
