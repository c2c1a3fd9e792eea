"""Dictionary conversion as column expressions, and the same semantics in Python for container formats.

At each position the dictionaries of a chain are tried in order; the longest key of the first one that
matches is replaced by its first value, otherwise one character is copied. Conversion is one pass: what
has been written is never read again. Null stays null, and the empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptloom.functions.dictionary import Dictionary
from scriptloom.functions.pieces import piecewise, pieces
from scriptloom.functions.trie import Batch, Converter, passes, union

Convert = Callable[[Column], Column]
#: Phrases, and characters that become several, up to which conversion is one regular expression in the JVM;
#: beyond, the trie in Arrow batches. At 20 phrases the trie is twice as fast, at 600 twenty times (16 M characters).
EXPRESSION_PHRASES = 16


@lru_cache(1)
def compat_table() -> dict[str, str]:
    """CJK compatibility ideographs by their canonical decomposition, each to one character."""
    spans = (range(0xF900, 0xFB00), range(0x2F800, 0x2FA20))
    found = {chr(c): unicodedata.normalize("NFC", chr(c)) for span in spans for c in span}
    return {k: v for k, v in found.items() if v != k and len(v) == 1}


def _translated(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values())) if table else column


def normalize_compat(column: Column) -> Column:
    return _translated(column, compat_table())


def convert_chars(column: Column, dictionary: Dictionary) -> Column:
    """Each character by the dictionary's single-character keys."""
    table = {k: v for k, v in dictionary.first().items() if len(k) == 1}
    if all(len(v) == 1 for v in table.values()):
        return _translated(column, table)
    # Characters that expand cannot go through translate(): split the text there, and join it again.
    even = {k: v for k, v in table.items() if len(v) == 1}
    odd = {k: v for k, v in table.items() if len(v) != 1}
    if len(odd) > EXPRESSION_PHRASES:
        return converter_udf(Converter([table]))(column)
    parts = F.regexp_extract_all(column, F.lit(f"(?s)[{_class(odd)}]|[^{_class(odd)}]+"), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for pair in odd.items() for x in pair])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(lookup, p), _translated(p, even))), "")


def _class(chars: Sequence[str] | dict[str, str]) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def _chain_tables(chain: Sequence[Dictionary]) -> list[dict[str, str]]:
    return [d.first() for d in chain]


def _longest(keys: Sequence[str]) -> str:
    """A pattern for the longest of some keys, shared beginnings once."""
    by: dict[str, list[str]] = {}
    for k in keys:
        if k:
            by.setdefault(k[0], []).append(k[1:])
    options = [f"\\x{{{ord(c):X}}}" + _longest(rest) for c, rest in by.items()]
    if not options:
        return ""
    joined = options[0] if len(options) == 1 and "" not in keys else f"(?:{'|'.join(options)})"
    return joined + "?" * ("" in keys)


def convert_chain(column: Column, chain: Sequence[Dictionary]) -> Column:
    """Longest match over the chain, first dictionary first: an expression, or the matcher if there are many phrases."""
    table = union(_chain_tables(chain))
    even = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    lookup = {k: v for k, v in table.items() if len(k) != 1 or len(v) != 1}
    if not lookup:
        return _translated(column, even)
    if len(lookup) > EXPRESSION_PHRASES:
        return matcher_udf(chain)(column)
    # Only keys that translate() cannot take are tokens; what lies between them stays together.
    first = "".join(f"\\x{{{ord(c):X}}}" for c in sorted({k[0] for k in lookup}))
    tokens = F.regexp_extract_all(column, F.lit(f"(?s){_longest(list(lookup))}|[^{first}]+|."), F.lit(0))
    values = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(values, t), _translated(t, even))), "")


class Conversion:
    """A chain as a column function; ``normalize`` puts compatibility characters first.

    With many phrases it is a Python function, which cannot stand inside ``transform``: formats hand all
    their parts over at once (see ``assembled``).
    """

    def __init__(self, chain: Sequence[Dictionary], normalize: bool = False) -> None:
        self.chain, self.before = list(chain), compat_table() if normalize else None
        self.many = sum(len(k) != 1 or len(v) != 1 for k, v in union(_chain_tables(chain)).items()) > EXPRESSION_PHRASES

    def converter(self) -> Converter:
        return Converter(_chain_tables(self.chain), self.before)

    def __call__(self, text: Column) -> Column:
        if self.many:
            return converter_udf(self.converter())(text)
        return convert_chain(_translated(text, self.before or {}), self.chain)


def part(fixed: Column, gap: Column | None = None) -> Column:
    """A fixed text and a text to convert behind it."""
    return F.struct(fixed.alias("fixed"), (F.lit("") if gap is None else gap).alias("gap"))


def parts(column: Column, tag: str, opener: str) -> Column:
    """A text as parts: what matches ``tag``, which begins with ``opener``, is fixed; each gap stands on its own."""
    pieces = F.regexp_extract_all(column, F.lit(f"(?s){tag}|(?:[^{opener}]+|(?!{tag}){opener})+"), F.lit(0))
    return F.transform(pieces, lambda p: F.when(p.rlike(f"(?s)\\A{tag}\\z"), part(p)).otherwise(part(F.lit(""), p)))


def assembled(pieces: Column, convert: Convert) -> Column:
    """The text of an array of parts, converted."""
    if isinstance(convert, Conversion) and convert.many:
        return assembling_udf(convert.converter())(pieces)
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["fixed"], convert(p["gap"]))), "")


def tagged(column: Column, tag: str, opener: str, convert: Convert) -> Column:
    """Text with protected spans: what matches ``tag`` stays; each gap is converted on its own."""
    return assembled(parts(column, tag, opener), convert)


class Matcher:
    """The same conversion in plain Python, for short texts and as a measure for the others."""

    def __init__(self, chain: Sequence[dict[str, str]]) -> None:
        self.tables = []
        for table in chain:
            lengths: dict[str, list[int]] = {}
            for key in table:
                sizes = lengths.setdefault(key[0], [])
                if len(key) not in sizes:
                    sizes.append(len(key))
            self.tables.append((table, {c: sorted(n, reverse=True) for c, n in lengths.items()}))
        self.starts = {c for _, lengths in self.tables for c in lengths}

    def tokens(self, text: str) -> Iterator[tuple[str, str]]:
        """(source, target) pieces in order; copied characters map to themselves."""
        at, size = 0, len(text)
        while at < size:
            char = text[at]
            found = None
            if char in self.starts:
                for table, lengths in self.tables:
                    for n in lengths.get(char, ()):
                        if (piece := text[at : at + n]) in table:
                            found = piece, table[piece]
                            break
                    if found:
                        break
            found = found or (char, char)
            yield found
            at += len(found[0])

    def convert(self, text: str | None) -> str | None:
        if not text:
            return text
        return "".join(target for _, target in self.tokens(text))


def converter_udf(convert: Converter):
    """A text column function from a converter, which is built once and sent to tasks as it is."""

    @F.arrow_udf(StringType())
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return piecewise(batches, lambda texts: _converted(texts, convert))

    return converted


def assembling_udf(convert: Converter):
    """The same for arrays of parts, put together."""

    def joined(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        inner = lists.flatten()
        fixed, gaps = (pc.struct_field(inner, name) for name in ("fixed", "gap"))
        whole = pc.binary_join_element_wise(fixed, _converted(gaps, convert), "")
        return pc.binary_join(pa.ListArray.from_arrays(offsets, whole, mask=lists.is_null() if lists.null_count else None), "")

    @F.arrow_udf(StringType())
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return piecewise(batches, joined)

    return converted


def _converted(texts: pa.Array, convert: Converter) -> pa.Array:
    done = pa.array(convert(texts.fill_null("").to_pylist()), pa.string())
    return pc.if_else(texts.is_valid(), done, pa.scalar(None, pa.string())) if texts.null_count else done


def matcher_udf(chain: Sequence[Dictionary]):
    return converter_udf(Converter(_chain_tables(chain)))


def has_cjk(column: Column) -> Column:
    """The gate of the Word converter: a character of the basic CJK block."""
    return column.rlike("[\\x{4E00}-\\x{9FFF}]")


def replacement_ratio(column: Column) -> Column:
    """Share of U+FFFD among the characters."""
    bad = F.length(column) - F.length(F.replace(column, F.lit("�"), F.lit("")))
    return F.when(F.length(column) > 0, bad / F.length(column)).otherwise(F.lit(0.0))


def in_steps(steps: Sequence[Sequence[Dictionary]], normalize: bool = False, cutter=None) -> Callable[[list[str]], list[str]]:
    """Texts converted step after step; no match runs across the end of a segment that ``cutter`` makes."""
    before = Converter([], compat_table()) if normalize else None
    converters = [Converter(_chain_tables(chain)) for chain in steps]

    def whole(texts: list[str]) -> list[str]:
        out: list[str] = []
        for part_ in passes(texts):
            batch = Batch(part_)
            if before is not None:
                before.apply(batch)
            if cutter is not None:
                cutter.cut(batch)
            for converter in converters:
                converter.apply(batch)
            out += batch.texts()
        return out

    return whole


def segmented_udf(cutter, steps: Sequence[Sequence[Dictionary]]):
    """Conversion in which no match runs across the end of a segment, step after step; ``cutter`` cuts batches."""
    return converter_udf(in_steps(steps, cutter=cutter))


def register(spark, name: str, chain: Sequence[Dictionary]) -> None:
    """A SQL function ``name(text)`` for a chain."""
    spark.udf.register(name, matcher_udf(chain))


def register_all(spark, converters: Mapping[str, Callable[[list[str]], list[str]]], name: str = "convert_text") -> None:
    """A SQL function ``name(text, profile)``: each text by the converter of its profile; an unknown profile is an error, a null one gives null.

    The converters go to tasks once, whatever the number of profiles that a statement names.
    """

    @F.arrow_udf(StringType())
    def converted(texts: pa.Array, profiles: pa.Array) -> pa.Array:
        # A function with two arguments in SQL takes whole batches; only the result is held whole, as Arrow's bytes.
        return pa.concat_arrays([one(*piece) for piece in pieces((texts, profiles))])

    def one(texts: pa.Array, profiles: pa.Array) -> pa.Array:
        out = pa.nulls(len(texts), pa.string())
        for profile in pc.unique(profiles).drop_null().to_pylist():
            if profile not in converters:
                raise ValueError(f"no profile {profile!r}; there are {', '.join(sorted(converters))}")
            mine = pc.fill_null(pc.equal(profiles, profile), False)
            out = pc.replace_with_mask(out, mine, _converted(texts.filter(mine), converters[profile]))
        return out

    spark.udf.register(name, converted)
