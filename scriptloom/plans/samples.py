"""Sample dictionaries and CJK sample text, small enough to state, for queries and tests.

The driver's tables hold no CJK text; ``sample_text`` turns their Latin text into CJK text by rule: first
frequent letter groups become whole phrases, then letters become characters.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.dictionary import Dictionary

# Entries whose results must agree with the public dictionaries of the same names.
NEW_GLYPHS = "奧\t奥\n顚\t顛\n讪\t訕\n讫\t訖\n驭\t馭\n彔\t录\n录\t録\n\U00024b6d\t㚟‌\n"
NEW_GLYPHS_KEEP = "奧\t奥\n顚\t顛\n麺\t麵\n\U00024b6d\t㚟‌\n"
SIMPLIFIED_CHARS = "启\t啓\n绿\t緑\n了\t了 瞭\n"
STANDARD_CHARS_KEEP = "啟\t啓\n淨\t净\n"
SIMPLE_PHRASES = "不瞭解\t不了解\n乾乾淨淨\t干干净净\n乾元\t乾元\n乾紅\t干红 乾红\n老態龍鍾\t老态龙钟\n瞭解\t了解\n一目瞭然\t一目了然\n情有獨鍾\t情有独钟\n"
#: Letter groups and their phrases, in order of replacement, and characters for the letters a to z (fixed values).
GROUPS = (("the", "老態龍鍾"), ("th", "瞭解"), ("on", "一目瞭然"), ("er", "乾元"), ("en", "情有獨鍾"), ("an", "乾乾淨淨"), ("de", "不瞭解"), ("es", "一坏"))
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "乾淨瞭解情有獨鍾一目然不奧顚讪讫驭彔㑇\U00030edd\U00031144\U000283cf麺裏説啟"


def dictionary(name: str) -> Dictionary:
    texts = {"new_glyphs": NEW_GLYPHS, "new_glyphs_keep": NEW_GLYPHS_KEEP, "simplified_chars": SIMPLIFIED_CHARS, "standard_chars_keep": STANDARD_CHARS_KEEP, "simple_phrases": SIMPLE_PHRASES}
    return Dictionary.parse(name, texts[name].splitlines())


def sample_text(text: Column) -> Column:
    for group, phrase in GROUPS:
        text = F.replace(text, F.lit(group), F.lit(phrase))
    return F.translate(text, LETTERS, CHARACTERS)


def sample_sql(text: str = "text") -> str:
    """The same in SQL."""
    for group, phrase in GROUPS:
        text = f"replace({text}, '{group}', '{phrase}')"
    return f"translate({text}, '{LETTERS}', '{CHARACTERS}')"


# Dictionaries of real size, made by rule: two Latin letters in a row become one of 676 CJK characters.
FIRST = 0x4E00
#: Letter pairs that are frequent in the tables' languages; phrases are made of their characters.
FREQUENT = "th he in er an re on at en nd ti es or te of ed is it al ar st to".split()


def paired(a: str) -> int:
    """The number of a letter pair's character."""
    return 26 * (ord(a[0]) - 97) + ord(a[1]) - 97


def many_characters() -> Dictionary:
    """3,600 characters, each to another one; every fiftieth to two."""
    return Dictionary("many_characters", {chr(FIRST + n): (chr(FIRST + (7 * n + 5) % 3600) + "々" * (n % 50 == 0),) for n in range(3600)})


def many_phrases() -> Dictionary:
    """548 phrases of two and three characters; every fourth guards its characters, every fifth of the others grows."""
    keys = [*product(FREQUENT, repeat=2), *product(FREQUENT[:4], repeat=3)]
    out = {}
    for n, key in enumerate(keys):
        word = "".join(chr(FIRST + paired(x)) for x in key)
        out[word] = (word if n % 4 == 0 else word[::-1] + "〇" * (n % 5 == 0),)
    return Dictionary("many_phrases", out)


def many_words() -> list[str]:
    """40,000 words of two characters: the first among 200, the second among 200 others."""
    return [chr(FIRST + a) + chr(FIRST + b) for a in range(80, 280) for b in range(330, 530)]


def frequencies() -> dict[str, int]:
    """Words with frequencies by rule: the phrases, the words, and half of the characters."""
    keys = [*many_phrases().entries, *many_words(), *(chr(FIRST + n) for n in range(0, 676, 2))]
    return {k: 1 + (7919 * n) % 9973 for n, k in enumerate(keys)}


def paired_text(text: Column) -> Column:
    """Text whose letter pairs are CJK characters; everything else stays."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)[a-z]{2}|(?:(?![a-z]{2}).)+"), F.lit(0))
    place = lambda p, n: F.ascii(F.substring(p, n, 1)) - 97
    made = lambda p: F.decode(F.unhex(F.hex((FIRST + 26 * place(p, 1) + place(p, 2)).cast("long"))), "UTF-16BE")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("\\A[a-z]{2}\\z"), made(p)).otherwise(p)), "")


def paired_sql(text: str = "text") -> str:
    """The same in SQL."""
    made = f"chr(CAST({FIRST} + 26 * (ascii(p[1]) - 97) + ascii(p[2]) - 97 AS INTEGER))"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s)[a-z][a-z]|.'), lambda p: CASE WHEN length(p) = 2 THEN {made} ELSE p END), '')"
