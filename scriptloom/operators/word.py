"""DOCX conversion, bytes to bytes, with the standard library.

A paragraph is converted as one text, and its runs keep their formatting: each converted piece goes to
the run in which its source begins, character by character where lengths agree, so that an expanded
character never loses a part. Notes are converted run by run, as are texts outside paragraphs.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable
from itertools import accumulate

from scriptloom.functions.convert import Matcher
from scriptloom.functions.trie import Converter

_gate = re.compile("[一-鿿]")
_piece = re.compile(r"(<w:p(?:\s[^>]*)?(?<!/)>)|(</w:p>)|(<w:t(?:\s[^>]*)?(?<!/)>)([^<]*)</w:t>")
_text = re.compile(r"(<w:t(?:\s[^>]*)?(?<!/)>)([^<]*)(</w:t>)")
#: Parts of a document: body, headers and footers by paragraph; notes by run.
_body = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml")
_notes = re.compile(r"word/(?:footnotes|endnotes)\.xml")


def spread(pieces: list[tuple[str, str]], ends: list[int]) -> list[str]:
    """Targets of (source, target) pieces dealt out to runs that end at the given source offsets."""
    out, at, run = [""] * len(ends), 0, 0
    for source, target in pieces:
        even = len(source) == len(target)
        for k in range(len(source) if even else 1):
            while run < len(ends) - 1 and at + k >= ends[run]:
                run += 1
            out[run] += target[k] if even else target
        at += len(source)
    return out


def convert_runs(texts: list[str], matcher: Matcher | Converter, keep_format: bool = True) -> list[str]:
    """Texts of a paragraph's runs; without CJK characters nothing changes."""
    return convert_paragraphs([texts], matcher, keep_format)[0]


def convert_paragraphs(paragraphs: list[list[str]], matcher: Matcher | Converter, keep_format: bool = True) -> list[list[str]]:
    """The runs of many paragraphs, converted together: equal lengths are cut where the runs end, others dealt out by piece."""
    full = ["".join(texts) for texts in paragraphs]
    live = [k for k, text in enumerate(full) if text.strip() and _gate.search(text)]
    given = [full[k] for k in live]
    if isinstance(matcher, Converter):
        new, uneven = matcher.with_lengths(given)
    else:
        new, uneven = [matcher.convert(t) for t in given], [True] * len(given)
    out = list(paragraphs)
    for k, text, odd in zip(live, new, uneven, strict=True):
        texts = paragraphs[k]
        if not keep_format:
            target = next((i for i, t in enumerate(texts) if t.strip()), 0)
            out[k] = texts if text == full[k] else [text if i == target else "" for i in range(len(texts))]
            continue
        ends = list(accumulate(map(len, texts)))
        out[k] = spread(list(matcher.tokens(full[k])), ends) if odd else [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return out


def _put(start: str, text: str) -> str:
    start = start if "xml:space" in start or text == text.strip() else start[:-1] + ' xml:space="preserve">'
    return start + html.escape(text, quote=False) + "</w:t>"


def _rewrite(xml: str, change: Callable[[list[str]], list[str]]) -> str:
    """All texts of a part changed as one list."""
    new = iter(change([html.unescape(t) for _, t, _ in _text.findall(xml)]))
    return _text.sub(lambda m: _put(m[1], next(new)), xml)


def _by_paragraph(xml: str, change: Callable[[list[str]], list[str]]) -> str:
    """Each paragraph's own texts changed as one list."""
    return _paragraphs(xml, lambda all_: [change(own) for own in all_])


def _paragraphs(xml: str, change: Callable[[list[list[str]]], list[list[str]]]) -> str:
    """All paragraphs changed at once, each by its own texts; those of paragraphs inside it (text boxes) are apart."""
    open_: list[list[tuple[int, int, str, str]]] = []
    closed: list[list[tuple[int, int, str, str]]] = []
    for m in _piece.finditer(xml):
        if m[1]:
            open_.append([])
        elif m[2] and open_:
            closed.append(open_.pop())
        elif m[3] and open_:
            open_[-1].append((m.start(), m.end(), m[3], m[4]))
    new = change([[html.unescape(t) for _, _, _, t in own] for own in closed])
    done = [(a, b, _put(start, text)) for own, texts in zip(closed, new, strict=True) for (a, b, start, _), text in zip(own, texts, strict=True)]
    out, at = [], 0
    for a, b, text in sorted(done):
        out += [xml[at:a], text]
        at = b
    return "".join([*out, xml[at:]])


def convert_docx(content: bytes, matcher: Matcher | Converter, keep_format: bool = True, notes: bool = True) -> bytes:
    source, sink = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()

    def by_run(texts: list[str]) -> list[str]:
        if not isinstance(matcher, Converter):
            return [matcher.convert(t) if _gate.search(t) else t for t in texts]
        live = [k for k, t in enumerate(texts) if _gate.search(t)]
        found = dict(zip(live, matcher([texts[k] for k in live]), strict=True))
        return [found.get(k, t) for k, t in enumerate(texts)]

    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        for entry in source.infolist():
            raw = source.read(entry)
            if _body.fullmatch(entry.filename):
                raw = _paragraphs(raw.decode(), lambda t: convert_paragraphs(t, matcher, keep_format)).encode()
            elif notes and _notes.fullmatch(entry.filename):
                raw = _rewrite(raw.decode(), by_run).encode()
            out.writestr(entry, raw)
    return sink.getvalue()
