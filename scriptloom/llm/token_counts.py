"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only.

Long texts are split at safe boundaries: a single space between two characters that are not white
space always starts a new pre-token, so the parts' counts add up to the text's. Parts are encoded in
batches of about equal bytes, each distinct part of a worker's recent past once. Sentencepiece models, in
which spaces are ordinary characters, are cut at the same places where no piece of theirs crosses a space
(and where the text does not hold their mark for one); other models get whole texts.

Edge cases: a null or empty text has no bytes and no tokens; texts of any length are counted whole;
special strings inside texts are handled as the library does by default; repeated rows give repeated
results; an empty table gives an empty result; a null doc_id is carried through; other columns of the
input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Bytes of text in one call of the library; parts remembered by one worker before it starts anew.
BATCH_BYTES, MEMO_ENTRIES = 256 << 10, 400_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: What sentencepiece writes for a space.
MARK = "\u2581"
#: White space next to white space, or at either end of a text.
_uneven = re.compile(r"\s\s|\A\s|\s\Z")


def parts_of(text: str, also: str = "") -> list[str]:
    """The text cut before each single space between characters that are neither white space nor in ``also``."""
    pieces = text.split(" ")
    if not _uneven.search(text) and not any(x in text for x in also):
        return [pieces[0], *[" " + p for p in pieces[1:]]] if pieces[0] else []
    out = [pieces[0]]
    for p in pieces[1:]:
        if p and not p[0].isspace() and p[0] not in also and out[-1] and not out[-1][-1].isspace() and out[-1][-1] not in also:
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class Counter:
    """Counts of one tokenizer file, with a bounded memo of parts."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.memo: dict[str, int] = {}
        self.whole, self.also, self.bare = False, "", False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            # The model puts its mark for a space before a text, and no piece holds one behind other characters: a
            # part without its space is encoded as it is inside the text. Other models get whole texts.
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            self.also, self.bare = MARK, True
            self.whole = any(MARK in x.lstrip(MARK) for x in pieces) or model.encode("x", out_type=str)[0][:1] != MARK
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def batched(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
        for a, b in common.slices(sizes, BATCH_BYTES):
            out += self.lengths(texts[a:b])
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        if self.whole:
            return self.batched([t or "" for t in texts])
        memo, split = self.memo, [parts_of(t, self.also) if t else [] for t in texts]
        if self.bare:
            split = [[*parts[:1], *[p[1:] for p in parts[1:]]] for parts in split]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = list({p for parts in split for p in parts if p not in memo})
        memo.update(zip(new, self.batched(new), strict=True))
        return [sum(map(memo.__getitem__, parts)) for parts in split]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per document: bytes, tokens, and whether there are more than ``limit`` tokens."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = common.vocabulary(name, folder)
        common.enter("token_counts", _counters.clear)
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batch_iter:
            column = batch.column(1)
            for a, b, _, offsets in common.text_passes(column):
                counts = np.array(counter.count(column.slice(a, b - a).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], schema=SCHEMA)

    common.tune(docs.sparkSession)
    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).transform(common.in_arrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
