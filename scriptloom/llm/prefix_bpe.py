"""BPE by dynamic programming over prefixes: the last token of every prefix, found once, and followed back.

The encoding of a prefix has exactly one last token, so a word is encoded from left to right: at each
letter an automaton over the vocabulary gives the tokens that end there, longest first, and the first of
them that can stand behind the last token of the prefix before it is the one. Two tokens can stand side by
side if no merge across their border comes before the merges that made them: the tokens that ever touched
the border are the right edge of the first one's merge tree and the left edge of the second one's. Work is
linear in the text whatever it holds; nothing is merged and no pair is searched for.

Texts are cut into words at white space (see ``packing.words_of``); the tokenizer's own normaliser and
pre-tokeniser cut words into pre-tokens, and each distinct word of a worker's recent past is encoded once.
Short pre-tokens are encoded many at a time, letter by letter in step; long ones alone.

Edge cases: a null or empty text has no ids and decodes to the empty text; texts of any length are encoded
whole; special strings inside texts get their ids, as the library does by default; repeated rows give
repeated results; an empty table gives an empty result; a null doc_id is carried through; other columns,
whatever their names, are ignored. Ids that the vocabulary lacks decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import common, packing

#: Pre-tokens up to so many bytes are encoded in step, at most so many at once; longer ones are encoded alone.
STEP_BYTES, STEP_WORDS = 48, 1 << 15
#: Pairs whose answer a worker remembers before it starts anew.
MEMO_PAIRS = 1 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: A letter is a byte, or a byte at the end of a word; a key of the automaton is a state and a letter.
LETTERS = 512
NEVER = 1 << 30


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Lookup:
    """Fixed whole-number keys with values, looked up many at a time; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == -1]
            self.keys[slot[free]] = keys[free]
            placed = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[placed]] = values[placed]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * common.GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        live = np.flatnonzero((there != keys) & (there != -1))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[live]]
            hit = there == keys[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (there != -1)]
        return out


class PrefixBPE:
    """Encodes pre-tokens (bytes) by a vocabulary and its merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        value = {c: b for b, c in enumerate(byte_characters())}
        count = max(vocabulary.values()) + 1
        self.order, self.left, self.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        pairs = np.zeros((len(merges), 2), np.int64)
        for rank, (a, b) in enumerate(merges):
            made = vocabulary[a + b]
            if self.left[made] >= 0:
                raise ValueError(f"two merges make {a + b!r}: the last token of a prefix is not unique")
            pairs[rank] = vocabulary[a], vocabulary[b]
            self.order[made], self.left[made], self.right[made] = rank, *pairs[rank]
        self.merged = Lookup(pairs[:, 0] * count + pairs[:, 1], np.arange(len(merges)))
        self.rank_of = {(a, b): rank for rank, (a, b) in enumerate(pairs.tolist())}
        self.count, self.size = count, np.zeros(count, np.int64)
        spelled: dict[int, list[int]] = {}
        for token, i in vocabulary.items():
            ends = bool(suffix) and token.endswith(suffix)
            letters = [value.get(c, -1) for c in (token[: -len(suffix)] if ends else token)]
            if letters and min(letters) >= 0 and (self.left[i] >= 0 or len(letters) == 1):
                spelled[i] = [*letters[:-1], letters[-1] + 256 * ends]
                self.size[i] = len(letters)
        self.suffix = bool(suffix)
        self._automaton(spelled)
        self.known: dict[tuple[int, int], bool] = {}
        # A token that does not encode to itself never occurs, not even at the start of a word.
        self.whole = np.zeros(count, bool)
        for i in sorted(spelled, key=self.order.__getitem__):
            a, b = int(self.left[i]), int(self.right[i])
            self.whole[i] = a < 0 or self.whole[a] and self.whole[b] and self._beside(a, b, int(self.order[i]))
        lone = [i for i in range(LETTERS if suffix else 256) if self.next_of.get(i, 0) == 0]
        if lone:
            raise ValueError("the vocabulary lacks letters")

    def _automaton(self, spelled: dict[int, list[int]]) -> None:
        """Tokens as paths from a root; each state's longest token that ends there, each token's next shorter one."""
        step: dict[int, int] = {}
        parent, letter, depth, token = [0], [0], [0], [-1]
        at: dict[int, int] = {}
        for i, letters in spelled.items():
            state = 0
            for x in letters:
                key = state * LETTERS + x
                if key not in step:
                    step[key] = len(parent)
                    parent.append(state)
                    letter.append(x)
                    depth.append(depth[state] + 1)
                    token.append(-1)
                state = step[key]
            token[state], at[i] = i, state
        fail = [0] * len(parent)
        longest = list(token)
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[state] > 1:
                back = fail[parent[state]]
                while back and back * LETTERS + letter[state] not in step:
                    back = fail[back]
                fail[state] = step.get(back * LETTERS + letter[state], 0)
            if longest[state] < 0:
                longest[state] = longest[fail[state]]
        self.next_of, self.fail_of = step, fail
        self.fail, self.longest, self.shorter = np.array(fail), np.array(longest), np.full(self.count, -1, np.int64)
        for i, state in at.items():
            self.shorter[i] = longest[fail[state]]
        self.step = Lookup(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))

    def _beside(self, x: int, y: int, before: int = NEVER) -> bool:
        """Whether no merge across the border of x and y comes before ``before``, or before what it would merge is merged otherwise."""
        order, left, right, rank_of = self.order, self.left, self.right, self.rank_of
        x_ends = y_ends = before
        while True:
            rank = rank_of.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank != before:
                return False
            # Back in time: what was made last comes apart.
            if order[x] < 0 and order[y] < 0:
                return True
            if order[x] > order[y]:
                x_ends, x = int(order[x]), int(right[x])
            else:
                y_ends, y = int(order[y]), int(left[y])

    def beside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same for many pairs."""
        out = np.ones(len(x), bool)
        live, x, y = np.arange(len(x)), x.copy(), y.copy()
        x_ends, y_ends = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(live):
            rank = self.merged.find(x * self.count + y)
            bad = (rank >= 0) & (rank < x_ends) & (rank <= y_ends)
            out[live[bad]] = False
            made_x, made_y = self.order[x], self.order[y]
            go = np.flatnonzero(~bad & ((made_x >= 0) | (made_y >= 0)))
            live, x, y, x_ends, y_ends, made_x, made_y = live[go], x[go], y[go], x_ends[go], y_ends[go], made_x[go], made_y[go]
            first = made_x > made_y
            x_ends, y_ends = np.where(first, made_x, x_ends), np.where(first, y_ends, made_y)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def one(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        if len(self.known) > MEMO_PAIRS:
            self.known.clear()
        known, step, fail, longest, size, shorter, whole = self.known, self.next_of, self.fail_of, self.longest, self.size, self.shorter, self.whole
        last, state, end = [-1], 0, len(word)
        for n, x in enumerate(word, 1):
            x += 256 * (self.suffix and n == end)
            while state and state * LETTERS + x not in step:
                state = fail[state]
            state = step.get(state * LETTERS + x, 0)
            token = int(longest[state])
            while True:
                begin = n - int(size[token])
                if not begin:
                    if whole[token]:
                        break
                else:
                    pair = last[begin], token
                    if pair not in known:
                        known[pair] = self._beside(*pair)
                    if known[pair]:
                        break
                token = int(shorter[token])
            last.append(token)
        out = []
        while end:
            out.append(last[end])
            end -= int(size[last[end]])
        return out[::-1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens in order of length, how many each has, and where each stands in ``words``."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], STEP_BYTES, side="right"))
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, short, STEP_WORDS):
            found, n = self.many([words[i] for i in order[a : min(short, a + STEP_WORDS)].tolist()])
            ids.append(found)
            sizes.append(n)
        for i in order[short:].tolist():
            ids.append(np.array(self.one(words[i]), np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(sizes), order

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; words of about one length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        length = size[order]
        width = int(length[0])
        letters = np.zeros((len(words), width), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(width) < length[:, None]
        letters[inside] = flat[(start[order][:, None] + np.arange(width))[inside]]
        if self.suffix:
            letters[np.arange(len(words)), length - 1] += 256
        last = np.full((len(words), width + 1), -1, np.int64)
        state = np.zeros(len(words), np.int64)
        for n in range(1, width + 1):
            live = int(np.searchsorted(-length, -n, side="right"))
            state = self._stepped(state[:live], letters[:live, n - 1])
            rest, token = np.arange(live), self.longest[state]
            while len(rest):
                begin = n - self.size[token]
                good = self.whole[token].copy()
                inner = np.flatnonzero(begin > 0)
                good[inner] = self.beside(last[rest[inner], begin[inner]], token[inner])
                last[rest[good], n] = token[good]
                rest, token = rest[~good], self.shorter[token[~good]]
        # Back-pointers: the last token of the word, then that of what comes before it.
        found, rows, end = [], [], length.copy()
        live = np.arange(len(words))
        while len(live):
            token = last[live, end[live]]
            found.append(token)
            rows.append(live)
            end[live] -= self.size[token]
            live = live[end[live] > 0]
        tokens, row = np.concatenate(found[::-1]), order[np.concatenate(rows[::-1])]
        return tokens[np.argsort(row, kind="stable")].astype(np.uint32), np.bincount(row, minlength=len(words))

    def _stepped(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.step.find(state * LETTERS + letter).astype(np.int64)
        live = np.flatnonzero(out < 0)
        at = self.fail[state[live]]
        while len(live):
            found = self.step.find(at * LETTERS + letter[live])
            out[live] = found
            again = found < 0
            live, at = live[again], self.fail[at[again]]
        return out


class PrefixTokenizer(packing.WordTokenizer):
    """Whole texts by a tokenizer file: the library's normaliser and pre-tokeniser, and prefixes instead of merges."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        model = data["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or data.get("decoder"):
            raise ValueError(f"{path}: a tokenizer of another kind")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.bpe = PrefixBPE(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.apart = re.compile("|".join(f"({re.escape(x)})" for x in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.byte = {ord(c): b for b, c in enumerate(byte_characters())}
        tokens = {i: t for t, i in self.model.get_vocab().items()}
        spans = range(max(tokens) + 1)
        #: Each id with a blank before it, in digits and as its token; ids without a token are not joined.
        self.digits = pa.array([b" %d" % i for i in spans], pa.large_binary())
        self.spelling = pa.array([b" " + tokens[i].encode() if i in tokens else b"" for i in spans], pa.large_binary())

    def pieces(self, word: str) -> list[bytes | int]:
        """Pre-tokens of a word as bytes, special strings as their ids."""
        out: list[bytes | int] = []
        for part in self.apart.split(word) if "<" in word else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                cut = self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(part))
                out += [p.translate(self.byte).encode("latin-1") for p, _ in cut]
        return out

    def learn(self, new: list[bytes]) -> None:
        """Words of Latin letters alone are one pre-token each; the library cuts the others."""
        words = [w.decode() for w in new]
        plain = np.fromiter((w.isalpha() and (w.isascii() or max(w) < packing.LATIN_END) for w in words), bool, len(words))
        given = np.flatnonzero(plain)
        ids, sizes, order = self.bpe.encode([words[i].lower().encode() for i in given.tolist()])
        others = np.flatnonzero(~plain).tolist()
        split = [self.pieces(words[i]) for i in others]
        distinct = list({p for pieces in split for p in pieces if isinstance(p, bytes)})
        found, lengths, at = self.bpe.encode(distinct)
        flat, ends = found.tolist(), np.cumsum(lengths).tolist()
        of = {distinct[k]: flat[b:e] for k, b, e in zip(at.tolist(), [0, *ends[:-1]], ends, strict=True)} if distinct else {}
        rest = [[x for p in pieces for x in ([p] if isinstance(p, int) else of[p])] for pieces in split]
        taken = [*given[order].tolist(), *others]
        self.place.update(zip([new[i] for i in taken], range(len(self.place), len(self.place) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids, np.array([x for each in rest for x in each], np.uint32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([*sizes.tolist(), *map(len, rest)])])


_tokenizers: dict[str, PrefixTokenizer] = {}


def _tokenizer(name: str, folder: str | None) -> PrefixTokenizer:
    common.enter("prefix_bpe", _tokenizers.clear)
    path = common.vocabulary(name, folder)
    return _tokenizers.get(path) or _tokenizers.setdefault(path, PrefixTokenizer(path))


def joined(pool: pa.Array, ids: np.ndarray, first: np.ndarray) -> list[memoryview]:
    """Bytes of each row's ids by ``pool``, joined by one blank."""
    text = pool.take(pa.array(ids))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(ids) + 1]
    data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
    ends = offsets[first].tolist()
    return [data[a + 1 : b] if b > a else data[:0] for a, b in zip(ends, ends[1:], strict=False)]


def _over(docs: DataFrame, name: str, folder: str | None, row, ddl: str) -> DataFrame:
    """Rows of ``docs`` (doc_id, text), encoded in passes."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(name, folder)
        for batch in batch_iter:
            for a, b, data, offsets in common.text_passes(batch.column(1), packing.PASS_BYTES):
                yield row(coder, batch.column(0).slice(a, b - a).cast(pa.int64()), *coder.encode(data, offsets))

    common.tune(docs.sparkSession)
    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).transform(common.in_arrow, run, ddl)


def encode(docs: DataFrame, name: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of each document."""

    def row(coder: PrefixTokenizer, doc_ids: pa.Array, ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, lists], schema=IDS_SCHEMA)

    return _over(docs, name, folder, row, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """(doc_id, decoded) of each row of ``encoded`` (doc_id, ids): its tokens joined by blanks; null ids give the empty text."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(name, folder)
        for batch in batch_iter:
            rows = [[x for x in row or () if x is not None and 0 <= x < len(coder.spelling)] for row in batch.column(1).to_pylist()]
            ids, first = np.array([x for row in rows for x in row], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = [bytes(x).decode() for x in joined(coder.spelling, ids, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).transform(common.in_arrow, run, "doc_id long, decoded string")


def digests(docs: DataFrame, name: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids and of what they decode to."""

    def row(coder: PrefixTokenizer, doc_ids: pa.Array, ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in joined(pool, ids, first)], pa.string()) for pool in (coder.digits, coder.spelling)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(first)), *hashes], schema=SCHEMA)

    return _over(docs, name, folder, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
