"""Longest matches of large dictionaries over whole batches of text, in numpy.

Keys are paths from a root; a node and a character are one whole number, and a hash table leads to the next
node. The code points of a batch are laid end to end, and all places walk the trie together, a character at
a time, until none is left; no match runs across a break (the start of a text or of a segment). What is
looked at does not grow with the dictionary, and a dictionary is built once, before it is sent to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np

CODES = 0x110000
_SHIFT = 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def union(tables: Sequence[Mapping[str, str]]) -> dict[str, str]:
    """One table with the meaning of a chain: keys that an earlier table's shorter or equal key hides are left out.

    At each place the first table that matches wins, and in it the longest key. A later table's key that
    begins with an earlier one's key is never reached; of all others, the longest is the one that wins.
    """
    out: dict[str, str] = dict(tables[0]) if tables else {}
    for table in tables[1:]:
        held = set(out)
        sizes = sorted({len(k) for k in held})
        for key, value in table.items():
            if not any(key[:n] in held for n in sizes if n <= len(key)):
                out[key] = value
    return out


class _Steps:
    """Fixed keys with values in one hash table, looked up many at a time; 0 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, math.ceil(math.log2(2 * len(keys) + 1)) + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, rest = self.slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == -1]
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot[rest]] == keys[rest]
            self.values[slot[rest[mine]]] = values[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], 0)
        live = np.flatnonzero((there != keys) & (there != -1))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[live]]
            hit = there == keys[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (there != -1)]
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)


class Trie:
    """A set of keys, numbered in the order given."""

    def __init__(self, keys: Iterable[str]) -> None:
        words = [k for k in keys if k]
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes, first = code_points("".join(words)), np.concatenate([[0], np.cumsum(size)])[:-1]
        self.longest = int(size.max()) if len(size) else 0
        node, made = np.zeros(len(words), np.int64), 1
        froms, tos, self.root = [], [], np.zeros(CODES, np.int32)
        entry, parents = [np.full(1, -1)], [np.zeros(1, bool)]
        for depth in range(self.longest):
            live = np.flatnonzero(size > depth)
            step, inverse = np.unique((node[live] << _SHIFT) | codes[first[live] + depth], return_inverse=True)
            node[live] = made + inverse
            at = np.full(len(step), -1)
            last = live[size[live] == depth + 1]
            at[node[last] - made] = last
            entry.append(at)
            grows = np.zeros(len(step), bool)
            grows[node[live[size[live] > depth + 1]] - made] = True
            parents.append(grows)
            if depth:
                froms.append(step)
                tos.append(made + np.arange(len(step)))
            else:
                self.root[step] = made + np.arange(len(step))
            made += len(step)
        #: The key that ends at each node, and whether longer ones go on from it.
        self.entry, self.grows = np.concatenate(entry).astype(np.int32), np.concatenate(parents)
        self.steps = _Steps(np.concatenate(froms) if froms else np.zeros(0, np.int64), np.concatenate(tos) if tos else np.zeros(0, np.int64))

    def walk(self, codes: np.ndarray, breaks: np.ndarray):
        """(depth, places, keys) of all keys that begin at any place and do not run across a break, by length."""
        node = self.root[codes]
        at = np.flatnonzero(node)
        node = node[at]
        for depth in range(1, self.longest + 1):
            found = self.entry[node]
            hit = found >= 0
            yield depth, at[hit], found[hit]
            on = self.grows[node] & (at + depth < len(codes))
            at, node = at[on], node[on]
            on = ~breaks[at + depth]
            at, node = at[on], node[on].astype(np.int64)
            if not len(at):
                return
            node = self.steps.find((node << _SHIFT) | codes[at + depth])
            on = node > 0
            at, node = at[on], node[on]

    def longest_at(self, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each place (0: none), and its number."""
        size, key = np.zeros(len(codes), np.int32), np.full(len(codes), -1, np.int32)
        for depth, at, found in self.walk(codes, breaks):
            size[at], key[at] = depth, found
        return size, key

    def starts(self, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a token starts at each place, if the longest key is taken from left to right; with ``longest_at``."""
        size, key = self.longest_at(codes, breaks)
        start = np.ones(len(codes), bool)
        at = np.flatnonzero(size > 1)
        if len(at):
            end = at + size[at]
            # Keys that no earlier key reaches are taken; only the others depend on what was taken before them.
            reached = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
            taken = at >= reached
            doubtful = np.flatnonzero(~taken)
            if len(doubtful):
                first = np.searchsorted(np.flatnonzero(taken), doubtful) - 1
                stop, where, ends = 0, at.tolist(), end.tolist()
                leader = np.flatnonzero(taken)[first].tolist()
                last = -1
                for i, lead in zip(doubtful.tolist(), leader, strict=True):
                    if lead != last:
                        last, stop = lead, ends[lead]
                    if where[i] >= stop:
                        taken[i], stop = True, ends[i]
            at, end = at[taken], end[taken]
            inner = np.zeros(len(codes) + 1, np.int32)
            inner[at + 1] += 1
            inner[end] -= 1
            start = np.cumsum(inner[:-1]) == 0
        return start, size, key


#: Characters that one pass takes at once; bounds a task's memory (single texts may exceed it).
PASS_CHARS = 1 << 18


def passes(texts: Sequence[str], limit: int | None = None) -> Iterator[Sequence[str]]:
    """Runs of texts of about ``limit`` characters."""
    limit = limit or PASS_CHARS
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield texts[start:i]
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield texts[start:]


class Batch:
    """Texts laid end to end: their code points, and where a text or a segment starts."""

    def __init__(self, texts: Sequence[str]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = code_points("".join(texts))
        self.ends = np.cumsum(sizes)
        self.breaks = np.zeros(len(self.codes), bool)
        starts = self.ends - sizes
        self.breaks[starts[starts < len(self.codes)]] = True

    def texts(self) -> list[str]:
        whole = self.codes.astype("<u4").tobytes().decode("utf-32-le")
        ends = self.ends.tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def words(self) -> list[list[str]]:
        """Each text cut at its breaks."""
        whole = self.codes.astype("<u4").tobytes().decode("utf-32-le")
        cuts = np.flatnonzero(self.breaks)
        stops = np.append(cuts[1:], len(self.codes))[: len(cuts)].tolist()
        pieces = [whole[a:b] for a, b in zip(cuts.tolist(), stops, strict=True)]
        at = np.searchsorted(cuts, self.ends).tolist()
        return [pieces[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def counts(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(np.searchsorted(np.flatnonzero(self.breaks), self.ends), prepend=0)


class Converter:
    """Replaces the longest keys of a chain of tables, from left to right, once; other characters stay."""

    def __init__(self, tables: Sequence[Mapping[str, str]], before: Mapping[str, str] | None = None) -> None:
        """``before`` maps single characters to single characters ahead of all else."""
        self.table = union(tables)
        words = [k for k in self.table if k]
        self.trie = Trie(words)
        targets = [self.table[k] for k in words]
        self.size = np.fromiter(map(len, targets), np.int64, len(targets))
        self.pool, self.first = code_points("".join(targets)), np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.before = None
        if before:
            self.before = np.arange(CODES, dtype=np.int32)
            for k, v in before.items():
                self.before[ord(k)] = ord(v)

    def apply(self, batch: Batch) -> np.ndarray:
        """Convert in place; breaks keep their places between what they divide. Whether each text has a key whose value has another length."""
        uneven = np.zeros(len(batch.ends), bool)
        if self.before is not None:
            batch.codes = self.before[batch.codes]
        n = len(batch.codes)
        if not n:
            return uneven
        start, size, key = self.trie.starts(batch.codes, batch.breaks)
        at = np.flatnonzero(start)
        key = key[at]
        if not (key >= 0).any():
            return uneven
        source = np.where(key >= 0, n + self.first[key], at)
        count = np.where(key >= 0, self.size[key], 1)
        ends = np.cumsum(count)
        other = at[count != np.diff(at, append=n)]
        uneven[np.searchsorted(batch.ends, other, side="right")] = True
        pool = np.concatenate([batch.codes, self.pool])
        out = pool[np.arange(ends[-1]) + np.repeat(source - (ends - count), count)]
        # Where what starts at a token goes: a break before a token stays before what the token became.
        place = np.concatenate([[0], ends])
        token_of = np.searchsorted(at, np.append(np.flatnonzero(batch.breaks), n))
        moved = place[token_of[:-1]]
        batch.ends = place[np.searchsorted(at, batch.ends)]
        batch.codes, batch.breaks = out, np.zeros(len(out), bool)
        batch.breaks[moved[moved < len(out)]] = True
        return uneven

    def with_lengths(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The converted texts, and whether each has a key whose value has another length."""
        out: list[str] = []
        uneven = [np.zeros(0, bool)]
        for part in passes(texts):
            batch = Batch(part)
            uneven.append(self.apply(batch))
            out += batch.texts()
        return out, np.concatenate(uneven)

    def tokens(self, text: str) -> list[tuple[str, str]]:
        """(source, target) pieces of one text in order; copied characters map to themselves."""
        batch = Batch([text])
        if self.before is not None:
            batch.codes = self.before[batch.codes]
        text = batch.texts()[0]
        start, _, _ = self.trie.starts(batch.codes, batch.breaks)
        at = [*np.flatnonzero(start).tolist(), len(text)]
        return [(text[a:b], self.table.get(text[a:b], text[a:b])) for a, b in zip(at, at[1:], strict=False)]

    def __call__(self, texts: Sequence[str]) -> list[str]:
        return self.with_lengths(texts)[0]

    def convert(self, text: str | None) -> str | None:
        return self([text])[0] if text else text


class MaxMatch:
    """Cuts texts into longest words from left to right; characters that start none stand alone."""

    def __init__(self, words: Iterable[str]) -> None:
        self.trie = Trie(sorted(set(words)))

    def cut(self, batch: Batch) -> None:
        """Sets the breaks of a batch."""
        if len(batch.codes):
            batch.breaks = self.trie.starts(batch.codes, batch.breaks)[0]

    def __call__(self, text: str) -> list[str]:
        return cut_one(self, text)


def cut_one(cutter, text: str) -> list[str]:
    """The words of one text by a batch cutter."""
    batch = Batch([text])
    cutter.cut(batch)
    return batch.words()[0]
