"""Word segmentation: maximum matching, BEMS Viterbi decoding, and a word graph with frequencies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scriptloom.functions import trie
from scriptloom.functions.dictionary import BROADCAST_KEYS
from scriptloom.functions.pieces import by_row, piecewise

LOWEST = -3.14e100
STATES = "BEMS"
#: States that may come before each state.
BEFORE = {"B": "ES", "M": "MB", "S": "SE", "E": "BM"}


def max_match(text: str, words: Sequence[str] | set[str]) -> list[str]:
    """Greedy longest words of one text; characters that start none stand alone."""
    return trie.MaxMatch(words)(text)


#: The same by the bits that say which of the two it was.
_BEFORE = [STATES.index(BEFORE[state][came >> k & 1]) for came in range(16) for k, state in enumerate(STATES)]
_LETTER = STATES.encode() + bytes(252)


@dataclass(frozen=True)
class HiddenMarkov:
    """Log chances of the four positions of a character in its word."""

    start: dict[str, float]
    trans: dict[str, dict[str, float]]
    emit: dict[str, dict[str, float]]

    @classmethod
    def parse(cls, lines: Sequence[str]) -> HiddenMarkov:
        """Data lines in order: start row, four transition rows, four emission rows of ``char:log`` by commas."""
        rows = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
        start = dict(zip(STATES, map(float, rows[0].split()), strict=True))
        trans = {s: dict(zip(STATES, map(float, rows[1 + i].split()), strict=True)) for i, s in enumerate(STATES)}
        emit = {}
        for i, s in enumerate(STATES):
            pairs = (x.rpartition(":") for x in rows[5 + i].split(",") if x)
            emit[s] = {k: float(v) for k, _, v in pairs if k}
        return cls(start, trans, emit)

    def _steps(self) -> tuple[float, ...]:
        return tuple(self.trans[p].get(s, LOWEST) for p, s in ("EB", "SB", "BE", "ME", "MM", "BM", "SS", "ES"))

    def _classes(self) -> np.ndarray:
        """For each character, which states can emit it, a bit each."""
        if not hasattr(self, "_emitted"):
            masks = np.zeros(trie.CODES, np.uint8)
            for k, s in enumerate(STATES):
                masks[[ord(c) for c in self.emit[s] if len(c) == 1]] |= 1 << k
            object.__setattr__(self, "_emitted", masks)
            # Numbers of distances, and for each and each mask the next one's number and the bits, or -1.
            object.__setattr__(self, "_numbers", {})
            object.__setattr__(self, "_moves", [])
        return self._emitted

    def _number(self, behind: tuple[int, ...]) -> int:
        if behind not in self._numbers:
            self._numbers[behind] = len(self._moves)
            self._moves.extend([-1] * 16)
        return self._numbers[behind]

    def _move(self, number: int, mask: int) -> int:
        """How many impossible steps each state is behind the best one after a character, and whether it came from the second state before it."""
        b, e, m, s = next(k for k, v in self._numbers.items() if v == number)
        came = (s < e) | (m < b) << 1 | (b < m) << 2 | (e < s) << 3
        new = [least + (not mask >> k & 1) for k, least in enumerate((min(e, s), min(b, m), min(m, b), min(s, e)))]
        found = self._number(tuple(x - min(new) for x in new)) | came
        self._moves[number | mask] = found
        return found

    def states(self, text: str) -> str:
        """The most probable states; the last is E or S.

        Once no state is possible any more, chances are whole numbers of impossible steps: what is small is
        lost beside them. From there on the states' distances are all that counts; there are few of them, and
        their moves are looked up.
        """
        if not text:
            return ""
        get_b, get_e, get_m, get_s = (self.emit[s].get for s in STATES)
        eb, sb, be, me, mm, bm, ss, es = self._steps()
        b, e, m, s = (self.start[x] + self.emit[x].get(text[0], LOWEST) for x in STATES)
        absorbing = max(map(abs, (eb, sb, be, me, mm, bm, ss, es))) < 1e80
        # Whether each state came from the second of those that may come before it, a bit each.
        back, size, i = bytearray(len(text)), len(text), 1
        while i < size and not (absorbing and max(b, e, m, s) < -1e99):
            char = text[i]
            came = 0
            to_b, other = e + eb, s + sb
            if other > to_b:
                to_b, came = other, 1
            to_e, other = b + be, m + me
            if other > to_e:
                to_e, came = other, came | 2
            to_m, other = m + mm, b + bm
            if other > to_m:
                to_m, came = other, came | 4
            to_s, other = s + ss, e + es
            if other > to_s:
                to_s, came = other, came | 8
            b, e, m, s = to_b + get_b(char, LOWEST), to_e + get_e(char, LOWEST), to_m + get_m(char, LOWEST), to_s + get_s(char, LOWEST)
            back[i] = came
            i += 1
        last = "S" if s > e else "E"
        if i < size:
            masks = self._classes()[trie.code_points(text[i:])].tobytes()
            steps = [round(x / LOWEST) for x in (b, e, m, s)]
            number = self._number(tuple(x - min(steps) for x in steps))
            moves = self._moves
            for i, mask in enumerate(masks, i):  # noqa: B020
                found = moves[number | mask]
                if found < 0:
                    found = self._move(number, mask)
                back[i] = found & 15
                number = found & ~15
            behind = next(k for k, v in self._numbers.items() if v == number)
            last = "S" if behind[3] < behind[1] else "E"
        out, before, state = bytearray(size), _BEFORE, STATES.index(last)
        out[-1] = state
        i = size - 1
        while i:
            state = before[back[i] << 2 | state]
            i -= 1
            out[i] = state
        return out.translate(_LETTER).decode()

    def cut(self, text: str) -> list[str]:
        ends = [i for i, state in enumerate(self.states(text), 1) if state in "ES"]
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def count(self, text: str) -> int:
        """How many words ``cut`` makes."""
        states = self.states(text)
        return states.count("E") + states.count("S")


class Viterbi:
    """The same model over many runs of characters in step, in numpy."""

    def __init__(self, model: HiddenMarkov) -> None:
        chars = sorted({k for s in STATES for k in model.emit[s] if len(k) == 1})
        self.place = np.zeros(trie.CODES, np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.emit = np.full((len(chars) + 1, 4), LOWEST)
        for k, s in enumerate(STATES):
            for c, v in model.emit[s].items():
                if len(c) == 1:
                    self.emit[self.place[ord(c)], k] = v
        self.start = np.array([model.start[s] for s in STATES])
        # For each state, the two that may come before it, and the steps from them.
        self.first, self.second = ([STATES.index(BEFORE[s][k]) for s in STATES] for k in (0, 1))
        self.step = [np.array([model.trans[BEFORE[s][k]].get(s, LOWEST) for s in STATES]) for k in (0, 1)]

    def breaks(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        """Marks in ``out`` where a word starts inside each run of places."""
        if not len(starts):
            return
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        now = self.start + self.emit[self.place[codes[starts]]]
        back = [np.zeros((0, 4), bool)]
        for n in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -n, side="left"))
            held = now[:live]
            one, two = held[:, self.first] + self.step[0], held[:, self.second] + self.step[1]
            later = two > one
            back.append(later)
            now = now.copy()
            now[:live] = np.where(later, two, one) + self.emit[self.place[codes[starts[:live] + n]]]
        state = np.where(now[:, 3] > now[:, 1], 3, 1)
        first, second = np.array(self.first), np.array(self.second)
        for n in range(int(size[0]) - 1, 0, -1):
            live = len(back[n])
            held = state[:live]
            state[:live] = np.where(back[n][np.arange(live), held], second[held], first[held])
            ended = (state[:live] == 1) | (state[:live] == 3)
            out[starts[:live][ended] + n] = True
        out[starts] = True


class GraphCut:
    """The most probable path through the words of a frequency dictionary, for whole batches; built once.

    At each place the words that begin there are found by one walk of a trie. A stretch that words tie
    together is settled from its end, all stretches of a batch in step; between stretches nothing depends on
    anything. Single characters in a row go to the model, if there is one. Ties go to the longer word.
    """

    def __init__(self, frequency: dict[str, int], model: HiddenMarkov | None = None) -> None:
        words = [w for w in frequency if w]
        self.trie = trie.Trie(words)
        total = math.log(max(1, sum(frequency.values())))
        self.chance = np.array([math.log(frequency[w] or 1) - total for w in words] or [0.0])
        self.lone = math.log(1) - total
        self.model = Viterbi(model) if model is not None else None

    def cut(self, batch: trie.Batch) -> None:
        """Sets the breaks of a batch."""
        codes, n = batch.codes, len(batch.codes)
        if not n:
            return
        single, longer = np.full(n, self.lone), []
        tied = np.zeros(n + 1, np.int32)
        for depth, at, found in self.trie.walk(codes, batch.breaks):
            if depth == 1:
                single[at] = self.chance[found]
            else:
                longer.append((depth, at, self.chance[found]))
                tied[:n] += np.bincount(at + 1, minlength=n + 1)[:n].astype(np.int32)
                tied -= np.bincount(at + depth, minlength=n + 1).astype(np.int32)
        # A stretch starts wherever no word runs across; most are single characters.
        stretch = np.cumsum(tied[:n]) == 0
        begin = np.flatnonzero(stretch)
        stop = np.append(begin[1:], n)
        size = np.ones(n, np.int32)
        many = stop - begin > 1
        begin, stop = begin[many], stop[many]
        if len(begin):
            order = np.argsort(begin - stop, kind="stable")
            stop, width = stop[order], (stop - begin)[order]
            # Words by the place they start at, shortest first.
            depth = np.concatenate([np.full(len(at), d) for d, at, _ in longer])
            at = np.concatenate([x for _, x, _ in longer])
            chance = np.concatenate([x for _, _, x in longer])
            by = np.lexsort((depth, at))
            depth, at, chance = depth[by], at[by], chance[by]
            first = np.searchsorted(at, np.arange(n + 1))
            best = np.zeros(n + 1)
            for step in range(1, int(width[0]) + 1):
                place = stop[: int(np.searchsorted(-width, -step, side="right"))] - step
                value, length = single[place] + (best[place + 1] if step > 1 else 0.0), np.ones(len(place), np.int32)
                count, k = first[place + 1] - first[place], 0
                live = np.flatnonzero(count > 0)
                while len(live):
                    word = first[place[live]] + k
                    other = chance[word] + np.where(depth[word] == step, 0.0, best[place[live] + depth[word]])
                    better = other >= value[live]
                    value[live[better]], length[live[better]] = other[better], depth[word[better]]
                    k += 1
                    live = live[count[live] > k]
                best[place], size[place] = value, length
        start = np.zeros(n, bool)
        self._follow(start, size, stretch)
        if self.model is not None:
            self._settle(codes, start, size, stretch, batch.breaks)
        batch.breaks = start

    def __call__(self, text: str) -> list[str]:
        return trie.cut_one(self, text)

    @staticmethod
    def _follow(start: np.ndarray, size: np.ndarray, stretch: np.ndarray) -> None:
        """Marks the words of the best paths, all stretches in step."""
        at = np.flatnonzero(stretch)
        n = len(start)
        while len(at):
            start[at] = True
            at = at + size[at]
            at = at[at < n]
            at = at[~stretch[at]]

    def _settle(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, stretch: np.ndarray, breaks: np.ndarray) -> None:
        """Runs of words of one character become words by the model."""
        place = np.flatnonzero(start & (size == 1))
        if not len(place):
            return
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | breaks[place[1:]]
        first = np.flatnonzero(new)
        begin, end = place[first], place[np.append(first[1:], len(place)) - 1] + 1
        many = end - begin > 1
        start[place] = False
        start[begin] = True
        self.model.breaks(codes, begin[many], end[many], start)


def graph_cut(text: str, frequency: dict[str, int], model: HiddenMarkov | None = None) -> list[str]:
    """The words of one text by ``GraphCut``."""
    return GraphCut(frequency, model)(text)


def words_udf(cutter):
    """An array-of-words column function from a batch cutter (``trie.MaxMatch``, ``GraphCut``), sent to tasks as it is."""

    @F.arrow_udf(ArrayType(StringType()))
    def segmented(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return piecewise(batches, lambda texts: pa.array(_whole(texts, cutter, lambda batch: batch.words()), pa.list_(pa.string())))

    return segmented


def word_count_udf(cutter):
    """A number-of-words column function from a batch cutter."""

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return piecewise(batches, lambda texts: pa.array(_whole(texts, cutter, lambda batch: batch.counts().tolist()), pa.int32()))

    return counted


def _whole(texts: pa.Array, cutter, read: Callable[[trie.Batch], list]) -> list:
    """What ``read`` gives for each text once cut, in passes of bounded size; null stays null."""
    out: list = []
    for part in trie.passes(texts.fill_null("").to_pylist()):
        batch = trie.Batch(part)
        cutter.cut(batch)
        out += read(batch)
    return [x if ok else None for x, ok in zip(out, texts.is_valid().to_pylist(), strict=True)] if texts.null_count else out


def segment_udf(cut):
    """An array-of-words column function from a Python segmenter."""

    @F.arrow_udf(ArrayType(StringType()))
    def segmented(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_row(batches, lambda t: None if t is None else cut(t), pa.list_(pa.string()))

    return segmented


def count_udf(count: Callable[[str], int]):
    """A number-of-words column function from a function that counts those of one text."""

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_row(batches, lambda t: None if t is None else count(t), pa.int32())

    return counted


def document_frequencies(texts: DataFrame, text_col: str, cutter, stop_words: Iterable[str] = ()) -> DataFrame:
    """(word, uses, texts): how often each word that is no stop word occurs, and in how many texts.

    Words are counted within each text before they are exchanged. Stop words are taken away by an anti join,
    broadcast if they are few enough; null texts have no words.
    """
    spark = texts.sparkSession
    cut = texts.select(F.monotonically_increasing_id().alias("text"), words_udf(cutter)(F.col(text_col)).alias("words"))
    words = cut.select("text", F.explode("words").alias("word"))
    stops = sorted(set(stop_words))
    if stops:
        table = spark.createDataFrame([(w,) for w in stops], "word string")
        words = words.join(F.broadcast(table) if len(stops) <= BROADCAST_KEYS else table, "word", "left_anti")
    return words.groupBy("word", "text").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("texts"))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A file with a stop word on each line, read by Spark; white space around a word is no part of it."""
    return [w for r in spark.read.text(path).collect() if (w := r.value.strip())]
