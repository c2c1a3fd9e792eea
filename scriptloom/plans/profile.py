"""Conversion profiles: JSON with a name, normalization, optional segmentation, and a conversion chain."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession

from scriptloom.functions import convert as c
from scriptloom.functions import segment, trie
from scriptloom.functions.dictionary import Dictionary, MissingResource

#: Suffixes of profile names by segmentation mode (fixed values).
MODES = {"none": "", "modern": "_jieba", "ancient": "_jieba_traditional"}


@dataclass(frozen=True)
class Profile:
    name: str
    normalization: tuple[str, ...]
    segmentation: str | None
    resources: tuple[str, ...]
    #: Names of the segmenter's resources with their files.
    named: tuple[tuple[str, str], ...]
    #: Files of each step of the chain; those of one step are tried in order at every place, steps follow one another.
    steps: tuple[tuple[str, ...], ...]

    @property
    def chain(self) -> tuple[str, ...]:
        return tuple(f for step in self.steps for f in step)

    @classmethod
    def parse(cls, text: str) -> Profile:
        data = json.loads(text)

        def files(node: dict) -> list[str]:
            if node.get("type") == "group":
                return [f for child in node.get("dicts", ()) for f in files(child)]
            return [node["file"]] if "file" in node else []

        segmentation = data.get("segmentation") or {}
        named = list((segmentation.get("resources") or {}).values()) + files(segmentation.get("dict") or {})
        return cls(
            data.get("name", ""),
            tuple(f for step in data.get("normalization", ()) for f in files(step["dict"])),
            segmentation.get("type"),
            tuple(named),
            tuple((segmentation.get("resources") or {}).items()),
            tuple(tuple(files(step["dict"])) for step in data.get("conversion_chain", ())),
        )

    def missing(self, exists: Callable[[str], bool]) -> list[str]:
        """Resources that cannot be found, normalization aside (it can be derived)."""
        return [f for f in (*self.resources, *self.chain) if not exists(f)]

    def dictionaries(self, spark: SparkSession, folder: str) -> list[Dictionary]:
        for name in self.chain:
            if name.endswith(".ocd2"):
                raise MissingResource(f"{name}: compiled dictionaries are not read; give the text form")
        return [Dictionary.load(spark, f"{folder}/{name}") for name in self.chain]

    def cut(self, lines: Callable[[str], list[str]]) -> trie.MaxMatch | segment.GraphCut | None:
        """The profile's segmenter, its resources read by ``lines(file)``; none where it names none.

        ``mmseg`` matches the longest words of its dictionary. ``jieba`` takes the best path through the words
        of a frequency dictionary and a user dictionary, and leaves runs of single characters to its model.
        Either is built once, cuts a text when called, and goes to tasks as it is.
        """
        if not self.segmentation:
            return None
        if self.segmentation == "mmseg":
            words = {k for f in self.resources for k in Dictionary.parse(f, lines(f)).entries}
            return trie.MaxMatch(words)
        if self.segmentation != "jieba":
            raise ValueError(f"unknown segmentation: {self.segmentation}")
        named = dict(self.named)
        frequency = {x[0]: int(x[1]) for line in lines(named["dict_path"]) if len(x := line.split()) > 1}
        own = [line.split()[0] for line in lines(named["user_dict_path"]) if line.strip()] if "user_dict_path" in named else []
        highest = max(frequency.values(), default=1)
        frequency |= dict.fromkeys(own, highest)
        model = segment.HiddenMarkov.parse(lines(named["model_path"])) if "model_path" in named else None
        return segment.GraphCut(frequency, model)

    def column(self, text: Column, chain: list[Dictionary], cut: trie.MaxMatch | segment.GraphCut | None = None) -> Column:
        """Normalization, then segmentation by ``cut`` if the profile has one, then the steps of the chain."""
        if self.segmentation and cut is None:
            raise MissingResource(f"{self.name}: the profile names a segmentation; give the segmenter made by cut()")
        text = c.normalize_compat(text) if self.normalization else text
        given = iter(chain)
        steps = [[next(given) for _ in step] for step in self.steps]
        if self.segmentation:
            return c.segmented_udf(cut, steps)(text)
        for step in steps:
            text = c.convert_chain(text, step)
        return text


    def converter(self, chain: list[Dictionary], cut: trie.MaxMatch | segment.GraphCut | None = None) -> Callable[[list[str]], list[str]]:
        """The whole profile over lists of texts, for ``convert.register_all``."""
        if self.segmentation and cut is None:
            raise MissingResource(f"{self.name}: the profile names a segmentation; give the segmenter made by cut()")
        given = iter(chain)
        return c.in_steps([[next(given) for _ in step] for step in self.steps], bool(self.normalization), cut if self.segmentation else None)


def profile_name(base: str, mode: str = "none") -> str:
    return base + MODES[mode]
