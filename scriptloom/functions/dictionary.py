"""Conversion dictionaries: UTF-8 lines ``key<TAB>value[ value ...]``; ``#`` starts a comment line."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a dictionary up to which it is broadcast.
BROADCAST_KEYS = 1_000_000


class MissingResource(FileNotFoundError):
    """A profile names a dictionary that cannot be found; nothing is made up in its place."""


@dataclass(frozen=True)
class Dictionary:
    """Keys with their values; conversion uses a key's first value. Identity entries guard their key."""

    name: str
    entries: dict[str, tuple[str, ...]] = field(hash=False)

    @classmethod
    def parse(cls, name: str, lines: Iterable[str]) -> Dictionary:
        entries: dict[str, tuple[str, ...]] = {}
        for line in lines:
            line = line.rstrip("\r\n")
            if not line.strip() or line.startswith("#"):
                continue
            key, tab, values = line.partition("\t")
            if tab and key and (split := tuple(v for v in values.split(" ") if v)):
                entries.setdefault(key, split)
        return cls(name, entries)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """Read by Spark, so that a path in any store works; a dictionary is configuration and fits the driver."""
        try:
            rows = spark.read.text(path).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise MissingResource(path) from error
        return cls.parse(path.rsplit("/", 1)[-1], (r.value for r in rows))

    def first(self) -> dict[str, str]:
        return {key: values[0] for key, values in self.entries.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(key, values, src, line_no) rows, as a table for joins and audits."""
        rows = [(k, list(v), self.name, i) for i, (k, v) in enumerate(self.entries.items())]
        return spark.createDataFrame(rows, "key string, values array<string>, src string, line_no int")

    def hazards(self) -> dict[str, list[str]]:
        """Entries that need care: expansions, chains within the dictionary, several values, guards."""
        first = self.first()
        return {
            "expanding": [k for k, v in first.items() if len(v) != len(k)],
            "chained": [k for k, v in first.items() if v != k and v in first],
            "multiple": [k for k, v in self.entries.items() if len(v) > 1],
            "guards": [k for k, v in first.items() if v == k],
        }


def coverage(texts: DataFrame, text_col: str, dictionary: Dictionary) -> DataFrame:
    """(key, uses): how often each single-character key of the dictionary occurs in the texts, zero included."""
    spark = texts.sparkSession
    used = texts.select(F.explode(F.split(text_col, "")).alias("key")).groupBy("key").agg(F.count("*").alias("uses"))
    keys = dictionary.frame(spark).filter(F.length("key") == 1).select("key")
    # The texts' characters are reduced to the dictionary's before they meet it; no side is larger than the dictionary.
    found = used.join(F.broadcast(keys), "key", "left_semi") if len(dictionary.entries) <= BROADCAST_KEYS else used
    return keys.join(found, "key", "left").select("key", F.coalesce("uses", F.lit(0)).alias("uses"))
