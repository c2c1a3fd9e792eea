"""Whole batches of files: list, route, read, decode, convert, and hand on to a sink.

A batch has two phases. Listing gives paths and lengths without opening a file; files that nothing converts
end there. The others are read by one scan, and one pass over its rows converts every kind: texts by
column expressions or one call of the matcher, containers by one Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.convert import Conversion, assembled
from scriptloom.functions.dictionary import Dictionary
from scriptloom.functions.pieces import by_row
from scriptloom.functions.trie import Converter
from scriptloom.operators import epub, subtitles, word
from scriptloom.sources import encoding, files


def _container_udf(converter: Converter, keep_format: bool, notes: bool):
    def one(raw: bytes | None, kind: str) -> dict[str, object]:
        if raw is None:
            return {}
        try:
            if kind == "epub":
                new, problems = epub.convert_epub(raw, converter)
                return {"content": new, "error": "; ".join(problems) or None}
            return {"content": word.convert_docx(raw, converter, keep_format, notes)}
        except Exception as error:  # one broken file is a row with an error, never a failed job
            return {"error": f"{type(error).__name__}: {error}"}

    @F.arrow_udf("content binary, error string")
    def converted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return by_row(batches, one, pa.struct([("content", pa.binary()), ("error", pa.string())]))

    return converted


def convert_files(found: DataFrame, chain: Sequence[Dictionary], normalize: bool = True, force_encoding: str = "auto", keep_format: bool = True, notes: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(path, output_name, status, error, content) for (path, content) rows; one row for every input, read once.

    ``keep_format`` keeps the formatting of Word runs, ``notes`` converts foot and end notes; the columns
    ``keep`` are carried along.
    """
    conversion = Conversion(chain, normalize)
    path, content = F.col("path"), F.col("content")
    routed = found.select(*keep, "path", "content", files.route(path).alias("kind"), files.extension(path).alias("ext"))
    # What is not of a kind is null for the functions of that kind, and costs nothing there.
    held = routed.select(
        *keep, "path", "kind", "ext",
        encoding.decoded(F.when(F.col("kind") == "text", content), force_encoding).alias("text"),
        _container_udf(conversion.converter(), keep_format, notes)(F.when(F.col("kind").isin("epub", "docx"), content), F.col("kind")).alias("made"),
    )
    text = F.col("text")
    pieces: Column = F.lit(None)
    for name, parts in subtitles.PARTS.items():
        pieces = F.when(F.col("ext") == name, parts(text)).otherwise(pieces)
    done = F.encode(assembled(pieces, conversion), "UTF-8")
    opened = F.col("kind").isin("epub", "docx")
    status = F.when(F.col("kind") == "text", "ok").when(opened & F.col("made.content").isNotNull(), "ok").when(opened, "error").otherwise(F.col("kind"))
    error = F.when(F.col("kind") == "text", F.lit(None)).when(opened, F.col("made.error")).otherwise("unsupported extension")
    return held.select(*keep, "path", files.output_name(path).alias("output_name"), status.alias("status"), error.cast("string").alias("error"), F.when(F.col("kind") == "text", done).otherwise(F.col("made.content")).alias("content"))


def convert_spread(spark: SparkSession, folder: str, chain: Sequence[Dictionary], **options) -> DataFrame:
    """The same for files spread over the folders below one: tasks list them and read what is converted, in one pass."""
    return convert_files(files.read_spread(spark, folder), chain, **options)


def convert_paths(spark: SparkSession, paths: str | list[str], chain: Sequence[Dictionary], **options) -> DataFrame:
    """The same for files and folders: what nothing converts is listed and never opened."""
    listed = files.list_files(spark, paths)
    kind = files.route(F.col("path"))
    rest = listed.filter(~kind.isin(*files.CONVERTED)).select(
        "path", files.output_name(F.col("path")).alias("output_name"), kind.alias("status"), F.lit("unsupported extension").alias("error"), F.lit(None).cast("binary").alias("content")
    )
    return convert_files(files.read_converted(spark, paths), chain, **options).unionByName(rest)
