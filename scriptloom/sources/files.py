"""Files in and out: listing, routing by extension, output names, collisions, sinks and tallies.

Spark's listing leaves out files of no bytes; an empty file has nothing to convert.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import pieces
from scriptloom.sources import sink

#: Extensions that are converted (fixed values); .doc needs an office program and is only reported.
EXTENSIONS = ("docx", "doc", "txt", "srt", "ass", "ssa", "lrc", "epub")


#: Routes of the files that are converted.
CONVERTED = ("text", "epub", "docx")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def route(path: Column) -> Column:
    """text, epub, docx, unsupported_doc or skipped."""
    ext = extension(path)
    return F.when(ext.isin("txt", "srt", "ass", "ssa", "lrc"), "text").when(ext == "epub", "epub").when(ext == "docx", "docx").when(ext == "doc", "unsupported_doc").otherwise("skipped")


def output_name(path: Column) -> Column:
    """convert_<basename>; a file is routed as EPUB by that extension alone, so the name of a book already ends in it."""
    return F.concat(F.lit("convert_"), basename(path))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of files, or of the files directly in folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, modificationTime, length) of the same files; none is opened."""
    return read_files(spark, paths).drop("content")


def _glob(extensions: Sequence[str]) -> str:
    """A pattern of file names by extension in either case; Spark applies it while it lists, before anything is read."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def read_converted(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``read_files`` of what is converted; other files are neither opened nor planned for."""
    extensions = [e for e in EXTENSIONS if e != "doc"]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _glob(extensions)).load(paths)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The supported files directly in a folder; no other file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _glob(EXTENSIONS)).load(path)


def collisions(files: DataFrame) -> DataFrame:
    """(output_name, paths): names that several inputs would write to."""
    return files.groupBy(output_name(F.col("path")).alias("output_name")).agg(F.sort_array(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)


def write_files(converted: DataFrame, folder: str) -> DataFrame:
    """Write (output_name, content) rows as files of a folder in any store; (output_name, written) of the files there.

    The files appear when the whole job has succeeded (see ``sink``); names that collide are refused before.
    """
    _write(converted, folder, spread=False)
    return list_files(converted.sparkSession, folder).select(basename(F.col("path")).alias("output_name"), F.col("length").alias("written"))


def write_spread(converted: DataFrame, folder: str) -> None:
    """The same into folders below ``folder``, for more files than one listing should hold; ``read_spread`` reads them."""
    _write(converted, folder, spread=True)


def _write(converted: DataFrame, folder: str, spread: bool) -> None:
    twice = converted.groupBy("output_name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several inputs would write {twice[0].output_name}")
    spark = converted.sparkSession
    sink.register(spark)
    names = converted.select("output_name", "content")
    names.write.format(sink.NAME).option("path", folder).option("spread", str(spread).lower()).mode("append").save()


def _shown(name: str) -> bool:
    return not name.startswith(("_", "."))


def read_spread(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files in the folders below a folder; what nothing converts is listed, not opened, and has no content.

    The driver lists the folders; tasks list what is in them and read it. As in Spark's listing, files of no bytes and
    hidden ones are left out.
    """
    store, root = sink.place(folder.rstrip("/"))
    inner = [f"{folder.rstrip('/')}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and _shown(f.base_name)]
    opened = tuple(f".{e}" for e in EXTENSIONS if e != "doc")
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for place in batch.column("folder").to_pylist():
                own, at = sink.place(place)
                for f in own.get_file_info(fs.FileSelector(at)):
                    if f.type != fs.FileType.File or not f.size or not _shown(f.base_name):
                        continue
                    content = None
                    if f.base_name.lower().endswith(opened):
                        with own.open_input_stream(f.path) as source:
                            content = source.read()
                        held += len(content)
                    rows.append({"path": f"{place}/{f.base_name}", "length": f.size, "content": content})
                    if held >= pieces.PIECE_BYTES or len(rows) >= sink.FOLDER_FILES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # A few folders for each task, and a task for each folder while there are few.
    n = max(1, min(len(inner), 16 * spark.sparkContext.defaultParallelism))
    named = spark.createDataFrame([(i, x) for i, x in enumerate(inner)], "n long, folder string")
    dealt = named.repartitionByRange(n, "n") if inner else named
    return dealt.mapInArrow(read, "path string, length long, content binary")


def tallies(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, success_count, total_files, message): outcomes of rows with a status; a group of no rows is an error."""
    counts = results.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("success_count"), F.count("*").alias("total_files"))
    done, total = F.col("success_count"), F.col("total_files")
    return counts.withColumn("message", F.when((total > 0) & (done == total), "ok").when(done > 0, "partial").otherwise("error"))


def tally(results: DataFrame) -> Row:
    """(success, message, success_count, total_files) of a batch."""
    row = tallies(results).first()
    return Row(success=row.message == "ok", message=row.message, success_count=row.success_count, total_files=row.total_files)
