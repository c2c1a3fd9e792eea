"""A sink that writes one file for each row, in any store that Arrow knows, with commit and abort.

Tasks write into a staging folder beside the result, each attempt into its own. When all tasks have
succeeded, the driver moves the files of the attempts that count to their names; a task that ran twice
leaves one file, and a job that fails leaves none. What reaches the driver is a folder name for each task.

With the option ``spread`` the files stay in folders of at most ``FOLDER_FILES`` below the result, and a whole
folder is moved at once: for millions of files neither the commit nor a listing by tasks (``files.read_spread``)
does anything for each file on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scriptloom.functions.pieces import pieces

NAME = "scriptloom_files"
#: Files that the driver moves at once on commit.
MOVERS = 32
#: Files of one folder where they are spread over folders.
FOLDER_FILES = 1000


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is a local one."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.spread = str(options.get("spread", "")).lower() == "true"
        self.job = f"{self.path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = place(f"{self.job}/{uuid.uuid4().hex}")
        store.create_dir(folder, recursive=True)
        inner, held = folder, FOLDER_FILES
        for batch in iterator:
            for names, contents in pieces((batch.column("output_name"), batch.column("content"))):
                for name, content in zip(names.to_pylist(), contents.to_pylist(), strict=True):
                    if "/" in name or name in ("", ".", ".."):
                        raise ValueError(f"not a file name: {name!r}")
                    if self.spread and held >= FOLDER_FILES:
                        inner, held = f"{folder}/{uuid.uuid4().hex}", 0
                        store.create_dir(inner)
                    with store.open_output_stream(f"{inner}/{name}") as out:
                        out.write(content or b"")
                    held += 1
        return Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = place(self.path)
        held = [m.folder for m in messages if m is not None]
        with ThreadPoolExecutor(MOVERS) as pool:
            for folder in held:
                found = store.get_file_info(fs.FileSelector(folder))
                list(pool.map(lambda f: store.move(f.path, f"{target}/{f.base_name}"), found))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staged = place(self.job)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "output_name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)
