"""Listing, reading once, and the sink that commits."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from scriptloom import queries
from scriptloom.plans import batch, samples
from scriptloom.sources import files, sink

D = samples.dictionary("new_glyphs")


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "deeper").mkdir(parents=True)
    (source / "a.TXT").write_text("奧", encoding="utf-8")
    (source / "a.sRt").write_text("1\n00 --> 01\n奧", encoding="utf-8")
    (source / "b.epub").write_bytes(queries.make_epub("奧"))
    (source / "c.docx").write_bytes(queries.make_docx(["奧"]))
    (source / "d.doc").write_bytes(b"x" * 5000)
    (source / "e.pdf").write_bytes(b"x" * 5000)
    (source / "noext").write_bytes(b"x" * 5000)
    (source / "deeper" / "f.txt").write_text("奧", encoding="utf-8")
    return source


def test_files_that_nothing_converts_are_not_opened(spark, folder):
    """A file beyond Spark's limit fails a job that reads it; here it is listed and no more."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 2000)
    try:
        rows = {r.output_name: r for r in batch.convert_paths(spark, str(folder), [D]).collect()}
        assert {n: r.status for n, r in rows.items()} == {"convert_a.TXT": "ok", "convert_a.sRt": "ok", "convert_b.epub": "ok", "convert_c.docx": "ok", "convert_d.doc": "unsupported_doc", "convert_e.pdf": "skipped", "convert_noext": "skipped"}
        assert bytes(rows["convert_a.TXT"].content).decode() == "奥" and rows["convert_e.pdf"].content is None
        assert files.list_files(spark, str(folder)).count() == 7
        listed = batch.convert_paths(spark, [str(folder / "a.TXT"), str(folder / "e.pdf")], [D])
        assert {r.status for r in listed.collect()} == {"ok", "skipped"}
        with pytest.raises(Exception, match="length"):
            files.read_files(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_one_scan_of_contents(spark, folder):
    plan = batch.convert_paths(spark, str(folder), [D])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 2 and sum("content" in line.split("Batched")[0] for line in scans) == 1


def test_folder_of_supported_files(spark, folder):
    names = sorted(os.path.basename(r.path) for r in files.read_folder(spark, str(folder)).select("path").collect())
    assert names == ["a.TXT", "a.sRt", "b.epub", "c.docx", "d.doc"]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 2000)
    try:
        with pytest.raises(Exception, match="length"):  # .doc is supported as a name, and so is read
            files.read_folder(spark, str(folder)).select("content").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert files.read_folder(spark, str(folder)).count() == 5


def test_options_of_a_batch(spark, tmp_path):
    """Formatting, notes and forced encodings are options; other columns are carried along."""
    rows = [("/x/a.docx", queries.make_docx([" ", "奧", "b"]), 7), ("/x/b.txt", "奧".encode("cp950"), 8)]
    table = spark.createDataFrame(rows, "path string, content binary, mine int")
    done = {r.output_name: r for r in batch.convert_files(table, [D], keep_format=False, force_encoding="cp950", keep=["mine"]).collect()}
    assert done["convert_b.txt"].mine == 8 and bytes(done["convert_b.txt"].content).decode() == "奥"
    from io import BytesIO
    from zipfile import ZipFile

    assert " 奥b" in ZipFile(BytesIO(bytes(done["convert_a.docx"].content))).read("word/document.xml").decode()


def test_tallies(spark):
    rows = spark.createDataFrame([("a", "ok"), ("a", "ok"), ("b", "ok"), ("b", "error"), ("c", "skipped"), (None, None)], "k string, status string")
    assert {r.k: (r.success_count, r.total_files, r.message) for r in files.tallies(rows, "k").collect()} == {"a": (2, 2, "ok"), "b": (1, 2, "partial"), "c": (0, 1, "error"), None: (0, 1, "error")}
    assert files.tally(rows.filter("k = 'z'")).asDict() == {"success": False, "message": "error", "success_count": 0, "total_files": 0}


def test_written_files_and_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}.txt", f"{i}".encode()) for i in range(50)] + [("empty", None)], "output_name string, content binary").repartition(5)
    written = files.write_files(rows, str(tmp_path / "out"))
    assert {r.output_name: r.written for r in written.collect()} == {f"n{i}.txt": len(str(i)) for i in range(50)}
    assert sorted(os.listdir(tmp_path / "out")) == sorted([*(f"n{i}.txt" for i in range(50)), "empty"])
    files.write_files(spark.createDataFrame([("n1.txt", b"new")], "output_name string, content binary"), f"file://{tmp_path}/out").collect()
    assert (tmp_path / "out" / "n1.txt").read_bytes() == b"new"
    with pytest.raises(ValueError, match="several inputs"):
        files.write_files(rows.unionByName(rows.limit(1)), str(tmp_path / "out"))
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(spark.createDataFrame([("../x", b"")], "output_name string, content binary"), str(tmp_path / "out"))


def test_failed_jobs_leave_nothing(spark, tmp_path):
    @F.udf("binary")
    def failing(i):
        if i == 19:
            raise ValueError("on purpose")
        return b"x"

    rows = spark.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("output_name"), failing("id").alias("content"))
    sink.register(spark)
    with pytest.raises(Exception, match="on purpose"):
        rows.write.format(sink.NAME).option("path", str(tmp_path / "out")).mode("append").save()
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_retried_tasks_leave_one_file(tmp_path):
    """A session of its own, in which a task may fail once: it fails after it has written."""
    script = textwrap.dedent("""
        import os, sys
        from pyspark.sql import functions as F
        from pyspark.sql import SparkSession
        from scriptloom.sources import files
        out, mark = sys.argv[1:]
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "1").getOrCreate()
        def once(batches):
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    if n == 5 and not os.path.exists(mark):
                        open(mark, "w").close()
                        raise ValueError("once")
                yield batch
        rows = spark.range(0, 8, 1, 2).mapInArrow(once, "id long").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("output_name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
        files.sink.register(spark)
        rows.write.format(files.sink.NAME).option("path", out).mode("append").save()
        spark.stop()
    """)
    out, mark = tmp_path / "out", tmp_path / "mark"
    with (tmp_path / "log").open("w") as log:
        done = subprocess.run([sys.executable, "-c", script, str(out), str(mark)], stdout=log, stderr=log, timeout=120)
    assert done.returncode == 0, (tmp_path / "log").read_text()[-2000:]
    assert mark.exists() and {n: (out / n).read_text() for n in sorted(os.listdir(out))} == {f"f{i}": str(i) for i in range(8)}


def test_documents_as_files(spark, tmp_path):
    """The query over the whole way: a null text is an empty file, which is not listed; every other document comes back once."""
    rows = [(i, t) for i, t in enumerate(["the one", None, "", "on\nthe", None, "an", "<&>", "the"] * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.output_name: r for r in queries.files_in_folder(spark, str(tmp_path)).collect()}
    kinds = queries._KINDS
    want = {f"convert_{i}{kinds[i % 6]}" for i, t in rows if t or kinds[i % 6] in (".epub", ".docx")}
    assert set(got) == want and {r.status for r in got.values()} == {"ok", "skipped", "unsupported_doc"}


def test_spread_files_are_moved_and_listed_by_folder(spark, tmp_path, monkeypatch):
    """Neither the commit nor the listing does anything for each file on the driver."""
    rows = [(f"{n}{('.txt', '.pdf', '.TXT')[n % 3]}", b"" if n == 6 else "瞭解".encode()) for n in range(2500)]
    table = spark.createDataFrame(rows, "output_name string, content binary").coalesce(1)
    files.write_spread(table, f"file://{tmp_path}/out")
    folders = sorted(p for p in (tmp_path / "out").iterdir())
    assert [p.is_dir() for p in folders] == [True] * 3 and max(len(list(p.iterdir())) for p in folders) == 1000
    (folders[0] / ".hidden.txt").write_text("x")
    monkeypatch.setattr(files, "list_files", None)
    found = files.read_spread(spark, f"file://{tmp_path}/out")
    got = {files_row.path.rpartition("/")[2]: files_row for files_row in found.collect()}
    assert found.rdd.getNumPartitions() == 3 and set(got) == {n for n, _ in rows} - {"6.txt"}
    assert got["1.pdf"].content is None and got["1.pdf"].length == 6 and got["2.TXT"].content.decode() == "瞭解"
    done = {r.output_name: r.status for r in batch.convert_spread(spark, f"file://{tmp_path}/out", [D]).collect()}
    assert len(done) == 2499 and done["convert_1.pdf"] == "skipped" and done["convert_0.txt"] == "ok"
    with pytest.raises(ValueError, match="several inputs"):
        files.write_spread(table.unionByName(table.limit(1)), str(tmp_path / "out"))
    assert files.read_spread(spark, str(tmp_path / "none")).count() == 0
