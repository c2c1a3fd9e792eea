"""Progress, cancel and resume, names across runs of the stream."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from scriptloom.plans import batch, control, samples
from scriptloom.streaming import feed

D = samples.dictionary("new_glyphs")


def test_progress_is_monotone_and_starts_no_job(spark):
    @F.udf("long")
    def slow(i):
        time.sleep(0.05)
        return i

    seen: list[int] = []
    frame = spark.range(0, 48, 1, 24).select(slow("id").alias("i"))
    run = control.Run(spark, lambda: frame.write.format("noop").mode("overwrite").save(), seen.append, 0.02)
    run.result()
    assert seen == sorted(set(seen)) and seen[-1] == 100 and len(seen) >= 3
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(run.tag)) == 1


def test_counts_ride_along(spark):
    rows = spark.createDataFrame([("/a.txt", "奧".encode()), ("/b.pdf", b"x"), ("/c.docx", b"broken"), ("/d.txt", b"")], "path string, content binary")
    done, counts = control.observed(batch.convert_files(rows, [D]))
    run = control.Run(spark, lambda: done.write.format("noop").mode("overwrite").save())
    run.result()
    assert counts.get == {"total": 4, "ok": 2, "error": 1, "skipped": 1, "unsupported_doc": 0, "collision": 0}


def test_errors_reach_the_caller(spark):
    with pytest.raises(ZeroDivisionError):
        control.Run(spark, lambda: 1 / 0).result()
    assert control.Run(spark, lambda: 7).result() == 7


def test_cancel_of_a_run(spark):
    @F.udf("long")
    def endless(i):
        time.sleep(30)
        return i

    start = time.time()
    run = control.Run(spark, lambda: spark.range(4).select(endless("id")).collect())
    threading.Timer(1.5, run.cancel).start()
    with pytest.raises(control.Cancelled):
        run.result()
    assert time.time() - start < 25 and run.percent < 100


def test_cancelled_streams_go_on(spark, tmp_path, monkeypatch):
    """The first run is cancelled after some batches; the second converts the rest, each file once."""
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    for i in range(6):
        (source / f"{i}.txt").write_text("奧", encoding="utf-8")
    seen, convert = [], feed.convert_files

    def slow(found, *rest):
        seen.append(1)
        if len(seen) == 3:
            time.sleep(3)
        return convert(found, *rest)

    monkeypatch.setattr(feed, "convert_files", slow)
    query = feed.convert_stream(spark, str(source), [D], str(out), str(state), files_per_batch=1, tag="mine")
    while len(seen) < 3:
        time.sleep(0.05)
    feed.cancel(spark, query, "mine")
    kept = spark.read.parquet(str(out)).count()
    assert 1 <= kept < 6
    monkeypatch.setattr(feed, "convert_files", convert)
    feed.convert_stream(spark, str(source), [D], str(out), str(state), files_per_batch=2).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.output_name for r in rows) == [f"convert_{i}.txt" for i in range(6)] and {r.status for r in rows} == {"ok"}


@pytest.mark.parametrize("limit", [100_000, -1])
def test_names_across_runs(spark, tmp_path, monkeypatch, limit):
    """A second file of a name, in the same run or a later one, gets no output and says whose the name is."""
    monkeypatch.setattr(feed, "BROADCAST_NAMES", limit)
    out, state = tmp_path / "out", tmp_path / "state"
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
    (tmp_path / "in/a/x.txt").write_text("奧", encoding="utf-8")
    (tmp_path / "in/b/x.txt").write_text("顚", encoding="utf-8")

    def run():
        feed.convert_stream(spark, str(tmp_path / "in" / "*"), [D], str(out), str(state)).awaitTermination()
        return {r.path.rpartition("/in/")[2]: r for r in spark.read.parquet(str(out)).collect()}

    first = run()
    assert (first["a/x.txt"].status, first["b/x.txt"].status) == ("ok", "collision") and first["b/x.txt"].content is None
    (tmp_path / "in/b/y.txt").write_text("奧", encoding="utf-8")
    assert run()["b/y.txt"].status == "ok"
    (tmp_path / "in/a/y.txt").write_text("奧", encoding="utf-8")
    last = run()
    assert last["a/y.txt"].status == "collision" and last["a/y.txt"].error.endswith("/in/b/y.txt") and len(last) == 4
