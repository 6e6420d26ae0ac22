"""Sources, sinks and streams: what is written is read back; a stream equals its batch form."""

from pyspark.sql import functions as F

from quarrymill.operators import logs
from quarrymill.sources import files
from quarrymill.streaming import events as st


def test_json_lines_skip_what_is_no_json(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"level": "INFO", "message": "x", "line": 3}\nnot json\n{"level": "WARN"}\n')
    assert logs.read_logs(spark, str(tmp_path / "a.log")).count() == 2
    logs.write_logs(logs.read_logs(spark, str(tmp_path / "a.log")), str(tmp_path / "out"))
    assert {r.level for r in logs.read_logs(spark, str(tmp_path / "out")).collect()} == {"INFO", "WARN"}


def test_chunk_sink_appends_and_reports_round_trip(spark, tmp_path):
    row = [("k", 1, "u", 1, 1, "text", 20000, "u", None), ("k2", 2, "u", 0, 0, None, 0, None, "{}")]
    chunks = spark.createDataFrame(row, files.CHUNKS)
    for _ in range(2):
        files.append_chunks(chunks, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks")).count() == 4
    files.dump_chunks(chunks, str(tmp_path / "dump"))
    assert {(r.key, r.exceeds_limit) for r in spark.read.json(str(tmp_path / "dump")).collect()} == {("k", True), ("k2", False)}
    (tmp_path / "r.json").write_text('[{"workers": 4,\n "rate": 1.5}, {"workers": 8, "rate": 2.0}]')
    report = files.read_report(spark, str(tmp_path / "r.json"), "workers int, rate double")
    assert report.agg(F.max_by("workers", "rate")).first()[0] == 8
    files.write_report(report, str(tmp_path / "r2"))
    assert spark.read.json(str(tmp_path / "r2")).count() == 2


def test_append_batches_once(spark, small_dir, tmp_path):
    for _ in range(2):
        st.append_batches(st.event_stream(spark, small_dir), str(tmp_path / "rows"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == spark.read.parquet(f"{small_dir}/events.parquet").count()


def test_late_files_extend_the_result(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    whole = {tuple(r) for r in st.live_status(events).collect()}
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    stream = st.event_stream(spark, str(tmp_path), files_each=1)
    assert {tuple(r) for r in st.run_available(st.live_status(stream), "status").collect()} == whole
