from pyspark.sql import functions as F

from gritlens.operators import security
from gritlens.streaming import continuous
from registry import stream_queries

SCHEMA = "repo string, file_path string, content string"
FIRST = [("r1", "a.js", "eval(x)"), ("r2", "b.py", "x = 1")]
SECOND = [("r1", "a.js", "eval(x)"), ("r3", "c.yaml", 'password: "longsecret1"')]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(FIRST, SCHEMA).write.parquet(source)
    for batch in (None, SECOND):
        if batch:
            spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
        continuous.start_findings(spark.readStream.schema(SCHEMA).parquet(source), out, state).awaitTermination()
    got = sorted(r.finding_id for r in spark.read.parquet(out).collect())
    expected = sorted(r.finding_id for r in security.findings(spark.read.parquet(source)).collect())
    assert got == expected and len(got) == 3


def test_history_over_batches(spark, tmp_path):
    """Files of a scan in two batches; a batch that runs again; a file that is sent again, mended."""
    source, path, state = (str(tmp_path / n) for n in ("in", "history", "state"))
    bad = "eval(x)\neval(y)\neval(z)"

    def run(rows, state):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        continuous.start_history(stream, path, state).awaitTermination()

    def scan():
        rows = continuous.stored_scans(spark, path).collect()
        return {r.scan_id: (r.security, r.high, r.total_files, r.total_lines) for r in rows}

    run([("r1", "a.js", bad)], state)
    run([("r1", "b.js", "ok()")], state)
    assert scan() == {"scan-r1": (64, 3, 2, 4)}
    batches = sorted(p.name for p in (tmp_path / "history" / "files").iterdir())
    assert len(batches) == 2
    # the last batch again, as after a failure before its commit
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (last.name, f".{last.name}.crc"):
        (last.parent / name).unlink(missing_ok=True)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    continuous.start_history(stream, path, state).awaitTermination()
    assert scan() == {"scan-r1": (64, 3, 2, 4)}
    assert continuous.stored_findings(spark, path).where("category = 'SECURITY'").count() == 3
    run([("r1", "a.js", "eval(x)")], state)
    assert scan() == {"scan-r1": (88, 1, 2, 2)}
    assert continuous.stored_findings(spark, path).where("category = 'SECURITY'").count() == 1


def test_compacted_history(spark, tmp_path):
    """Replaced rows stay behind; the stream goes on in the new folder; a batch that runs again there changes nothing."""
    source, path, new, state = (str(tmp_path / n) for n in ("in", "history", "compacted", "state"))

    def run(rows, path):
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        continuous.start_history(spark.readStream.schema(SCHEMA).parquet(source), path, state).awaitTermination()

    def known(path):
        scans = sorted(map(tuple, continuous.stored_scans(spark, path).collect()))
        return scans, sorted(r.finding_id for r in continuous.stored_findings(spark, path).collect())

    run([("r1", "a.js", "eval(x)\neval(y)"), ("r1", "b.js", "eval(x)")], path)
    run([("r1", "a.js", "eval(x)")], path)
    continuous.compact(spark, path, new)
    assert known(new) == known(path)
    assert spark.read.parquet(f"{new}/files").count() == 2 and spark.read.parquet(f"{new}/findings").count() == 2
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (last.name, f".{last.name}.crc"):
        (last.parent / name).unlink(missing_ok=True)
    run([], new)
    assert known(new) == known(path)
    run([("r1", "a.js", "ok()"), ("r2", "c.js", "eval(x)")], new)
    scans, found = known(new)
    assert [(r[0], r[2]) for r in scans] == [("scan-r1", 2), ("scan-r2", 1)] and len(found) == 2
    continuous.compact(spark, new, str(tmp_path / "twice"))
    assert known(str(tmp_path / "twice")) == (scans, found)


def test_arriving_files_are_many(spark, tmp_path):
    """Two batches of many files each, so that no task reads half of the documents."""
    documents = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('s', id % 3) AS source")
    documents.union(documents.limit(1).selectExpr("cast(null as bigint)", "text", "source")).write.parquet(f"{tmp_path}/documents.parquet")
    files, sources, rows = [], [], []

    def look(batch, _):
        files.append(batch.select(F.input_file_name()).distinct().count())
        sources.append({r.repo for r in batch.select("repo").distinct().collect()})
        rows.extend(r.file_path for r in batch.select("file_path").collect())

    arriving = stream_queries._arriving_files(spark, str(tmp_path))
    arriving.writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(files) == 2 and min(files) > 2
    assert sources == [{"s0", "s1", "s2"}] * 2
    assert len(rows) == len(set(rows)) == 400
