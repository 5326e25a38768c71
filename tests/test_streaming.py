from conftest import AWS, GITHUB
from credlens.operators.detect import detect
from credlens.schema import DOCUMENT
from credlens.streaming.scan import start_incremental_scan


def test_incremental_scan_appends_only_new_findings(spark, docs, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        stream = spark.readStream.schema(DOCUMENT).parquet(inbox)
        start_incremental_scan(stream, table, checkpoint).awaitTermination()
        return sorted((r.path, r.rule_id, r.batch_id) for r in spark.read.parquet(table).collect())

    docs(("a.py", AWS), ("b.py", "clean")).write.parquet(inbox)
    assert run() == [("a.py", "aws_access_key_id", 0)]
    docs(("a.py", f"moved\n{AWS}\n{GITHUB}"), ("c.py", AWS)).write.mode("append").parquet(inbox)
    assert run() == [("a.py", "aws_access_key_id", 0), ("a.py", "github_pat", 1), ("c.py", "aws_access_key_id", 1)]
    assert len(run()) == 3


def test_detection_runs_on_a_stream(spark, docs, tmp_path):
    docs(("a.py", AWS)).write.parquet(str(tmp_path / "in"))
    stream = detect(spark.readStream.schema(DOCUMENT).parquet(str(tmp_path / "in")), entropy=True)
    query = (stream.writeStream.format("memory").queryName("stream_findings")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("stream_findings").count() == 1
