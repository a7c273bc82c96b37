import numpy as np

from pagemill.streaming import files
from tests.test_core_more import tiff


def test_new_files_only(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    page = np.full((4, 5), 9, np.uint8)

    def run():
        files.write(files.decoded(files.arriving(spark, folder, "*.tif")), out, mark).awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["page_index"], r["error"] is None) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "a.tif").write_bytes(tiff([page, page]))
    (tmp_path / "in" / "x.txt").write_bytes(b"no")
    assert run() == [("a.tif", 0, True), ("a.tif", 1, True)]
    (tmp_path / "in" / "b.tif").write_bytes(b"II*\0zz")
    assert len(run()) == 3 and ("b.tif", None, False) in run()


def test_request_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 200, 10.0), ("2024-01-01 00:04:00", 200, 30.0), ("2024-01-01 00:06:00", 400, 5.0), ("2024-01-01 01:00:00", 200, 1.0)]
    d = spark.createDataFrame(rows, "ts string, status int, ms double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "status", "ms")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    files.write(files.request_windows(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = sorted((str(r["start"])[11:16], r["status"], r["n"], r["mean_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("00:00", 200, 2, 20.0), ("00:05", 400, 1, 5.0)]
