from quire.streaming.incoming import convert_new
from test_manuscripts import CORE, word


def test_new_files_only(spark, tmp_path):
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    (folder / "a.docx").write_bytes(word(*CORE))
    run = lambda: convert_new(spark, f"file://{folder}", f"file://{out}", f"file://{state}")
    assert run() == 1
    (folder / "b.docx").write_bytes(b"not a zip")
    assert run() == 2 and run() == 2
    rows = spark.read.parquet(f"file://{out}").select("status", "reason").collect()
    assert sorted(map(tuple, rows)) == [("failed", "not a zip"), ("success", "")]
