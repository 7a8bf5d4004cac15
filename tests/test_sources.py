import hashlib

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from pagesift.session import new_output
from pagesift.sources import keywords, samples, sinks
from pagesift.streaming.triage_stream import stream_triage


def test_folder_scan_and_one_file(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for place, content in (("a/one", b"x\xff"), ("a/b/two", b"y"), ("a/b/empty", b"")):
        (tmp_path / place).write_bytes(content)
    found = samples.scan_samples(spark, str(tmp_path))
    assert sorted((r["name"], bytes(r["content"])) for r in found.collect()) == [
        ("empty", b""), ("one", b"x\xff"), ("two", b"y"),
    ]
    assert rows(samples.list_sample_names(found)) == [("empty",), ("one",), ("two",)]
    assert {r.path.startswith("file:/") for r in found.collect()} == {True}
    assert samples.scan_samples(spark, str(tmp_path), empty_files=False).count() == 2
    for one in ("a/one", "a/b/empty"):
        assert samples.scan_samples(spark, str(tmp_path / one)).count() == 1


def test_listing_and_unreadable_files(spark, tmp_path):
    sizes = {"top": 1, "a/x y%20z": 2, "a/b/c/deep": 3, "a/empty": 0, "d/.hidden": 4, "_skipped/f": 5}
    for place, size in sizes.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(b"x" * size)
    expected = [(f"file:{tmp_path}/{p}", n) for p, n in sizes.items() if "hidden" not in p and "skip" not in p]
    for folder in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        assert rows(samples.list_files(spark, folder)) == sorted(expected)
    assert samples.unreadable_samples(spark, str(tmp_path)).count() == 0
    assert samples.list_files(spark, str(tmp_path / "d")).count() == 0


def test_keyword_file(spark, tmp_path):
    (tmp_path / "keyword.txt").write_text("html\nbody \r\n\nhtml \nvar\n")
    found = keywords.load_keywords(spark, str(tmp_path / "keyword.txt"))
    assert rows(found) == [(0, "html"), (1, "body"), (4, "var")]


def test_type_table_columns_in_any_order(spark, tmp_path):
    (tmp_path / "types.csv").write_text('File Type,x,SHA1\nHTML,1,a\n,2,b\n"Java, Script",3,c\n')
    found = samples.scan_type_table(spark, str(tmp_path / "types.csv"))
    assert rows(found) == [("a", "HTML"), ("b", ""), ("c", "Java, Script")]


def test_labelled_corpus_and_validation_sets(spark):
    one = spark.createDataFrame([(1, "v/mal_set/x/f"), (2, "v/nor_set/y/f"), (3, "v/else/f")], "sample_id int, path string")
    assert rows(samples.labelled_corpus(one, one), "sample_id", "label")[0] == (1, 0)
    assert rows(samples.validation_sets(one), "sample_id", "set_name", "label") == [(1, "x", 1), (2, "y", 0)]


def test_routed_sink_conserves_rows(spark):
    df = spark.range(50).select(F.col("id").alias("sample_id"), F.concat(F.lit("html/r"), F.col("id") % 3).alias("route"))
    path = new_output(spark, "routes")
    sinks.route_samples(df, path)
    assert rows(spark.read.parquet(path), "sample_id", "route") == rows(df)


def test_streamed_triage_equals_batch(spark, tmp_path):
    content = "<html>"
    digest = hashlib.sha1(content.encode()).hexdigest()
    source = str(tmp_path / "in")
    data = [(1, content, digest), (2, "text", "q"), (3, "<!doctype html>", "r")]
    shape = "sample_id int, content string, sha1 string"
    spark.createDataFrame(data, shape).write.parquet(source)
    types = spark.createDataFrame([(digest, "HTML")], "sha1 string, file_type string")
    stream = spark.readStream.schema(shape).parquet(source)
    writer = stream_triage(stream, types, str(tmp_path / "out"), str(tmp_path / "state"), ["sample_id"])
    writer.trigger(availableNow=True).start().awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert rows(found, "sample_id", "route") == [
        (1, "html/judge_by_vt"), (2, "no_html/no_match_by_re"), (3, "html/doctype"),
    ]


def test_samples_written_as_files(spark, tmp_path):
    df = spark.createDataFrame([("aa1", "x"), ("aa2", ""), ("b", None), ("bc", "ü")], "name string, content string")
    for _ in range(2):
        sinks.write_sample_files(df, str(tmp_path / "out"))
    found = samples.scan_samples(spark, str(tmp_path / "out"))
    assert sorted((r["name"], bytes(r["content"])) for r in found.collect()) == [
        ("aa1", b"x"), ("aa2", b""), ("b", b""), ("bc", "ü".encode()),
    ]


def test_scanned_files_are_not_listed_by_the_driver(spark, tmp_path):
    for i in range(30):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"{i:03d}.gz").write_bytes(b"x" * i)
    found = samples.scan_samples(spark, str(tmp_path))
    # a scan of Spark's holds every path in the plan
    assert found.inputFiles() == []
    got = {r["name"]: bytes(r["content"]) for r in found.collect()}
    assert got == {f"{i:03d}.gz": b"x" * i for i in range(30)}


def test_long_lists_leave_their_task_in_parts(tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"f{i}").write_bytes(b"x")
    monkeypatch.setattr(samples, "LISTED_ROWS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([str(tmp_path)])], ["path"])
    assert [b.num_rows for b in samples._lister(True)([batch])] == [10, 10, 5]
