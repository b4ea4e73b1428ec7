"""Text folders of many files: few tasks, the same rows as Spark's own file reader."""

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import readers, sinks


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(300):
        (root / f"case_{i}.txt").write_bytes(f"text {i}\r\nü\rend".encode())
    for name, body in (("empty.txt", b""), ("broken.txt", b"\xff\xfe\xfa"), ("a b%20.txt", b"odd name"), (".hidden", b"no"), ("_SUCCESS", b"no"),
                       ("_k=v.txt", b"yes"), ("late.txt._COPYING_", b"no")):
        (root / name).write_bytes(body)
    return root


def test_text_folder_takes_few_tasks(spark, folder, monkeypatch):
    got = readers.read_text_folder(spark, str(folder))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # files of 4 MB each were reckoned with, 10 tasks here
    monkeypatch.setattr(readers, "FILES_PER_TASK", 50)
    assert readers.read_text_folder(spark, str(folder)).rdd.getNumPartitions() == 7  # 303 files with text in them


def test_text_folder_has_the_rows_of_the_file_index(spark, folder, monkeypatch):
    own = readers.read_text_folder(spark, f"file://{folder}", 8)
    names = readers.folder_names(spark, str(folder))
    monkeypatch.setattr(readers, "FILE_BATCH_BYTES", 64)
    small = readers.read_text_folder(spark, str(folder), 8)
    monkeypatch.setattr(readers, "_mounted", lambda *a: None)
    index = readers.read_text_folder(spark, str(folder), 8)
    want = sorted(index.collect())
    assert len(want) == 302 and {r["input"] for r in want if r["filename"] == "case_7.txt"} == {"text 7\nü"}
    assert sorted(own.collect()) == want == sorted(small.collect())
    assert sorted(names.collect()) == sorted(readers.folder_names(spark, str(folder)).collect())


def test_text_folder_takes_patterns_and_missing_folders(spark, folder):
    assert readers.read_text_folder(spark, f"{folder}/case_1*.txt").count() == 111
    with pytest.raises(Exception):
        readers.read_text_folder(spark, f"{folder}/none").count()


def test_listing_is_fixed_when_it_is_made(spark, folder):
    names = readers.folder_names(spark, str(folder))
    (folder / "later.txt").write_text("x")
    assert names.where(F.col("filename") == "later.txt").count() == 0


def test_export_leaves_no_other_file(spark, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("f"), "id").alias("name"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("body"))
    for _ in range(2):  # a second export replaces the files
        sinks.export_text_files(df.repartition(5), str(tmp_path / "out"), "name", "body", encoding="utf-16")
    assert {p.name: p.read_text("utf-16") for p in (tmp_path / "out").iterdir()} == {f"f{i}": "é" * i for i in range(200)}
