"""Archives that several jobs append to, failed jobs, and what they leave."""

import pytest
from palisade.llm import media
from pyspark.sql import functions as F


def rows(spark, a, b):
    return spark.createDataFrame([(i, f"text {i}") for i in range(a, b)], "doc_id long, text string").repartition(2)


def names(spark, path):
    return sorted(int(r.name[3:]) for r in media.read_media(spark, path).select("name").collect())


def test_jobs_append_to_each_other(spark, tmp_path):
    path = str(tmp_path / "a")
    for a, b in ((0, 5), (5, 6), (6, 6), (6, 9)):
        media.write_media(rows(spark, a, b), path)
        assert names(spark, path) == list(range(b))
    media.write_media(rows(spark, 20, 23), path, mode="overwrite")
    assert names(spark, path) == [20, 21, 22] and len(list((tmp_path / "a").glob("_list-*"))) == 1
    assert {f.name[:32] for f in (tmp_path / "a").glob("*.tar")} == {f.name[6:38] for f in (tmp_path / "a").glob("_list-*")}


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "a")
    media.write_media(rows(spark, 0, 4), path)
    before = sorted(f.name for f in (tmp_path / "a").iterdir())
    bad = rows(spark, 4, 40).withColumn("text", F.when(F.col("doc_id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            media.write_media(bad, path, mode=mode)
        assert names(spark, path) == [0, 1, 2, 3]
    assert sorted(f.name for f in (tmp_path / "a").iterdir() if not f.name.startswith(".")) == [n for n in before if not n.startswith(".")]


def test_attempts_that_did_not_commit_are_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    media.write_media(rows(spark, 0, 4), path)
    job = next((tmp_path / "a").glob("*.tar")).name[:32]
    for name in (f"{job}-{'0' * 32}.tar", f"{'1' * 32}-{'0' * 32}.tar", f"{'1' * 32}-{'0' * 32}.tar.idx"):
        (tmp_path / "a" / name).write_bytes(b"half an archive")
    assert names(spark, path) == [0, 1, 2, 3]
    assert media.sweep(path) == 0 and media.sweep(path, older_s=-60) == 2 and names(spark, path) == [0, 1, 2, 3]


def test_further_columns_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a", "x", 2), (1, "a", "x", 2), (None, None, None, None)], "doc_id long, text string, name string, media long")
    got = media.media_columns(d).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
