"""Stored tables follow their files."""

from __future__ import annotations

import os

from tallyloom.plans import store


def test_changed_files_make_a_new_table(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    ask = lambda: store.stored(spark, str(tmp_path), "sums", lambda: spark.read.parquet(source).groupBy().sum())
    spark.range(4).write.parquet(source)
    assert ask().first()[0] == 6 and ask().inputFiles() == ask().inputFiles()
    spark.range(5).write.mode("overwrite").parquet(source)
    assert ask().first()[0] == 10
    files = [f.removeprefix("file://") for f in ask().inputFiles()]
    assert all(os.path.exists(f) for f in files)
    store.release(spark)
    assert not any(os.path.exists(f) for f in files) and ask().first()[0] == 10
