"""Stored stand-in tables and the shared folder."""
import os
import shutil
import time

from ledgerspark.session import checkpoint_dir
from ledgerspark.sources import testdata as td


def test_checkpoint_dir_is_stable(spark):
    assert len({checkpoint_dir(spark) for _ in range(3)}) == 1


def test_changed_input_is_read_again(spark, tmp_path):
    src = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(src)
    read = lambda: td.stored(spark, str(tmp_path), "probe", lambda: spark.read.parquet(src), ("t",))
    assert read().count() == 3 and read().count() == 3
    time.sleep(0.01)
    shutil.rmtree(src)
    spark.range(5).write.parquet(src)
    assert read().count() == 5
    assert os.path.isdir(checkpoint_dir(spark))
