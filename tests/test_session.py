"""Written tables: where they go and when they are removed."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from loomwright import session


def _folder(spark) -> str:
    return f"{session.shared_dir(spark)}/loomwright-{spark.sparkContext.applicationId}".removeprefix("file://")


def test_scratch_removes_its_tables(spark):
    with session.scratch(spark) as tables:
        inner = session.materialise(spark.range(5), "gone")
        kept = tables.keep(inner.where("id > 1"), "kept")
        assert inner.count() == 5
    assert kept.count() == 3
    left = os.listdir(_folder(spark))
    assert any(x.startswith("kept-") for x in left) and not any(x.startswith("gone-") for x in left)


def test_scopes_nest(spark):
    with session.scratch(spark):
        with session.scratch(spark) as tables:
            kept = tables.keep(spark.range(3), "nested")
        assert kept.count() == 3
    assert not any(x.startswith("nested-") for x in os.listdir(_folder(spark)))


def test_stored_tables_outlive_scopes_and_are_built_again_if_lost(spark):
    import shutil

    built = []
    build = lambda: built.append(1) or session.materialise(spark.range(7), "stored")
    with session.scratch(spark):
        first = session.stored(spark, "a test's", build)
    assert first.count() == 7 and session.stored(spark, "a test's", build) is first and built == [1]
    for x in os.listdir(_folder(spark)):
        if x.startswith("stored-"):
            shutil.rmtree(f"{_folder(spark)}/{x}")
    assert session.stored(spark, "a test's", build).count() == 7 and built == [1, 1]


class _Unset:
    """A session without the setting, on the given master."""

    def __init__(self, master: str):
        self.sparkContext = self.conf = self
        self.master, self.applicationId = master, f"app-{master}"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return default


def test_no_shared_folder_on_a_cluster_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Unset("spark://host:7077"))


def test_a_local_session_without_the_setting_gets_one_folder():
    assert session.shared_dir(_Unset("local[2]")) == session.shared_dir(_Unset("local[2]"))
    code = """
from pyspark.sql import SparkSession
from loomwright.session import materialise
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None), "set by the image"
print("ROWS", materialise(spark.range(4), "x").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(__file__)))
    if "set by the image" in done.stderr:
        pytest.skip("the image sets a shared folder for all sessions")
    assert "ROWS 4" in done.stdout, done.stderr[-2000:]
