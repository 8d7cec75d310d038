"""Folders of intermediate tables are deleted by whoever owns them."""

from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path

import __spark_entry__ as entry
from silvermart.plans import workspace
from silvermart.sources.store import SHUFFLES_GO, TableStore, shuffles_go
from tests.conftest import DATA

SESSION = """
import sys
from silvermart.session import local_session
from silvermart.plans.workspace import workspace
spark = local_session("scratch", "2", **{"spark.sql.warehouse.dir": sys.argv[1], "spark.ui.enabled": "false"})
w = workspace(spark, sys.argv[2])
w.scratch.write("numbers", spark.range(10))
assert w.scratch.open(w.store.write("numbers", spark.range(10))).count() == 10
print("written below", w.store.root)
"""


def test_dropping_says_how_many_files_went(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.drop_all() == 0
    store.write("numbers", spark.range(0, 10, 1, 3))
    # Three files of data and the mark of success.
    assert store.drop_all() == 4
    assert not (tmp_path / "s").exists()


def test_the_tables_of_a_session_go_with_it(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", SESSION, str(tmp_path), DATA],
        cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=240, check=True,
    )
    root = Path(run.stdout.split("written below")[1].strip().removeprefix("file:"))
    # The JVM ends shortly after the program that started it.
    for _ in range(60):
        if not root.exists():
            break
        time.sleep(0.5)
    assert not root.exists()


def test_a_refresh_for_its_report_leaves_nothing(spark, tmp_path, monkeypatch):
    out = tmp_path / "out"
    monkeypatch.setattr(entry, "scratch_root", lambda spark, purpose: str(out))
    report = entry._full_refresh(spark, DATA)
    assert not out.exists()
    assert report.count() == 10


def shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*") if f.is_file()}


def test_shuffles_go_with_the_write_that_made_them(spark, store):
    setting = spark.conf.get(SHUFFLES_GO)
    before = shuffle_files(spark)
    rows = spark.range(10_000).selectExpr("id % 100 as k").groupBy("k").count()
    table = store.write("counted", rows)
    for _ in range(20):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.25)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLES_GO) == setting
    # Neither the table nor what it was made of is lost.
    assert store.open(table).count() == rows.count() == 100


def test_the_setting_comes_back_when_the_last_thread_has_left(spark):
    setting = spark.conf.get(SHUFFLES_GO)
    with shuffles_go(spark):
        with shuffles_go(spark):
            assert spark.conf.get(SHUFFLES_GO) == "true"
        assert spark.conf.get(SHUFFLES_GO) == "true"
    assert spark.conf.get(SHUFFLES_GO) == setting


def test_tables_of_a_layer_go_when_the_layer_is_written(spark, no_broadcast, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "scratch_root", lambda spark, purpose: str(tmp_path / "w"))
    w = workspace.Workspace(spark, DATA)
    assert w.fact.count() and w.trusted.count()
    left = {f.relative_to(tmp_path / "w/scratch").parts[0] for f in (tmp_path / "w/scratch").rglob("*.parquet")}
    # The members with their weights, which the dimensions are read from.
    assert left == {"slices"}
