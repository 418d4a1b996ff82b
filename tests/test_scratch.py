"""Scratch tables: scopes of several threads, and where they may lie."""

from __future__ import annotations

import threading

import pytest

from tideline.plans import scratch


def test_scopes_of_threads_are_apart(spark):
    opened, written, kept = threading.Event(), threading.Event(), []

    def batch():
        with scratch.scratch_scope(spark):
            kept.append(scratch.freeze(spark.range(3), "inner"))
            opened.set()
            assert written.wait(60)

    thread = threading.Thread(target=batch)
    thread.start()
    assert opened.wait(60)
    outer = scratch.freeze(spark.range(5), "outer")
    written.set()
    thread.join()
    assert outer.count() == 5 and scratch.rows_of(outer) == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        kept[0].count()


def test_inner_scope_ends_first(spark):
    with scratch.scratch_scope(spark):
        a = scratch.freeze(spark.range(2), "a")
        with scratch.scratch_scope(spark):
            scratch.freeze(spark.range(2), "b")
        assert a.count() == 2


class _Session:
    """What the folder depends on, with settings that a test cannot give a running session."""

    def __init__(self, spark, master: str, **settings: str) -> None:
        self._jvm, self._jsc, self._settings = spark._jvm, spark._jsc, settings
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = self

    def get(self, key: str, default: str | None = None) -> str | None:
        return self._settings.get(key, default)


def test_no_local_folder_on_a_cluster(spark):
    local = {"spark.sql.warehouse.dir": "file:/tmp/warehouse/"}
    assert scratch.scratch_root(_Session(spark, "local[2]", **local)) == "file:/tmp/warehouse/_tideline"
    assert scratch.scratch_root(_Session(spark, "yarn", **local, **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_root(_Session(spark, master, **local))
