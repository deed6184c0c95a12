"""The shared folder, staged tables, and blocks."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from llm_cases import frame, prose

from skirmish.llm import common


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    conf = SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/")
    assert common.shared_dir(SimpleNamespace(conf=conf)) == "hdfs://x/y"


def test_rows_without_id_spread_over_blocks(spark):
    docs = frame(spark, [(None, prose(i, 30)) for i in range(200)])
    blocked, n = common.in_blocks(docs, "doc_id", 2000)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert n > 5 and len(sizes) > n / 2 and max(sizes) < 100


def test_staged_tables_go_when_nothing_reads_them(spark):
    scratch = common.Scratch()
    one, two = (scratch.staged(spark.range(5), f"scratch-test-{k}") for k in "ab")
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    assert len(list(folder.glob("scratch-test-*"))) == 2
    scratch.clear(two)
    assert [p.name[:14] for p in folder.glob("scratch-test-*")] == ["scratch-test-b"] and two.count() == 5
    scratch.clear()
    assert not list(folder.glob("scratch-test-*"))
