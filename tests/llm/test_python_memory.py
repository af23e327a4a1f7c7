"""What the Python workers of the pipeline's stages hold at a time, read off the plans that are written."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from statflow.llm import grouping, queries, simhash

LIMIT = 4 << 20  # bytes of a batch of texts or sets


def _nodes(plan, python=0):
    """(name, Python functions of the same stage above it and in it) of each node."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
        name = plan.nodeName()
    python = 0 if "Exchange" in name else python + ("Python" in name or "InArrow" in name or "InPandas" in name)
    yield name, python
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k), python)


@pytest.fixture
def written(monkeypatch):
    """Of each write: the nodes of its plan, the most bytes of an Arrow batch."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        most = self._spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
        seen.append((list(_nodes(self._df._jdf.queryExecution().executedPlan())), int(most.rstrip("bB"))))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def _held_little(written):
    assert any(n for nodes, _ in written for _, n in nodes), "no Python seen"
    for nodes, most in written:
        names = [name for name, _ in nodes]
        assert max(n for _, n in nodes) <= 1, names  # one worker a task
        assert not any("ExistingRDD" in name for name in names), names  # Python workers only to read a small table
        if any("ArrowEvalPython" in name or "GroupsInArrow" in name for name in names):
            assert most <= LIMIT, names


@pytest.fixture
def docs(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words, f"x{i % 7}", f"y{i // 7 % 2}"])) for i in range(40)]
    rows += [(100 + i, " ".join(f"z{i}v{k}" for k in range(80))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_dedup_holds_one_worker_a_task_and_small_batches(docs, written):
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 120)]
    _held_little(written)


def test_components_hold_one_worker_a_task_and_small_batches(docs, written):
    assert simhash.components(docs).count() == 60
    _held_little(written)


def test_pack_holds_small_batches(docs, written, tmp_path):
    out = grouping.pack(docs, queries.vocabulary())
    out.write.parquet(f"{tmp_path}/packed")
    small, lazy = written[:-1], written[-1:]
    _held_little(small)
    assert not any("ExistingRDD" in name for nodes, _ in lazy for name, _ in nodes)


def test_sets_are_views_of_their_column():
    sets = [np.arange(k, dtype=np.uint64) * 7 for k in (3, 0, 5, 1)]
    for kind in (pa.binary(), pa.large_binary()):
        whole = pa.array([x.tobytes() for x in sets], kind)
        column = pa.chunked_array([whole.slice(1, 2), whole.slice(3), whole[:0], whole])
        got = simhash._words(column)
        assert [x.tolist() for x in got] == [x.tolist() for x in (*sets[1:], *sets)]
        assert not any(x.flags.owndata for x in got)
