"""Durable intermediates.

Everything that cuts lineage goes to a folder that all executors share, so that
a lost executor costs a recomputation of its running tasks and nothing else: the
checkpoint folder of the context where one is set, else the one the cluster names in
``spark.checkpoint.dir``. Only on a local master (tests, notebooks) a folder of
our own serves where neither is set; elsewhere that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows a shuffled part holds where their number is known.
PART_ROWS = 1 << 20
#: Bytes of an Arrow batch where whole texts or sets go to Python: an executor and its workers hold a few per task.
BATCH_BYTES = 4 << 20
_own: str | None = None
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; sets the context's checkpoint folder where unset."""
    global _own
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or tempfile.mkdtemp(prefix="statflow-")
        folder = f"file://{_own}"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def part_count(spark: SparkSession, rows: int) -> int:
    """Into how many parts so many rows are shuffled: the session's number, more where that makes parts too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS + 1)


def materialize(df: DataFrame, name: str = "part", rows: int = 0, batch: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it back.

    Smaller than a checkpoint (columnar, compressed) and prunable: later readers
    load only the columns they use, and its size tells Catalyst whether a join may
    broadcast. With ``rows``, how many its shuffles move about, they get as many parts
    as keep a task's share bounded. With ``batch``, Arrow batches for Python hold about so many bytes, however
    long their rows, not a number of rows.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/statflow/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    conf, wanted = df.sparkSession.conf, {"spark.sql.shuffle.partitions": str(part_count(df.sparkSession, rows))}
    if batch:
        wanted["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch)
    own = {key: conf.get(key) for key in wanted}
    changed = [key for key in wanted if own[key] != wanted[key]]
    for key in changed:
        conf.set(key, wanted[key])
    try:
        df.write.parquet(path)
    finally:
        for key in changed:
            conf.set(key, own[key])
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._statflow_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialized frame that nothing reads any more: the old state of a loop."""
    path = getattr(df, "_statflow_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``materialize`` has written inside, but for frames passed to the function it gives."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_statflow_path", None))
        return df

    yield keep
    for path in [p for p in _written if p not in before and p not in kept]:
        _written.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what ``materialize`` has written. DataFrames that still read it fail afterwards."""
    while _written:
        _delete(spark, _written.pop())


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        spark = SparkSession.getActiveSession()
        if spark is not None:
            release(spark)
