"""Intermediate tables of these operators, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from callwarden.sources.checkpoints import ensure_checkpoint_dir


#: For tables of some 100 KB a value: pages and row groups are closed by size and not by number of rows.
LARGE_VALUES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 25), "parquet.enable.dictionary": "false"}

#: Spark's switch to remove an execution's shuffle files as it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _write(df: DataFrame, options: dict[str, str] | None, owner: Scratch | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    if owner is not None:
        owner.paths.append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options or {}).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write the frame once below `spark.checkpoint.dir` and read on from the files.

    The files survive lost executors and cut the lineage; those of the write's own shuffles go.  Inside of a `scratch` block
    the table lasts as long as the block.  Runs an action.
    """
    return _write(df, options, _scratch.get())


class Scratch:
    """The tables of a block, and the block around it."""

    def __init__(self, around: Scratch | None):
        self.around, self.paths = around, []

    def keep(self, df: DataFrame) -> DataFrame:
        """As `stored`, but the table outlasts the block: it is one of the block around, if there is any."""
        return _write(df, None, self.around)

    def drop(self) -> None:
        while self.paths:
            _delete(*self.paths.pop())


@contextmanager
def scratch():
    """Tables stored inside are deleted at the end, so that nothing lazy may read them afterwards; `keep` what is still needed."""
    own = Scratch(_scratch.get())
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        own.drop()


def forget(frame: DataFrame) -> None:
    """Delete the table of a frame that `stored` or `keep` gave; nothing lazy may read it afterwards."""
    _delete(frame.sparkSession, _paths.pop(frame))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) under these names whatever other columns there are."""
    return docs.select(docs[key].alias("key"), docs[text].alias("text"))
