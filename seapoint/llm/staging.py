"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_block: ContextVar[str | None] = ContextVar("block", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is named and all runs on one machine (tests), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seapoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_block.get() or shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: a lost executor costs no more than one stage.

    A join of two staged tables also stays a plain shuffled join, whose hot partitions adaptive
    execution can split.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged in the block is deleted at its end; the function that it gives stages tables that stay.

    Only such tables may be used after the block. Blocks may be nested: a table that stays goes with the outer one.
    """
    outer, inner = _block.get(), new_path(spark, "scratch")

    def kept(df: DataFrame, name: str) -> DataFrame:
        token = _block.set(outer)
        try:
            return staged(df, name)
        finally:
            _block.reset(token)

    token = _block.set(inner)
    try:
        yield kept
    finally:
        _block.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
