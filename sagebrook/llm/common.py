"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regex class body.
SPACES = r" \t\n\x0B\f\r"
HOT_KEYS = 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sagebrook-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder, or the run's, that no other run uses."""
    return f"{_RUN.get() or shared_dir(spark) + '/sagebrook'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All tables that operators store within the block lie in one folder, which is removed at its end.

    Results are lazy: write them elsewhere before the block ends.
    """
    folder = new_path(spark, "run")
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        from pyarrow import fs

        path = local_path(folder)
        store, path = (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(folder)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, and what costs much to compute is computed once; a
    lost executor costs no more than the tasks that it was running.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands memory that this process has freed back to the system; otherwise allocators keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def giving_back(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``work`` over Arrow batches whose worker keeps no memory of it after a task: Spark goes on using its Python workers, and idle ones stay."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def text_of(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def packed(df: DataFrame, **new: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, beside ``new``: no names can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in new.items()])


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row a key and its number of rows.

    A key with over ``total / HOT_KEYS`` rows is hot: there are at most
    ``HOT_KEYS`` such keys, so their facts are broadcast and their rows don't
    move. All other keys go through a shuffle join, none of them large.
    """
    least = max(1000, total // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col(weight) > least))
    cold = facts.where(F.col(weight) <= least)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far.select(*near.columns))


def local_path(uri: str) -> str | None:
    """The path if the URI names a mounted file system, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if os.path.isabs(uri) else None
