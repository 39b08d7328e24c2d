"""Sorted hash arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, local_path


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array below ``folder``, under its name only when it is whole; a repeated task writes the same again."""
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
        with open(part, "wb") as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))


def mapped(folder: str, name: str, kind) -> np.ndarray:
    """A saved array as a memory map; from a store that isn't mounted, over a local copy without a name."""
    path = local_path(folder)
    if path is not None:
        file = f"{path}/{name}"
        return np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 22):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, kind, "r") if copy.tell() else np.zeros(0, kind)


def saved_shards(folder: str, name: str) -> frozenset[int]:
    """The shards that have been saved under ``name``."""
    from pyarrow import fs

    path = local_path(folder)
    store, path = (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(folder)
    files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return frozenset(int(f.base_name.split("-")[1].split(".")[0]) for f in files if f.base_name.startswith(f"{name}-") and f.base_name.endswith(".keys"))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key: its highest ``bits`` bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def save_sorted(df: DataFrame, folder: str, name: str, columns: dict[str, type], bits: int) -> list[int]:
    """Write (key, columns ...) as sorted arrays, a shard for each value of the key's highest ``bits`` bits; the shards with rows.

    A task holds one shard. Keys are distinct.
    """

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        shard = table["shard"][0].as_py()
        key = table["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        save(folder, f"{name}-{shard}.keys", key[order])
        for column, kind in columns.items():
            save(folder, f"{name}-{shard}.{column}", table[column].to_numpy()[order].astype(kind))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = df.select(shard.alias("shard"), "key", *columns).repartitionById(1 << bits, "shard")
    return sorted(r["shard"] for r in dealt.mapInArrow(work, "shard int").collect())  # a number for each shard


@functools.lru_cache(4096)
def opened(folder: str, name: str, shard: int, columns: tuple[tuple[str, type], ...]) -> list[np.ndarray]:
    return [mapped(folder, f"{name}-{shard}.{column}", kind) for column, kind in (("keys", np.uint64), *columns)]


def looked_up(folder: str, name: str, shards: frozenset[int], columns: tuple[tuple[str, type], ...], wanted: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the keys are known, and their values, 0 for the others: one pass over the mapped ranges.

    ``number`` is the shard of each key; shards ascend, and so do the keys of a shard.
    """
    known = np.zeros(len(wanted), bool)
    out = [np.zeros(len(wanted)) for _ in columns]
    edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(wanted) else []
    for a, b in zip(edges, [*edges[1:], len(wanted)]):
        if int(number[a]) not in shards:
            continue  # a shard without rows
        keys, *values = opened(folder, name, int(number[a]), columns)
        at = np.searchsorted(keys, wanted[a:b])
        at[at == len(keys)] = 0
        hit = keys[at] == wanted[a:b]
        known[a:b] = hit
        for k, value in enumerate(values):
            out[k][a:b][hit] = value[at[hit]]
    return known, out
