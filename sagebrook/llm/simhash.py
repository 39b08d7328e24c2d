"""SimHash near-duplicates by pivot distance tables.

Distinct fingerprints are dealt into buckets that agree on a bit mask (with at
most three differing bits, one of four blocks agrees). In a bucket each
fingerprint has a row in a table of Hamming distances to reference
fingerprints, the pivots: by the triangle inequality two fingerprints within
three bits differ by at most three in every coordinate, so a pair whose largest
coordinate difference is more is discarded, and the survivors are verified.
Random distances to pivots crowd around 32 of 64, too close together to deal
pairs out by themselves; so blocks deal and pivots discard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, giving_back, stored, text_of
from .exact_dedup import without_rows

SEED = 42
SHINGLE = 3
MAX_BITS_APART = 3
PIVOTS = np.random.default_rng(20240607).integers(0, 1 << 64, 32, dtype=np.uint64)
#: Buckets above this many fingerprints (or above a 65,536th of the dealt rows) are dealt anew by a longer mask.
BUCKET = 4096
MASK_LEVELS = 5


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the shingles of lower-cased words, repeats included; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, n - SHINGLE + 1)].tolist()
    ends = ends[min(n, SHINGLE) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for part in range(0, len(h), 8192):  # 64 bytes a shingle
        bits = np.unpackbits(h[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp) for each row, fp as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).cast("binary").alias("text"))

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def masks(level: int) -> list[int]:
    """Bit masks of a level; masks 4i to 4i+3 extend mask i of the level before.

    Each extension splits the bits that are still free into four blocks, one of
    which agrees if at most three bits differ.
    """
    out = [0]
    for _ in range(level):
        longer = []
        for mask in out:
            free = [b for b in range(64) if not mask >> b & 1]
            for k in range(4):
                part = free[len(free) * k // 4 : len(free) * (k + 1) // 4]
                longer.append(mask | sum(1 << b for b in part))
        out = longer
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _with_keys(rows: DataFrame, level: int, parent: bool) -> DataFrame:
    """(fp, mask, key): a row for each mask of the level, or for each extension of the row's own."""
    every = F.array(*[F.lit(_signed(m)) for m in masks(level)])
    number = F.explode(F.expr("sequence(mask * 4, mask * 4 + 3)") if parent else F.sequence(F.lit(0), F.lit(4**level - 1)))
    return rows.select("fp", number.alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.element_at(every, F.col("mask") + 1)).alias("key")
    )


def _near(fps: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) within MAX_BITS_APART: pivot coordinates discard, then the bits decide."""
    for coordinate in table:
        if not len(i):
            return i, j
        keep = np.abs(coordinate[i] - coordinate[j]) <= MAX_BITS_APART
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS_APART
    return i[keep], j[keep]


def _pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[None, :] ^ PIVOTS[:, None]).astype(np.int8)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(fps: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near within each bucket: at most one a fingerprint.

    Small buckets compare neighbours at growing distance, all buckets at once;
    in a large one, sorted by the first coordinate, only those within three in
    that coordinate meet, in blocks. A forest leaves instead of all pairs.
    """
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    table = _pivot_table(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 64, sizes)
    left, right = [], []
    for lag in range(1, int(min(64, sizes.max()))):
        i = np.flatnonzero(small[:-lag] & (bucket[lag:] == bucket[:-lag]))
        if not len(i):
            break
        i, j = _near(fps, i, i + lag, table)
        left.append(i), right.append(j)
    for s, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        order = s + np.argsort(table[0, s : s + size], kind="stable")
        first = table[0, order]
        stop = np.searchsorted(first, first + MAX_BITS_APART, "right")
        at = 0
        while at < size:
            to = min(size, at + max(1, 1_000_000 // (size - at)))
            a, b = np.meshgrid(np.arange(at, to), np.arange(at, stop[to - 1]), indexing="ij")
            keep = (b > a) & (b < stop[at:to, None])
            i, j = _near(fps, order[a[keep]], order[b[keep]], table)
            if len(i):  # a forest of this block is enough
                own = np.unique(np.r_[i, j])
                root = own[_roots(len(own), np.searchsorted(own, i), np.searchsorted(own, j))]
                left.append(own[root != own]), right.append(root[root != own])
            at = to
    if not left:
        return fps[:0], fps[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    root = _roots(n, i, j)
    leaf = np.flatnonzero(root != np.arange(n))
    return fps[leaf], fps[root[leaf]]


@giving_back
def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (mask, key); a bucket that goes on in the next batch waits for it."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def links(part: list[np.ndarray]) -> pa.RecordBatch:
        fps, mask, key = part
        bucket = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]) if len(fps) else fps
        a, b = bucket_links(fps.view(np.uint64), bucket)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        part = [np.r_[r, c.to_numpy().astype(np.int64)] for r, c in zip(rest, batch.columns)]
        if not len(part[0]):
            continue
        ended = np.flatnonzero((part[1] != part[1][-1]) | (part[2] != part[2][-1]))
        open_from = int(ended[-1]) + 1 if len(ended) else 0
        rest = [p[open_from:] for p in part]
        if open_from:
            yield links([p[:open_from] for p in part])
    yield links(rest)


def near_links(distinct: DataFrame, rows: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` fingerprints within three bits.

    The first masks are longer for more rows. A bucket that is too large is dealt
    anew by the four extensions of its mask; the last level's masks leave at most
    16 bits free, so no bucket there has over 2**16 fingerprints.
    """
    level = 1 if rows <= 1 << 22 else 2 if rows <= 1 << 36 else 3
    keyed = stored(_with_keys(distinct.select("fp"), level, False), "keys")
    found = []
    while True:
        if level < MASK_LEVELS:
            most = max(bucket, keyed.count() >> 16)
            hot = stored(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mask", "key"), "hot")
            any_hot = not hot.isEmpty()
        else:
            any_hot = False
        ready = keyed.join(F.broadcast(hot), ["mask", "key"], "left_anti").select("fp", "mask", "key") if any_hot else keyed  # at most 65,536 keys
        found.append(
            ready.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_link_batches, "a long, b long")
        )
        if not any_hot:
            break
        level += 1
        keyed = stored(_with_keys(keyed.join(F.broadcast(hot), ["mask", "key"], "left_semi").select("fp", "mask"), level, True), "keys")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, "links")


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint that has a link; equal roots are connected.

    Rounds of randomised contraction (Boegeholz, Brand and Todor, 2020): a hash of the node and the
    round ranks all nodes, each joins the first of itself and its neighbours, and links between what has
    come together vanish. Whatever the order of the nodes, a round is expected to leave
    at most three quarters of those that still have links. Each round is a stored table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    live = stored(both, "live")
    names = None
    turn = 0
    while not live.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        parent = stored(live.groupBy("a").agg(F.min(rank("b")).alias("low")).select("a", F.least(rank("a"), "low")["node"].alias("parent")), "parent")
        if names is None:
            names = stored(parent.select(F.col("a").alias("fp"), F.col("parent").alias("root")), "names")
        else:
            names = stored(
                names.join(parent.withColumnRenamed("a", "root"), "root", "left").select("fp", F.coalesce("parent", "root").alias("root")), "names"
            )
        other = parent.select(F.col("a").alias("b"), F.col("parent").alias("other"))
        live = stored(
            live.join(parent, "a").join(other, "b").where(F.col("parent") != F.col("other"))
            .select(F.col("parent").alias("a"), F.col("other").alias("b")).distinct(),
            "live",
        )
    return names if names is not None else links.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def _led(docs: DataFrame, id_col: str, text_col: str, bucket: int) -> DataFrame:
    """(doc_id, text_hash, fp, lead) of each row; ``lead`` is the row that names its component.

    That is the one with the smallest id, null ids last, and of those the smallest text hash.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    distinct = stored(rows.groupBy("fp").agg(first.alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    names = components(near_links(distinct, distinct.count(), bucket))
    named = stored(distinct.join(names, "fp").select("fp", "low", "n", "root"), "named")
    groups = stored(named.groupBy("root").agg(F.min("low").alias("lead"), F.count(F.lit(1)).alias("fps")), "groups")
    linked = attach(named, groups, "root", "fps", named.count()).select("fp", "n", "lead")
    alone = distinct.join(names.select("fp"), "fp", "left_anti").select("fp", "n", F.col("low").alias("lead"))
    facts = stored(linked.unionByName(alone), "facts")
    return attach(rows, facts, "fp", "n", rows.count()).select("doc_id", "text_hash", "fp", "lead")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row for each input row: doc_id, fingerprint, component_id (smallest doc_id reachable).

    A null text counts as empty; texts without words have fingerprint zero and
    are linked like any other. Equal fingerprints are always linked. A null id
    is no name: a component of null ids only has component_id null. Rows that
    repeat come out as often. An empty table gives no rows; other columns are ignored.
    """
    return _led(docs, id_col, text_col, bucket).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("lead.doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component, all columns as they came.

    The smallest id stays; of null ids only, the one with the smallest text hash; of rows that
    repeat id and text, any one. Empty texts are one component. Texts don't shuffle, but for such repeated rows.
    """
    found = _led(docs, id_col, text_col, bucket).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash")))
    found = stored(found.select("doc_id", "text_hash", "kept"), "decided")
    once = found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1")
    return without_rows(docs, id_col, text_col, found.where(~F.col("kept")), once)
