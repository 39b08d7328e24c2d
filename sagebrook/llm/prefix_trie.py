"""Prefix trie of conversations, built as a burst trie.

A node is named by a hash chain over its turns, so equal prefixes have equal
names wherever they lie. Equal conversations combine first. The heads of the trie
are the root and every prefix with more than ``CONTAINER`` distinct conversations
below it; below a head hangs a container for each next turn, with the suffixes of
the conversations that go on with it. A container that grows too large has
burst, and its prefix is a head: which prefixes that holds for is counted for all depths in one
aggregate, not burst level by level. Containers are dealt to tasks, sorted by
suffix and swept into nodes with a stack; the few heads sum up what hangs below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, attach, stored

#: A container holds at most so many distinct conversations.
CONTAINER = 512
#: So many heads are broadcast (some 50 bytes each); more are joined through a shuffle.
BROADCAST_HEADS = 65_536
#: Ids of equal conversations are joined to texts of about so many characters before they meet.
CHUNK = 1 << 16
_ROOT = b""
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ROWS = 8192


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, path): a row a conversation, its turns as an array of (id, words) in order of turn, null first.

    A turn's id is half a SHA-256 of role and text, null ones empty; turns with the same
    number are ordered by id, repeated rows are turns of their own. Rows without a conversation id go. Texts
    end here: 20 bytes a turn go on.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"),
        F.struct(turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"), name.alias("id"), F.regexp_count(text, F.lit(f"[^{SPACES}]+")).alias("words")).alias("t"),
    ).where("conv IS NOT NULL")
    path = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return rows.groupBy("conv").agg(path.alias("path"))


def rebuilt_paths(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``every`` (the multiple at or below c), h = crc32(c) % ``most``.

    A conversation that isn't there has no turns to give. One meets at most ``every`` conversations, over its first turns only.
    """
    c = F.col("conv")
    first = paths.where(c % every == 0).select(c.alias("base"), F.slice("path", 1, most - 1).alias("first"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    joined = paths.select("conv", "path", (c - F.pmod(c, F.lit(every))).alias("base"), h.alias("h")).join(first, "base", "left")
    given = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("path", 1, 0))
    return joined.select("conv", F.concat(given, F.slice(F.col("path"), F.col("h") + 1, F.size("path"))).alias("path"))


def _chained(paths: DataFrame) -> DataFrame:
    """(conv, nodes, words, finish): the names of a conversation's prefixes from one turn on; the last, or the root's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for ids in batch.column(1):
                at, own = _ROOT, []
                for turn in ids.as_py():
                    at = hashlib.sha256(at + turn).digest()[:16]
                    own.append(at)
                nodes.append(own)
            ends = pa.array([own[-1] if own else _ROOT for own in nodes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.list_(pa.binary())), batch.column(2), ends], ["conv", "nodes", "words", "finish"])

    flat = paths.select("conv", F.col("path.id").alias("ids"), F.col("path.words").alias("words"))
    return flat.mapInArrow(work, "conv long, nodes array<binary>, words array<int>, finish binary")


def _ends(chained: DataFrame) -> DataFrame:
    """(finish, rep, weight, ends_sha256): the conversations that end at a node, smallest and number, and the hash of all their ids.

    Sorted ranges split a node with very many members over tasks, which join ids to long texts; a hash runs over
    its members in order, so it is taken in one task from those texts, as a stream.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []

        def close() -> None:
            if ids:
                out.append((node, ids[0], len(ids), ",".join(map(str, ids))))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["finish", "first", "n", "ids"])

        for batch in batches:
            for finish, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if finish != node or size > CHUNK:
                    close()
                    node, ids, size = finish, [], 0
                ids.append(conv)
                size += 12
            if len(out) >= _ROWS or sum(len(o[3]) for o in out) > 1 << 22:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rep, weight, digest, out = None, None, 0, None, []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["finish", "rep", "weight", "ends_sha256"])

        for batch in batches:
            for finish, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or finish != node:
                    if digest is not None:
                        out.append((node, rep, weight, digest.hexdigest()))
                    node, rep, weight, digest = finish, first, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                weight += n
            if len(out) >= _ROWS:
                yield batch_of()
                out = []
        if digest is not None:
            out.append((node, rep, weight, digest.hexdigest()))
        if out:
            yield batch_of()

    texts = chained.select("finish", "conv").repartitionByRange("finish", "conv").sortWithinPartitions("finish", "conv").mapInArrow(joined, "finish binary, first long, n long, ids string")
    return texts.repartition("finish").sortWithinPartitions("finish", "first").mapInArrow(hashed, "finish binary, rep long, weight long, ends_sha256 string")


class _Open:
    """A node on the stack of a sweep, with its closed children, which wait for its smallest member."""

    __slots__ = ("children", "conv", "convs", "ends", "leaves", "node", "saved", "words")

    def __init__(self, node: bytes, words: int):
        self.node, self.words = node, words
        self.conv, self.convs, self.leaves, self.saved, self.ends, self.children = None, 0, 0, 0, _NONE, []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, from rows (head, head_conv, depth, rep, weight, ends_sha256, nodes, words) sorted by container and suffix.

    Open are the nodes of the last suffix; closed ones wait only for their parent, so a task holds a part of a container at most.
    """
    kinds = (*[pa.int64()] * 7, pa.string(), pa.binary())
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "head"]
    stack: list[_Open] = []
    out: list[tuple] = []
    head, head_conv, depth = _ROOT, None, 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            done = stack.pop()
            level = depth + len(stack) + 1
            done.leaves = done.leaves or 1
            done.saved += (done.convs - 1) * done.words
            for child in done.children:
                out.append((child[0], level + 1, done.conv, *child[1:], None))
            row = (done.conv, done.convs, len(done.children), done.leaves, done.saved, done.ends)
            if stack:
                above = stack[-1]
                above.children.append(row)
                above.leaves += done.leaves
                above.saved += done.saved
                above.convs += done.convs
                above.conv = done.conv if above.conv is None else min(above.conv, done.conv)
            else:
                out.append((row[0], level, head_conv, *row[1:], head))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    for batch in batches:
        for row in range(batch.num_rows):
            new_head, new_conv, new_depth, rep, weight, ends, nodes, words = (c[row].as_py() for c in batch.columns)
            same = 0
            while same < min(len(stack), len(nodes)) and stack[same].node == nodes[same]:
                same += 1
            close(same)
            head, head_conv, depth = new_head, new_conv, new_depth
            stack.extend(map(_Open, nodes[same:], words[same:]))
            last = stack[-1]  # a shorter suffix sorts before those that go on from it, so it is fresh
            last.conv, last.convs, last.ends = rep, weight, ends
            if len(out) >= _ROWS:
                yield batch_of()
                out.clear()
    close(0)
    if out:
        yield batch_of()


def prefix_trie(paths: DataFrame, container: int = CONTAINER) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie of ``paths`` (conv, path).

    ``conv_id`` is a node's smallest member, ``saved_tokens`` sums the words that members after the first needn't compute
    over the subtree, ``ends_sha256`` hashes the members that end at the node, their ids ascending and joined by commas. Conversations without turns are
    members of the root; without conversations there is no node. Equal conversations are one suffix with a weight, so a
    conversation that very many repeat costs one row. A conversation's chain (20 bytes a turn) is one row. Paths, copies and nodes are stored when this is called.
    """
    spark = paths.sparkSession
    chained = stored(_chained(paths), "trie-paths")
    ends = stored(_ends(chained), "trie-ends")
    all_convs = ends.agg(F.min("rep").alias("conv"), F.sum("weight").alias("n"), F.count(F.lit(1)).alias("distinct")).head()
    if not all_convs["n"]:
        return spark.createDataFrame([], _NODE)
    sequences = stored(chained.withColumnRenamed("conv", "rep").join(ends.drop("finish"), "rep").where(F.size("nodes") > 0), "trie-sequences")

    prefixes = sequences.select("rep", "weight", F.posexplode("nodes").alias("pos", "node"))
    counted = prefixes.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), (F.max("pos") + 1).cast("long").alias("depth"))
    heads = stored(counted.where(F.col("n") > container), "trie-heads")
    n_heads = heads.count()
    facts = heads.select("node", "n", F.struct("depth", F.col("node").alias("head"), F.col("conv_id").alias("head_conv")).alias("h"))
    if n_heads <= BROADCAST_HEADS:
        met = prefixes.join(F.broadcast(facts), "node")
    else:
        met = attach(prefixes, facts, "node", "n", all_convs["distinct"]).where("h IS NOT NULL")
    lowest = met.groupBy("rep").agg(F.max("h").alias("h"))
    top = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("head"), F.lit(all_convs["conv"]).cast("long").alias("head_conv"))
    pieces = sequences.join(lowest, "rep", "left").withColumn("h", F.coalesce("h", top)).where(F.size("nodes") > F.col("h.depth"))
    below = lambda c: F.slice(F.col(c), F.col("h.depth").cast("int") + 1, F.size(c))
    dealt = pieces.select("h.head", "h.head_conv", "h.depth", "rep", "weight", "ends_sha256", below("nodes").alias("nodes"), below("words").alias("words"))
    dealt = dealt.withColumn("container", F.element_at("nodes", 1)).repartition("container").sortWithinPartitions("container", "nodes")
    swept = stored(dealt.drop("container").mapInArrow(_sweep, _NODE + ", head binary"), "trie-nodes")

    root = spark.range(1).select(
        F.lit(_ROOT).alias("node"), F.lit(all_convs["n"]).cast("long").alias("n_convs"), F.lit(all_convs["conv"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("words"), F.array(F.lit(_ROOT)).alias("above"))
    at = F.col("depth").cast("int")
    own = heads.join(sequences.select(F.col("rep").alias("conv_id"), "nodes", F.col("words").alias("all_words")), "conv_id").select(
        "node", "n_convs", "conv_id", "depth", F.coalesce(F.get("nodes", at - 2), F.lit(_ROOT)).alias("parent"), F.get("all_words", at - 1).alias("words"),
        F.concat(F.array(F.lit(_ROOT)), F.slice(F.col("nodes"), F.lit(1), at)).alias("above"))
    every = root.unionByName(own)
    hung = swept.where("head IS NOT NULL").groupBy(F.col("head").alias("node")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    under = own.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("under"))
    every = every.join(hung, "node", "left").join(under, "node", "left").fillna(0, ["hung", "under", "leaves", "saved"])
    every = every.withColumns({"n_children": F.col("hung") + F.col("under"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")})
    totals = every.select(F.explode("above").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = every.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = (
        every.drop("leaves", "saved").join(totals, "node").join(parents, "parent", "left")
        .join(ends.select(F.col("finish").alias("node"), "ends_sha256"), "node", "left")
        .withColumns({"ends_sha256": F.coalesce("ends_sha256", F.lit(_NONE)), "n_leaves": F.greatest("n_leaves", F.lit(1))})
    )
    columns = [c.split()[0] for c in _NODE.split(", ")]
    return swept.select(*columns).unionByName(rows.select(*columns))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", container: int = CONTAINER, every: int = 20, most: int = 4) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table of turns."""
    return prefix_trie(rebuilt_paths(conversation_paths(turns, conv_col, turn_col, role_col, text_col), every, most), container)
