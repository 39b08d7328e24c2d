"""Sharding through fixed virtual slots.

Each record hashes into one of a fixed number of slots; bytes and rows are
summed per slot, and a versioned map sends each slot to a shard. Rebalancing
edits the map, which has as many rows as there are slots whatever the input; every
version stays in the map's folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_of

SLOTS = 4096


def _deal(slots: DataFrame, shards: int, version: int) -> DataFrame:
    """Largest slot first to the least loaded shard; slots with a shard in ``fixed`` stay there.

    All rows of ``slots`` (virtual_slot, bytes, rows, fixed) meet in one array:
    their number is the fixed number of slots.
    """
    entry = F.struct(
        F.col("fixed").isNull().alias("free"), (-F.col("bytes")).alias("neg_bytes"), "virtual_slot", "rows", "fixed"
    )
    start = f"named_struct('loads', array_repeat(0L, {shards}), 'map', cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>))"
    step = """(acc, s) -> transform(array(coalesce(s.fixed, cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int))),
        k -> named_struct('loads', transform(acc.loads, (x, i) -> x - if(i = k, s.neg_bytes, 0L)),
                          'map', concat(acc.map, array(named_struct('virtual_slot', s.virtual_slot, 'shard', k, 'bytes', -s.neg_bytes, 'rows', s.rows)))))[0]"""
    dealt = slots.agg(F.array_sort(F.collect_list(entry)).alias("slots")).select(
        F.expr(f"aggregate(slots, {start}, {step}, acc -> acc.map)").alias("map")
    )
    return dealt.select(F.lit(version).alias("version"), F.inline("map"))


def slot_table(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, empty ones too."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, virtual_slot, shard, bytes, rows."""
    return _deal(slots.withColumn("fixed", F.lit(None).cast("int")), shards, 1)


def rebalance(old: DataFrame, slots: DataFrame, shards: int, version: int, slack: float = 0.0) -> DataFrame:
    """The next version of the map, for new slot sizes or another number of shards.

    A slot stays where it is while its shard, filled in order of falling size,
    keeps within the mean load times ``1 + slack``, and so does a shard's largest slot; only the others
    move, each to the shard with the least load. A shard number that is gone gives up all.
    """
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = slots.join(old.select("virtual_slot", "shard"), "virtual_slot", "left")
    mean = slots.agg((F.sum("bytes") / shards * (1 + slack)).alias("most"))
    fits = (F.col("shard") < shards) & ((F.sum("bytes").over(own) <= F.col("most")) | (F.count(F.lit(1)).over(own) == 1))
    kept = placed.crossJoin(F.broadcast(mean)).select(  # one row
        "virtual_slot", "bytes", "rows", F.when(fits, F.col("shard")).alias("fixed")
    )
    return _deal(kept, shards, version)


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Store a version of the map (one version in ``slot_map``) beside the others; a version is never replaced."""
    version = slot_map.select("version").first()["version"]
    slot_map.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A stored version of the map, by default the latest; None if there is none."""
    try:
        every = spark.read.parquet(folder)
    except AnalysisException as problem:  # no version has been written yet
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def _slots_of(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row.

    A slot is the hash of id and checksum. Rows that repeat more often than a slot has
    rows are alike in all that counts here: they are dealt one by one.
    """
    text = text_of(text_col)
    found = stored(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes"
    )
    hashed = found.withColumn("hash", F.xxhash64("doc_id", "text_crc32"))
    least = max(1, found.count() // slots)
    often = F.broadcast(hashed.groupBy("hash").count().where(F.col("count") > least).select("hash", F.lit(True).alias("often")))  # at most as many as slots
    place = F.when(F.col("often"), F.xxhash64("hash", F.monotonically_increasing_id())).otherwise(F.col("hash"))
    dealt = hashed.join(often, "hash", "left").withColumn("virtual_slot", F.pmod(place, F.lit(slots)).cast("int"))
    return stored(dealt.select("doc_id", "size", "text_crc32", "virtual_slot"), "records")


def shard_documents(
    docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", slot_map: DataFrame | None = None,
    map_folder: str | None = None,
) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Law ``bytes``: the shards' sizes (UTF-8 bytes plus one a row) are near
    equal. ``slot`` is the row's place in its shard, gapless from 0: the rows
    of the shard's earlier virtual slots, then the rank in its own. A null text
    has size 1. Null ids and rows that repeat an id are records like others; they
    are spread by their text's checksum, and those that repeat very often one by one. An empty table gives no rows.
    ``slot_map`` is a version of the map; it must have all slots, else this raises ValueError. Without
    it the latest version in ``map_folder`` counts; if that is for another number of shards, the next version is made from it
    and stored; without any, a first one is made from these documents, and stored if there is a folder.
    """
    spark = docs.sparkSession
    rows = _slots_of(docs, id_col, text_col, slots)
    if slot_map is None:
        held = read_map(spark, map_folder) if map_folder else None
        if held is None:
            slot_map = stored(first_map(slot_table(rows, slots), shards), "slot-map")
        elif held.agg(F.max("shard") + 1).first()[0] == shards:
            slot_map = held
        else:
            slot_map = stored(rebalance(held, slot_table(rows, slots), shards, held.first()["version"] + 1), "slot-map")
        if map_folder and slot_map is not held:
            write_map(slot_map, map_folder)
    if slot_map.where(F.col("virtual_slot").between(0, slots - 1)).agg(F.count_distinct("virtual_slot")).first()[0] != slots:
        raise ValueError(f"the map hasn't all {slots} slots")
    slot_map = slot_map.drop("rows").join(rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows")), "virtual_slot", "left")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(place) - 1)
        .join(F.broadcast(starts), "virtual_slot")  # as many rows as slots
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot", "map_version",
        )
    )
