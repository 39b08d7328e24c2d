"""Exact dedup and sharding against brute force, on small tables with every odd case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sagebrook.llm import exact_dedup, sharding

SCHEMA = "doc_id long, text string, kept string, hash int, word0 int"


def odd_rows():
    rows = [(i, f"text {i % 37}", "x", i, i) for i in range(300)]
    rows += [(1000 + i, "the same text", "y", 0, 0) for i in range(200)]
    rows += [(2000, None, None, None, None), (2001, "", "z", 1, 1), (2002, " ", "z", 1, 1), (2003, "long " * 40000, "z", 1, 1)]
    return rows + [(3000, "own", "a", 1, 1), (3000, "own", "a", 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 10])
def test_exact_dedup(docs, max_bits):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    want = Counter((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, max_bits=max_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_drop_exact_duplicates(docs):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    want = {}
    for r in odd_rows():
        want[r[1] or ""] = max(want.get(r[1] or "", -1), r[0])
    assert Counter(r.doc_id for r in out.collect()) == Counter(want.values())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a", None, 1, 1), (None, "a", None, 1, 1), (5, "a", None, 1, 1), (None, "b", None, 1, 1)], SCHEMA)
    got = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(nulls).collect())
    assert got == Counter({(None, 5, False): 2, (5, 5, True): 1, (None, None, True): 1})
    assert exact_dedup.drop_exact_duplicates(nulls).count() == 2


def test_without_rows(spark, docs):
    """Rows go by id and text, null ids too; another text of the same id stays, and of repeated rows one."""
    extra = spark.createDataFrame([(3, "another text", None, 1, 1), (None, "x", None, 1, 1), (None, "y", None, 1, 1), (7, "twice", None, 1, 1), (7, "twice", None, 1, 1)], SCHEMA)
    every = docs.unionByName(extra.select(*docs.columns))
    keys = lambda rows: every.where(rows).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    dropped = keys("doc_id in (2000, 3000) or doc_id = 3 and text <> 'another text' or doc_id is null and text = 'x'")
    left = exact_dedup.without_rows(every, "doc_id", "text", dropped, keys("doc_id = 7 and text = 'twice'").distinct())
    assert left.columns == every.columns
    want = Counter(r[0] for r in odd_rows() if r[0] not in (3, 2000, 3000) and r[0] is not None) + Counter([3, 7])
    got = Counter(r.doc_id for r in left.collect())
    assert got - Counter([None] * got[None]) == want and left.where("doc_id is null and text = 'y'").count() == 1 and left.where("doc_id is null and text = 'x'").count() == 0


def test_filters_by_parts(spark, docs):
    """More rows than one filter holds: the same decisions by several filters."""
    assert exact_dedup.filter_parts(10**10) == 1024 and exact_dedup.filter_parts(1000, max_bits=1 << 12) == 4
    order = lambda df: sorted(map(str, df.collect()))
    assert order(exact_dedup.exact_dedup(docs)) == order(exact_dedup.exact_dedup(docs, max_bits=1 << 12))
    assert Counter(r.text for r in exact_dedup.drop_exact_duplicates(docs, max_bits=1 << 12).collect()) == Counter(r.text for r in exact_dedup.drop_exact_duplicates(docs).collect())


def test_filter_passes_lone_rows(docs):
    """Rows without a copy mostly pass straight through, repeated ones never do."""
    digests = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    bits = exact_dedup.filter_bits(digests.count())
    marked = exact_dedup.with_maybe(digests, exact_dedup.position_words(digests, bits, 2), bits)
    rows = {r.doc_id: r.maybe for r in marked.collect()}
    assert all(rows[i] for i in range(300)) and rows[2000] and rows[2001] and not rows[2003]


def test_shards_are_even(spark, docs):
    rows = sharding.shard_documents(docs, shards=4, slots=64).collect()
    text = defaultdict(list)
    for r in odd_rows():
        text[r[0]].append(r[1] or "")
    assert len(rows) == len(odd_rows())
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r.doc_id][0].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id][0].encode())
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_largest_first_and_rebalance(spark):
    sizes = [(k, (k * 7919) % 1000 + 1, 1) for k in range(200)]
    slots = spark.createDataFrame(sizes, "virtual_slot int, bytes long, rows long")
    first = sharding.first_map(slots, 8)
    loads, want = [0] * 8, {}
    for slot, size, _ in sorted(sizes, key=lambda s: (-s[1], s[0])):
        k = loads.index(min(loads))
        loads[k] += size
        want[slot] = k
    assert {r.virtual_slot: r.shard for r in first.collect()} == want
    grown = sharding.rebalance(first, slots, 9, 2).collect()
    now = Counter()
    for r in grown:
        now[r.shard] += r.bytes
    assert {r.version for r in grown} == {2} and len(grown) == 200
    assert max(now.values()) - min(now.values()) < 1000 and len(now) == 9
    moved = [r for r in grown if want[r.virtual_slot] != r.shard]
    assert sum(r.bytes for r in moved) < 0.25 * sum(s[1] for s in sizes)


def test_production_size_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in rows]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)


def test_repeated_rows_are_spread(spark):
    rows = [(i, f"text {i}") for i in range(1000)] + [(5000, "the same row again and again " * 20)] * 2000
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=16, slots=256)
    sizes = [r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert found.count() == 3000 and len(sizes) == 16 and max(sizes) < 1.1 * min(sizes)


def test_map_versions(spark, tmp_path):
    """A stored map is used again, another number of shards makes the next version, and a map without all slots is refused."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 90 as int)) AS text")
    folder = f"file:{tmp_path}/maps"
    first = sharding.shard_documents(docs, shards=4, slots=64, map_folder=folder)
    again = sharding.shard_documents(docs, shards=4, slots=64, map_folder=folder)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    more = sharding.shard_documents(docs, shards=5, slots=64, map_folder=folder)
    assert {r.map_version for r in more.select("map_version").distinct().collect()} == {2} and more.select("shard").distinct().count() == 5
    stay = first.select("virtual_slot", "shard").distinct().join(more.select("virtual_slot", F.col("shard").alias("now")).distinct(), "virtual_slot")
    moved, kept = stay.where("shard <> now").count(), stay.where("shard = now").count()
    assert 0 < moved < 0.5 * kept
    assert sharding.read_map(spark, folder, 1).select("version").distinct().collect()[0].version == 1
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_documents(docs, shards=4, slots=64, slot_map=sharding.read_map(spark, folder, 1).where("virtual_slot > 3"))
