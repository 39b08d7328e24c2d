"""Scans, sinks, upserts, versions and incremental reads, all as DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.common import work_path


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, equal: Mapping[str, object] | None = None,
         one_of: Mapping[str, Sequence] | None = None, null: Sequence[str] = (), present: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """A projected and filtered Parquet scan; both reach the file reader."""
    df = spark.read.parquet(path)
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    for name, values in (one_of or {}).items():
        df = df.where(F.col(name).isin(*values))
    for name in null:
        df = df.where(F.col(name).isNull())
    for name in present:
        df = df.where(F.col(name).isNotNull())
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """S3: (path, page_key, text): one row a file, whose name without suffix is the page's key."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("page_key"), "text")


def with_page_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """S3 for a table of pages: adds ``page_key``, the MD5 of the URL."""
    return pages.withColumn("page_key", C.page_key(F.col(url_col)))


def read_matching(spark: SparkSession, glob: str, schema: T.StructType | str, exclude: Sequence[str] = (), format: str = "json") -> DataFrame:
    """All files of a glob but those whose name holds one of ``exclude``, with their path."""
    df = spark.read.format(format).schema(schema).load(glob).withColumn("path", F.input_file_name())
    return df.where(~C.contains_any(F.col("path"), exclude)) if exclude else df


def read_entities(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """One nested JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


#: A run of retrieval questions, and judged answers.
RUN_SCHEMA = "no int, university string, query string, top_score double, hit_count int, elapsed_sec double, answer_head string, status string"
JUDGED_SCHEMA = ("no int, question string, university string, ground_truth string, answer string, faithfulness double, answer_relevancy double, "
                 "context_precision double, context_recall double, average double, elapsed double")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's CSV with quoted line breaks; a byte order mark before the header does no harm."""
    return spark.read.schema(RUN_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of judged answers."""
    return spark.read.schema(JUDGED_SCHEMA).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and these columns only; one that is missing is empty."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_entities(df: DataFrame, path: str, entity: str) -> None:
    """JSON below a folder for each entity."""
    df.write.mode("overwrite").partitionBy(entity).json(path)


def write_summary(df: DataFrame, path: str, entity: str, items: str) -> None:
    """One JSON row with the number of entities and of items, and the items of each."""
    each = df.groupBy(entity).agg(F.sum(F.coalesce(F.size(items), F.lit(0))).alias("items"))
    each.write.mode("overwrite").json(path)


def write_traces(df: DataFrame, path: str, trace: str) -> None:
    """A JSON line for each step of an array of steps, with its position."""
    df.select("*", F.posexplode(trace).alias("step_no", "step")).drop(trace).write.mode("overwrite").json(path)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """``target`` with ``changes`` merged in by key, and ``action`` inserted, updated or kept.

    Missing key parts equal missing ones. Of changes with the same key the last
    in ``order`` counts. A changed row takes each value that isn't null. One
    shuffle by key on either side; keys meet as they are, null-safe.
    """
    values = [c for c in target.columns if c not in keys]
    fresh = changes.select(*target.columns, *([order.alias("_order")] if order is not None else []))
    latest = Window.partitionBy(*keys).orderBy(F.col("_order").desc() if order is not None else F.xxhash64(*values))
    fresh = fresh.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*[F.col(k).alias(f"_new_{k}") for k in keys], F.struct(*target.columns).alias("new"))
    old = target.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.struct(*target.columns).alias("old"))
    same = reduce(Column.__and__, [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNotNull(), "updated").otherwise("kept")
    return old.join(fresh, same, "full_outer").select(*[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in target.columns], action.alias("action"))


#: A stored table's rows lie in so many partitions by the hash of their key.
KEY_PARTITIONS = 256


def store_keyed(df: DataFrame, path: str, keys: Sequence[str], partitions: int = KEY_PARTITIONS) -> None:
    """Writes ``df`` as a table that ``upsert_stored`` can change in part: partitioned by the hash of the key."""
    place = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    df.withColumn("key_partition", place).repartition("key_partition").write.partitionBy("key_partition").parquet(path)


def upsert_stored(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], order: Column | None = None, partitions: int = KEY_PARTITIONS) -> DataFrame:
    """``upsert`` into a table of ``store_keyed``; reads and rewrites only the partitions that ``changes`` has keys of.

    The merged rows (with their ``action``) are written to the shared folder first and returned from there; then they replace the touched
    partitions by Spark's dynamic partition overwrite. If that is cut short, the same call repairs it as long as the
    changes are the same and no partition is lost; the merged rows in the shared folder are whole in any case. Files of other partitions stay as they are.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    touched = sorted(r[0] for r in changes.select(place).distinct().collect())  # at most a number for each partition
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "key_partition"]
    merged = upsert(stored.where(F.col("key_partition").isin(touched)).select(*columns), changes, keys, order)
    folder = work_path(spark, "upsert")
    merged.withColumn("key_partition", place).repartition("key_partition").write.parquet(folder)
    out = spark.read.parquet(folder)
    out.drop("action").repartition("key_partition").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_partition").parquet(path)
    return out.drop("key_partition")


def load_statistics(merged: DataFrame) -> DataFrame:
    """Rows by action."""
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def versioned_insert(stored: DataFrame, crawled: DataFrame, url: str, content: str, at: str) -> DataFrame:
    """(url, content_hash, first_seen, last_seen, times): the same content again only moves last_seen."""
    pair = lambda df: df.select(F.col(url).alias("url"), C.content_hash(F.col(content)).alias("content_hash"), F.col(at).alias("at"))
    seen = pair(stored).unionByName(pair(crawled))
    return seen.groupBy("url", "content_hash").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("times"))


def reprocessed(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of a parent that occurs in ``new`` give way to the new ones."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*stored.columns))


def refreshed(replica: DataFrame, master: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The replica with these columns from the master where it has a value."""
    fresh = master.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = replica.join(fresh, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in replica.columns])


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the output doesn't have yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def reset_flags(df: DataFrame, subset: Column, defaults: Mapping[str, object]) -> DataFrame:
    """Default values in the rows of a subset."""
    return df.withColumns({c: F.when(subset, F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
