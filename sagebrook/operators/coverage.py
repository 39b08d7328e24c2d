"""Coverage, quality and progress reports.

All are declarative aggregates and joins: partial aggregation runs before every
shuffle, and which join is taken is left to Spark unless a size is checked.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .common import percent, small, top_per_key, work_path


def covered_units(units: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``units`` with ``covered``: whether an edge names the unit. The edges are made distinct by key before they meet the units."""
    return units.join(edges.select(key).distinct().withColumn("covered", F.lit(True)), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage(units: DataFrame, by: Sequence[str] = (), covered: str = "covered") -> DataFrame:
    """Total, covered, uncovered and pct, for each group or overall (0 for an empty table)."""
    out = units.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(covered).alias("covered_n"))
    return out.select(*by, "total", "covered_n", (F.col("total") - F.col("covered_n")).alias("uncovered_n"), F.coalesce(percent(F.col("covered_n"), F.col("total")), F.lit(0.0)).alias("pct"))


def coverage_buckets(by_entity: DataFrame) -> DataFrame:
    """A5: entities fully, partly and not covered."""
    return by_entity.agg(
        F.count_if(F.col("pct") == 100).alias("full"), F.count_if((F.col("pct") > 0) & (F.col("pct") < 100)).alias("partial"),
        F.count_if(F.col("pct") == 0).alias("none"), F.count(F.lit(1)).alias("entities"),
    )


def clean_progress(docs: DataFrame, flags: Mapping[str, Column], done: str, by: Sequence[str] = ()) -> DataFrame:
    """A4: rows, how many hold each condition, and the share of one of them."""
    out = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return out.withColumn("pct", percent(F.col(done), F.col("total")))


def chunk_progress(docs: DataFrame, chunks: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Documents, those with chunks, and chunks. Chunks are counted by document first, so nothing is counted twice."""
    counted = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(counted, key, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count("_n").alias("chunked"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks")
    )


def daily(df: DataFrame, at: str, distinct: str) -> DataFrame:
    """Rows and distinct entities for each day."""
    return df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("entities"))


def newly_covered(df: DataFrame, at: str, entity: str) -> DataFrame:
    """Entities by the day on which they first occur."""
    return df.groupBy(entity).agg(F.min(F.to_date(at)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def cumulative(days: DataFrame, day: str = "day", n: str = "n") -> DataFrame:
    """The running total by day. One row a day: the window sees days, not rows."""
    return days.withColumn("running", F.sum(n).over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))


def latest(df: DataFrame, entity: str, at: str, n: int = 20) -> DataFrame:
    """Entities with the latest time, newest first."""
    return df.groupBy(entity).agg(F.max(at).alias("latest")).orderBy(F.desc("latest"), entity).limit(n)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, missing parts folded to empty."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def content_drift(df: DataFrame, url: str, content_hash: str, at: str) -> DataFrame:
    """A10: URLs with more than one content, and when they were first and last seen."""
    return df.groupBy(url).agg(
        F.count_distinct(content_hash).alias("versions"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")
    ).where("versions > 1")


def pivot_counts(df: DataFrame, by: Sequence[str], column: str, values: Mapping[str, object], at: str | None = None) -> DataFrame:
    """A count for each value, and the latest time."""
    counts = [F.count_if(F.col(column) == F.lit(v)).alias(n) for n, v in values.items()]
    return df.groupBy(*by).agg(*counts, *([F.max(at).alias("last_seen")] if at else []))


def array_statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean, largest and smallest length, shares of null and of empty arrays."""
    n = F.size(column)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.when(F.col(column).isNotNull(), n)), 6).alias("avg_len"),
        F.max(F.when(F.col(column).isNotNull(), n)).alias("max_len"), F.min(F.when(F.col(column).isNotNull(), n)).alias("min_len"),
        percent(F.count_if(F.col(column).isNull()), F.count(F.lit(1))).alias("null_pct"), percent(F.count_if(n == 0), F.count(F.lit(1))).alias("empty_pct"),
    )


def element_count(df: DataFrame, column: str, condition, by: Sequence[str] = ()) -> DataFrame:
    """Array elements that meet a condition, counted without exploding."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.size(F.filter(F.col(column), condition))), F.lit(0)).alias("n"))


def empty_extractions(df: DataFrame, document: str, by: Sequence[str]) -> DataFrame:
    """Rows whose JSON gives no units, with the reason: NULL, parse error or empty list."""
    units = F.get_json_object(document, "$.covered_units")
    reason = (
        F.when(F.col(document).isNull(), "NULL").when(F.try_parse_json(document).isNull(), "parse error")
        .when(F.coalesce(units, F.lit("[]")) == "[]", "empty list")
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def year_repair(df: DataFrame, stored: str, found: str) -> DataFrame:
    """What a repair would do: update, correct, unknown or none; with the year that results."""
    new = C.normal_year(F.col(found))
    action = (
        F.when(F.coalesce(F.col(found), F.lit("")) == "", F.when(F.coalesce(F.col(stored), F.lit("")) == "", "none").otherwise("unknown"))
        .when(new.eqNullSafe(F.col(stored)), "correct").otherwise("update")
    )
    return df.withColumns({"action": action, "new_year": F.coalesce(F.nullif(new, F.lit("")), F.col(stored))})


def duplicates_by_entity(df: DataFrame, entity: str, url: str) -> DataFrame:
    """For each entity the URLs that occur more than once, and the copies that are too many."""
    pairs = df.groupBy(entity, url).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("_n") - 1).alias("extra"))


def progress_states(listed: DataFrame, counted: DataFrame, key: str, done: float = 99.9) -> DataFrame:
    """Done, in progress or not started, for every entity of a list, those without rows too.

    ``counted`` has a row for each entity: total and covered_n.
    """
    joined = small(listed.select(key).distinct()).join(counted, key, "left")
    pct = F.coalesce(F.lit(100.0) * F.col("covered_n") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    state = F.when(pct >= done, "done").when(pct > 0, "in progress").otherwise("not started")
    return joined.select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("covered_n", F.lit(0)).alias("covered_n"), state.alias("state"))


def state_totals(states: DataFrame) -> DataFrame:
    """Entities and rows by state, and a grand total."""
    return states.rollup("state").agg(F.count(F.lit(1)).alias("entities"), F.sum("total").alias("total"), F.sum("covered_n").alias("covered_n")).withColumn(
        "state", F.coalesce("state", F.lit("all"))
    )


def shares(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows, and the percentage that meets each condition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[percent(F.count_if(c), F.count(F.lit(1))).alias(n) for n, c in conditions.items()])


def expectations(checks: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """(name, severity, violations) for each (name, severity, table, condition that should hold)."""
    out = None
    for name, severity, df, holds in checks:
        row = df.agg(F.count_if(~F.coalesce(holds, F.lit(False))).alias("violations")).select(
            F.lit(name).alias("name"), F.when(F.col("violations") > 0, F.lit(severity)).otherwise("ok").alias("severity"), "violations"
        )
        out = row if out is None else out.unionByName(row)
    return out


def work_estimate(chunks: DataFrame, document: str, text: str, batch: int = 50) -> DataFrame:
    """Chunks, characters and batches for each document."""
    n = F.count(F.lit(1))
    return chunks.groupBy(document).agg(n.alias("chunks"), F.sum(F.length(text)).alias("chars"), F.ceil(n / batch).alias("batches"))


def score_bands(df: DataFrame, score: str, high: float = 0.85, low: float = 0.75) -> DataFrame:
    """Rows and share in each band of a score."""
    band = F.when(F.col(score) >= high, "high").when(F.col(score) >= low, "medium").otherwise("low")
    from .common import share_of_total

    return share_of_total(df.withColumn("band", band), ["band"])


def evaluation_means(df: DataFrame, metrics: Sequence[str], latency: str, by: Sequence[str] = ()) -> DataFrame:
    """Questions, the mean of each metric and of all of them together, and the mean latency; nulls don't count."""
    each = F.array_compact(F.array(*[F.col(m).cast("double") for m in metrics]))
    own = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(each), F.lit(0))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *[mean(F.col(m), m) for m in metrics], mean(own, "overall"), mean(F.col(latency), "latency"))


def entity_documents(df: DataFrame, entity: str, documents: Column, complete: Column) -> DataFrame:
    """Documents of each entity and whether all its rows are complete; the row without an entity is the total."""
    n = F.coalesce(F.sum(documents), F.lit(0)).cast("long")
    return df.rollup(entity).agg(n.alias("documents"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("complete"))


def outdated_by(df: DataFrame, by: Sequence[str], year: str) -> DataFrame:
    """Outdated documents by entity and year."""
    return df.where(C.outdated_year(F.col(year))).groupBy(*by, year).agg(F.count(F.lit(1)).alias("n"))


def edges_three_way(edges: DataFrame, docs: DataFrame, units: DataFrame, doc_key: str, unit_key: str, where: Column | None = None) -> DataFrame:
    """Edges with their document and their unit; the filter is pushed below the joins where it can be."""
    out = edges.join(docs, doc_key).join(units, unit_key)
    return out if where is None else out.where(where)


def merged_maps(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """All keys of both, a missing value empty."""
    return left.join(right, key, "full_outer").select(key, F.coalesce(left_value, F.lit("")).alias(left_value), F.coalesce(right_value, F.lit("")).alias(right_value))


def looked_up(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "不明") -> DataFrame:
    """A value of a dimension, or the default."""
    return df.join(small(dimension.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


#: Registers of a distinct sketch: 2 to this power, for a standard error of 1.04 / sqrt(registers), 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by ..., sketch): a mergeable sketch of the distinct values of a column for each group, to be stored."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(SKETCH_BITS)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by ..., distinct): the number of distinct values of merged groups, within the sketches' error, without the rows."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def exact_else_like(names: DataFrame, dimension: DataFrame, name: str) -> DataFrame:
    """For each wanted name (column ``wanted``) the row of that name, else the first (by name) that holds it in any case.

    What a name holds are its windows of the wanted names' lengths. Each window's first name is an aggregate that tasks combine before it moves, so wanted names
    meet one row each, by an equi-join, however many names hold them. A name has at most as many windows as its length for each of these
    lengths. Names that no row holds and null ones have no row; an empty one is held by every name.
    """
    low = lambda c: F.lower(F.col(c))
    size = lambda c: F.length(low(c))
    asked = names.select("wanted").where("wanted IS NOT NULL").distinct()
    lengths = F.broadcast(asked.agg(F.collect_set(size("wanted")).alias("lengths")))  # one row: no more lengths than the longest name has letters
    firsts = top_per_key(dimension.where(F.col(name).isNotNull()), [name], 1, *[F.col(c) for c in dimension.columns])
    known = dimension.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct().crossJoin(lengths)
    fit = F.filter("lengths", lambda n: n <= size("_name"))
    windows = F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.when(n == 0, 1).otherwise(size("_name") - n + 1)), lambda i: F.substr(low("_name"), i, n)))))
    held = known.select("_name", F.explode(windows).alias("window")).groupBy("window").agg(F.min("_name").alias("_like"))
    best = asked.withColumn("window", low("wanted")).join(held.hint("merge"), "window")
    best = best.join(known.select("_name").hint("merge"), F.col("wanted") == F.col("_name"), "left")
    best = best.select("wanted", F.coalesce("_name", "_like").alias("_best"), F.col("_name").isNotNull().alias("exact"))
    return best.join(firsts.hint("merge"), F.col("_best") == F.col(name)).drop("_best")


def units_by_type(units: DataFrame, entity: str, value: str, unit_type: str, name: str) -> DataFrame:
    """An entity's units as one sorted list for each type."""
    own = units.where(F.col(entity) == F.lit(value))
    return own.groupBy(unit_type).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"), F.count_distinct(name).alias("n"))


def all_covered(known: DataFrame, found: DataFrame, entity: str, unit: str) -> DataFrame:
    """For each entity the known units that aren't found, and whether none is missing."""
    missing = known.select(entity, unit).distinct().join(found.select(entity, unit).distinct().withColumn("_found", F.lit(True)), [entity, unit], "left")
    return missing.groupBy(entity).agg(F.count_if(F.col("_found").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def ordered_merge(sources: Sequence[DataFrame], key: str, position: str, group: str, limit: int = 80) -> DataFrame:
    """U4: several sources in order, the first row of each key, at most ``limit`` for each group."""
    out = None
    for n, source in enumerate(sources):
        part = source.withColumn("source_no", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    once = top_per_key(out, [group, key], 1, F.col("source_no"), F.col(position))
    return top_per_key(once, [group], limit, F.col("source_no"), F.col(position), F.col(key))


def tag_union(a: Column, b: Column) -> Column:
    """Tags of both, sorted."""
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def ranked_listing(df: DataFrame, ranks: Sequence[str], name: str, search: str | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
    """Ranked rows first, by several ranks; name search and equal filters."""
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    if search:
        df = df.where(F.contains(F.lower(name), F.lit(search.lower())))
    return df.orderBy(*[F.col(r).asc_nulls_last() for r in ranks], name)


def authoritative_merge(authority: DataFrame, gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The authority's rows, and rows of keys that only the other source has."""
    both = authority.withColumn("_p", F.lit(0)).unionByName(gaps.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return top_per_key(both, keys, 1, F.col("_p")).drop("_p")


#: A field that more profiles have is hot, and its pairs are dealt to so many parts.
HOT_FIELD, PARTS = 1_000, 64


#: Pairs that a task combines at once, and combined ones that it holds.
PAIR_SLICE, PAIRS_HELD = 1 << 22, 1 << 21


def _pair_counts(once: DataFrame) -> DataFrame:
    """(profile, peer, shared): how many fields each two profiles of different entities share, from distinct rows (profile, of, field).

    Fields lie in tasks by ranges, as neighbours tend to have the same profiles; a task combines the pairs of a batch of fields before any
    shuffles, and pairs are dealt by profile only, so that ranking them needs no other shuffle.
    """
    fields = once.repartitionByRange("field").groupBy("field").agg(F.collect_list(F.struct("profile", "of")).alias("members")).select("members")
    kind = once.schema["profile"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members = pc.list_flatten(lists)
            names = members.field("profile").dictionary_encode()
            own, of = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names.indices, members.field("of").dictionary_encode().indices.fill_null(-1)))
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            after = np.repeat(np.cumsum(size), size) - np.arange(len(own)) - 1  # members of the field that follow each
            ends, width = np.cumsum(after), max(1, len(names.dictionary))

            def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                a, b = pairs // width, pairs % width
                both = [names.dictionary.take(pa.array(np.r_[x, y])) for x, y in ((a, b), (b, a))]
                return pa.RecordBatch.from_arrays([*both, pa.array(np.r_[n, n])], ["profile", "peer", "shared"])

            at, found, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            while at < len(own):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + PAIR_SLICE, "right")))
                n = after[at:to]
                left = np.repeat(np.arange(at, to), n)
                right = left + 1 + np.arange(len(left)) - np.repeat(ends[at:to] - n - before, n)
                other = (of[left] != of[right]) & (of[left] >= 0) & (of[right] >= 0)
                left, right = own[left[other]], own[right[other]]
                new, n = np.unique(np.minimum(left, right) * width + np.maximum(left, right), return_counts=True)
                found, inverse = np.unique(np.r_[found, new], return_inverse=True)
                counts = np.bincount(inverse, np.r_[counts, n], len(found)).astype(np.int64)
                if len(found) > PAIRS_HELD:
                    yield rows(found, counts)
                    found, counts = found[:0], counts[:0]
                at = to
            yield rows(found, counts)

    combined = fields.mapInArrow(work, f"profile {kind}, peer {kind}, shared long")
    return combined.repartition("profile").groupBy("profile", "peer").agg(F.sum("shared").alias("shared"))


#: Rows of profile and field whose lists a task holds, about; members that a task counts at once; lists that it looks up at once.
SHARD_ROWS, MEMBERS, LISTS = 1 << 22, 1 << 21, 1 << 16
#: Numbered profiles are broadcast up to so many: a few whole numbers each.
NUMBERED_ROWS = 500_000


def field_peers(profiles: DataFrame, key: str, entity: str, field: str, most: int = 8, hot: int = HOT_FIELD) -> DataFrame:
    """For each profile up to ``most`` profiles of other entities with the most shared fields; ties go by key.

    ``profiles`` has a row for each profile and field; repeated rows count once. Each field's profiles are a list in the shared folder, as numbers in the order of the keys
    (these are stored when the plan is built). A profile's places of lists meet in one task, which maps the lists, counts their members and passes on ``most`` of them: what
    moves and is stored are rows of profile and field, never pairs of profiles. A profile whose ``most`` best share more of the fields
    that at most ``hot`` have than it has hot fields needs no other candidates, as one that shares hot fields only can't get there: of its candidates
    those within reach are looked up in its hot fields. Only the others go through their hot fields' lists. ``field_pairs`` counts the pairs of both kinds. On a cluster whose
    session has no shared folder pairs shuffle.
    """
    spark = profiles.sparkSession
    try:
        folder = work_path(spark, "peers")
    except ValueError:
        return _peers_by_pairs(profiles, key, entity, field, most, hot)
    rows = profiles.select(F.col(key).alias("profile"), F.col(entity).alias("of"), F.col(field).alias("field")).where("profile IS NOT NULL AND of IS NOT NULL AND field IS NOT NULL")
    nodes = rows.groupBy("profile", "of").agg(F.count(F.lit(1)).alias("n"))
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(nodes.schema).parquet(f"{folder}/nodes")
    count, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    names, profile_n = _numbered(nodes.select("profile"), f"{folder}/profiles")
    entities, entity_n = _numbered(nodes.select("of"), f"{folder}/entities")
    bits = max(1, entity_n.bit_length())
    node = F.shiftleft(names["no"], bits).bitwiseOR(entities["no"]).alias("node")
    nodes = nodes.join(names, "profile").join(entities, "of").select("profile", "of", node)
    cores = spark.sparkContext.defaultParallelism
    dealt = rows.join(small(nodes, NUMBERED_ROWS), ["profile", "of"]).select("node", "field").repartitionByRange(max(cores, -(-total // SHARD_ROWS)), "field")
    kind = np.uint32 if profile_n << bits <= 1 << 32 else np.int64
    listed = dealt.mapInArrow(_lists(f"{folder}/lists", kind), "node long, shard long, starts array<int>")
    own = F.shiftright("node", bits).alias("own"), F.col("node").bitwiseAND(F.lit((1 << bits) - 1)).alias("entity")
    listed = listed.select(*own, "shard", "starts").repartition(max(cores, -(-total * 4 // SHARD_ROWS)), "own").sortWithinPartitions("own")
    best = listed.mapInArrow(_met_in_lists(f"{folder}/lists", kind, bits, most, hot, count > profile_n), "own long, _peer long, shared long, rank int")
    names = small(names, NUMBERED_ROWS)
    out = best.join(names.select(F.col("no").alias("own"), "profile"), "own").join(names.select(F.col("no").alias("_peer"), F.col("profile").alias("peer")), "_peer")
    return out.select("profile", "peer", "shared", "rank")


def _numbered(values: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(value, no): the distinct values of a column, stored and numbered from 0 in their order; and how many there are."""
    spark, name = values.sparkSession, values.columns[0]
    place = F.monotonically_increasing_id()  # the part's number in the bits from 33 on
    values.distinct().orderBy(name).select(name, F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(path)
    kept = spark.read.schema(values.select(name, F.lit(0).cast("long").alias("_part"), F.lit(0).cast("long").alias("_at")).schema).parquet(path)
    sizes = sorted(kept.groupBy("_part").count().collect())  # a row for each part
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    firsts = spark.createDataFrame([(r["_part"], b) for r, b in zip(sizes, before)], "_part long, _first long")
    return kept.join(F.broadcast(firsts), "_part").select(name, (F.col("_first") + F.col("_at")).alias("no")), before[-1]


def _lists(folder: str, kind: type):
    """Turns a task's rows (node, field) into a file of ``folder`` and rows (node, shard, starts).

    The file has each field's number of nodes and then these nodes, ascending; a row has the places where a node's fields start in the file ``shard``.
    Its name is random, so that a repeated task writes another file and its rows name that one.
    """
    from ..llm.arrays import save
    from ..llm.common import giving_back

    def distinct(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The nodes, ascending, and the fields of the rows; and of each different row the place of its field and of its node, in this order."""
        table = pa.Table.from_batches(parts)
        nodes, own = np.unique(table.column(0).to_numpy(), return_inverse=True)
        fields = table.column(1).combine_chunks().dictionary_encode()
        pair = np.unique(fields.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | own)
        return nodes, fields.dictionary, pair >> 32, pair & 0xFFFFFFFF

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, bound = [], 0, 2 * SHARD_ROWS
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held > bound:  # rows may repeat very often
                nodes, fields, field, own = distinct(parts)
                parts = [pa.RecordBatch.from_arrays([pa.array(nodes[own]), fields.take(pa.array(field))], batch.schema.names)]
                held = parts[0].num_rows
                bound = 2 * held + SHARD_ROWS
        if not held:
            return
        nodes, _, field, own = distinct(parts)
        del parts
        sizes = np.bincount(field)
        starts = np.cumsum(sizes + 1) - sizes - 1
        file = np.empty(len(field) + len(sizes), kind)
        file[starts] = sizes
        file[np.arange(len(field)) + field + 1] = nodes[own]
        shard = int.from_bytes(os.urandom(7), "big")
        save(folder, str(shard), file)
        ends = np.r_[0, np.cumsum(np.bincount(own))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(starts[field[np.argsort(own, kind="stable")]].astype(np.int32)))
        out = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), shard)), lists], ["node", "shard", "starts"])
        for at in range(0, len(nodes), 4096):
            yield out.slice(at, 4096)

    return work


@functools.lru_cache(1024)
def _opened(folder: str, shard: int, kind: type) -> np.ndarray:
    from ..llm.arrays import mapped

    return np.asarray(mapped(folder, str(shard), kind))


def _met_in_lists(folder: str, kind: type, bits: int, most: int, hot: int, several: bool):
    """Turns rows (own, entity, shard, starts), a profile's next to one another, into its best peers (own, _peer, shared, rank); ``several``: profiles may have several entities."""
    from ..llm.common import giving_back

    opened = lambda shard: _opened(folder, shard, kind)

    def by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) of each run."""
        edges = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(shard[a]), int(a), int(b)

    def members(lists: tuple[np.ndarray, ...], found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the members of lists (place of the profile, entity, shard, start, size) to the sorted peers ``found`` (place << 32 | peer) and their counts, a slice at a time."""
        place, entity, shard, start, size = lists
        ends = np.cumsum(size)
        before = (-1, -1)
        for low in range(0, int(ends[-1]) if len(ends) else 0, MEMBERS):
            at = np.arange(low, min(low + MEMBERS, int(ends[-1])))
            first, last = np.searchsorted(ends, (low, at[-1]), "right")
            n = np.minimum(ends[first : last + 1], at[-1] + 1) - np.maximum(ends[first : last + 1] - size[first : last + 1], low)
            of = np.repeat(np.arange(first, last + 1), n)
            at += (start + 1 - ends + size)[of]
            node = np.empty(len(at), np.int64)
            for s, a, b in by_shard(shard[first : last + 1]):
                a, b = np.searchsorted(of, (first + a, first + b))
                node[a:b] = opened(s)[at[a:b]]
            other = (node & (1 << bits) - 1) != entity[of]
            of, peer = of[other], node[other] >> bits
            if several and len(of):  # a peer counts once a list
                once = (of != np.r_[before[0], of[:-1]]) | (peer != np.r_[before[1], peer[:-1]])
                before = of[-1], peer[-1]
                of, peer = of[once], peer[once]
            new = np.sort(place[of] << 32 | peer)
            edges = np.flatnonzero(np.r_[True, new[1:] != new[:-1]]) if len(new) else np.zeros(0, int)
            new, n = new[edges], np.diff(np.r_[edges, len(new)])
            if len(found):
                new, inverse = np.unique(np.r_[found, new], return_inverse=True)
                n = np.bincount(inverse, np.r_[counts, n], len(new)).astype(np.int64)
            found, counts = new, n
        return found, counts

    def ranked(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``most`` best in ``found``, profile by profile, and their ranks from 1."""
        place, top = found >> 32, int(counts.max(initial=0))
        by = place * (top + 1) + top - counts
        order = np.sort(by * len(found) + np.arange(len(found))) % len(found) if len(found) and int(by.max()) < (1 << 62) // len(found) else np.argsort(by, kind="stable")
        place = place[order]
        rank = np.arange(len(order)) - np.searchsorted(place, place) + 1
        return order[rank <= most], rank[rank <= most]

    def best(own: np.ndarray, lists: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        """Best peers of the profiles ``own`` by their lists."""
        often = (lists[-1] > hot) & (not several)
        found, counts = members(tuple(x[~often] for x in lists), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if often.any():
            often = tuple(x[often] for x in lists)
            held, last = np.bincount(often[0], minlength=len(own)), np.zeros(len(own), np.int64)
            at, rank = ranked(found, counts)
            at = at[rank == most]
            last[found[at] >> 32] = counts[at]
            wide = last <= held
            within = np.flatnonzero(~wide[found >> 32] & (counts + held[found >> 32] >= last[found >> 32]))
            place = found[within] >> 32
            for p, _, shard, start, size in zip(*(x[~wide[often[0]]].tolist() for x in often)):
                mine = within[slice(*np.searchsorted(place, (p, p + 1)))]
                nodes, peers = opened(shard)[start + 1 : start + 1 + size], found[mine] & 0xFFFFFFFF
                at = np.searchsorted(nodes, (peers << bits).astype(kind))
                counts[mine] += (at < size) & (nodes[np.minimum(at, size - 1)] >> bits == peers)
            found, counts = members(tuple(x[wide[often[0]]] for x in often), found, counts)
        at, rank = ranked(found, counts)
        return pa.RecordBatch.from_arrays([pa.array(own[found[at] >> 32]), pa.array(found[at] & 0xFFFFFFFF), pa.array(counts[at]), pa.array(rank.astype(np.int32))], ["own", "_peer", "shared", "rank"])

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Best peers of whole profiles, a group of them at a time."""
        own, entity, shard = (table.column(i).to_numpy() for i in range(3))
        n = pc.list_value_length(table.column(3)).to_numpy().astype(np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)] if len(own) else np.zeros(1, int)
        total = np.r_[0, np.cumsum(n)][edges]  # lists before each profile
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(total, total[a] + LISTS, "right")) - 1)
            rows = slice(edges[a], edges[b])
            place = np.repeat(np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), n[rows])
            start = pc.list_flatten(table.column(3).slice(rows.start, rows.stop - rows.start)).to_numpy().astype(np.int64)
            lists = [place, np.repeat(entity[rows], n[rows]), np.repeat(shard[rows], n[rows]), start]
            if several:  # a profile with two entities at a field differs from all of its members
                order = np.lexsort((start, lists[2], place))
                place, _, shards, start = lists = [x[order] for x in lists]
                same = (place[1:] == place[:-1]) & (shards[1:] == shards[:-1]) & (start[1:] == start[:-1])
                lists[1] = np.where(np.r_[same, False], -1, lists[1])
                lists = [x[~np.r_[False, same]] for x in lists]
            size = np.empty(len(lists[3]), np.int64)
            order = np.argsort(lists[2], kind="stable")
            for s, c, d in by_shard(lists[2][order]):
                size[order[c:d]] = opened(s)[lists[3][order[c:d]]]
            weight = np.cumsum(np.bincount(lists[0], size, b - a).astype(np.int64))
            c = 0
            while c < b - a:  # profiles with about as many members as are counted at once
                d = max(c + 1, int(np.searchsorted(weight, (weight[c - 1] if c else 0) + MEMBERS, "right")))
                mine = order[(lists[0][order] >= c) & (lists[0][order] < d)]  # shard by shard
                group = [x[mine] for x in (*lists, size)]
                group[0] = group[0] - c
                yield best(own[edges[a + c : a + d]], tuple(group))
                c = d
            a = b

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                whole = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[-1].as_py()))
                yield from met(table.slice(0, whole))
                rest = table.slice(whole)
        if rest is not None:
            yield from met(rest)

    return work


def _peers_by_pairs(profiles: DataFrame, key: str, entity: str, field: str, most: int, hot: int) -> DataFrame:
    """``field_peers`` by pairs of profiles that shuffle, where nothing can be shared in files.

    Profiles meet by fields that at most ``hot`` of them have. Only those whose best can still change meet everyone with their hot fields, in parts by the peer's key.
    Where a profile has several entities, all pairs of a field meet.
    """
    once = profiles.select(F.col(key).alias("profile"), F.col(entity).alias("of"), F.col(field).alias("field")).where("profile IS NOT NULL AND field IS NOT NULL").distinct()
    as_peer = lambda df: df.select(F.col("profile").alias("peer"), F.col("of").alias("other"), "field")
    if not once.select("profile", "of").distinct().groupBy("profile").count().where("count > 1").isEmpty():
        pairs = once.join(as_peer(once), "field").where("of <> other").groupBy("profile", "peer").agg(F.count_distinct("field").alias("shared"))
        return top_per_key(pairs, ["profile"], most, F.desc("shared"), F.col("peer"), rank="rank")
    sizes = once.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    common = sizes.where(F.col("n") > hot).select("field")
    if common.isEmpty():
        return top_per_key(_pair_counts(once), ["profile"], most, F.desc("shared"), F.col("peer"), rank="rank")
    common = small(common)
    rare, often = once.join(common, "field", "left_anti"), once.join(common, "field", "left_semi")

    near = _pair_counts(rare)
    held = often.groupBy("profile").agg(F.count(F.lit(1)).alias("held"))
    last = top_per_key(near, ["profile"], most, F.desc("shared"), F.col("peer"), rank="rank").where(F.col("rank") == most).select("profile", F.col("shared").alias("last"))
    state = held.join(last, "profile", "left").withColumn("open", F.coalesce(F.col("last") <= F.col("held"), F.lit(True)))

    within = near.join(state.where("NOT open"), "profile").where(F.col("shared") + F.col("held") >= F.col("last")).select("profile", "peer")
    looked_up_hot = within.join(often.select("profile", "field"), "profile").join(often.select(F.col("profile").alias("peer"), "field"), ["peer", "field"])
    part = F.pmod(F.xxhash64("peer"), F.lit(PARTS)).cast("int").alias("part")
    asking = often.join(state.where("open").select("profile"), "profile", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    met = asking.join(as_peer(often).select("*", part), ["field", "part"]).where("of <> other")
    more = looked_up_hot.select("profile", "peer").unionByName(met.select("profile", "peer")).groupBy("profile", "peer").agg(F.count(F.lit(1)).alias("shared"))
    pairs = near.unionByName(more).groupBy("profile", "peer").agg(F.sum("shared").alias("shared"))
    return top_per_key(pairs, ["profile"], most, F.desc("shared"), F.col("peer"), rank="rank")


def field_pairs(profiles: DataFrame, key: str, field: str, hot: int = HOT_FIELD) -> DataFrame:
    """(is_hot, fields, pairs): ordered pairs of profiles that share a field, by whether the field is hot."""
    sizes = profiles.select(key, field).dropna().distinct().groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy((F.col("n") > hot).alias("is_hot")).agg(F.count(F.lit(1)).alias("fields"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))


def completed_profiles(df: DataFrame, name: str, sub: str, affiliation: str, suffix: str) -> DataFrame:
    """Names without prefix and brackets; a missing sub-unit is the token of the affiliation that ends in ``suffix``."""
    found = F.nullif(C.suffix_token(F.col(affiliation), suffix), F.lit(""))
    return df.withColumns({name: C.clean_entity_name(F.col(name)), sub: F.coalesce(F.nullif(F.col(sub), F.lit("")), found)})


def text_search(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Rows of which any column holds the query, in any case."""
    return df.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(query.lower())))


def season_pivot(entries: DataFrame, by: str, month: Column, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Entries by season and type."""
    season = F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").otherwise("winter")
    return entries.groupBy(by, season.alias("season")).pivot(kind, list(kinds)).count().fillna(0, subset=list(kinds))


def nested_season_pivot(df: DataFrame, by: str, entries: str, kinds: Sequence[str], month: str = "month", kind: str = "kind", amount: str = "amount") -> DataFrame:
    """Entries of an array of structs by season and type, with the sum of their amounts; null arrays have none."""
    rows = df.select(by, F.explode(entries).alias("e")).select(by, *[F.col(f"e.{c}").alias(c) for c in (month, kind, amount)])
    m = F.col(month)
    season = F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")
    counts = [F.count_if(F.col(kind) == F.lit(k)).alias(k) for k in kinds]
    return rows.groupBy(by, season.alias("season")).agg(*counts, F.sum(amount).alias("total"))


def nested_shares(df: DataFrame, entries: str, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Elements of an array of structs, and the percentage of them with each field neither null nor empty."""
    rows = df.select(*by, F.explode(entries).alias("e"))
    filled = {f: F.coalesce(F.col(f"e.{f}").cast("string") != "", F.lit(False)) for f in fields}
    return shares(rows, filled, by)
