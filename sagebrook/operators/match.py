"""Resolving extracted names against known units, one block (entity) at a time.

Input tables: ``known`` (block, unit_id, pos, unit_type, name, sub) and ``items``
(block, input_pos, item_pos, unit_type, name, sub, confidence). All joins have
the block as an equi-key, so no unit meets another entity's names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import columns as C
from .common import cut, small, top_per_key

FUZZY, REVIEW = 90.0, 75.0


def keyed(df: DataFrame, full: bool = True) -> DataFrame:
    """Adds the normalised name, sub-unit and composite key; missing sub-units have an empty key."""
    out = df.withColumns({"name_key": C.match_key(F.col("name"), full), "sub_key": C.match_key(F.col("sub"), full)})
    return out.withColumn("full_key", F.when(F.col("sub_key") == "", F.col("name_key")).otherwise(F.concat_ws("/", "name_key", "sub_key")))


#: Pairs of items and records that one task of ``exact_matches`` writes, about, and rows of a name on either side of a part.
PAIRS, SIDE = 10_000_000, 1_000


def exact_matches(items: DataFrame, known: DataFrame, full: bool = True) -> DataFrame:
    """An item with a sub-unit matches the last known unit of its key; one without matches every record of the unit, of its type if it has one.

    A name of n items and m records has n x m matches, all of which are wanted. Such a name is dealt to parts of at most about ``SIDE`` items and records, and the
    parts to tasks by the number of pairs (counted when the plan is built).
    """
    items, known = keyed(items, full), keyed(known, full)
    last = known.groupBy("block", "full_key").agg(F.max_by("unit_id", "pos").alias("unit_id"))
    by_sub = items.where("sub_key <> ''").join(last, ["block", "full_key"])
    columns = ["block", "input_pos", "item_pos", "unit_id", "confidence"]
    asked = items.where("sub_key = ''").select("block", "name_key", "unit_type", *columns[1:3], "confidence")
    of_unit = known.select("block", "name_key", "unit_id", F.col("unit_type").alias("known_type"))
    on = ["block", "name_key"]
    sizes = asked.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(of_unit.groupBy(*on).agg(F.count(F.lit(1)).alias("_m")), on)
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).head()[0] or 0
    parts = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    large = small(sizes.where(F.greatest("_n", "_m") > SIDE).select(*on, parts("_n").alias("_rows"), parts("_m").alias("_columns")))

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str, *by: str) -> DataFrame:
        """Each row in the part of its own side, once for each part of the other."""
        n = lambda c: F.coalesce(c, F.lit(1))
        df = df.join(large, on, "left").withColumn(own, F.pmod(F.xxhash64(*by), n(own_n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), n(other_n) - 1))).drop("_rows", "_columns")

    asked, of_unit = dealt(asked, "_i", "_rows", "_j", "_columns", "input_pos", "item_pos"), dealt(of_unit, "_j", "_columns", "_i", "_rows", "unit_id")
    every = [*on, "_i", "_j"]
    tasks = int(pairs // PAIRS)
    if tasks > 1:
        asked, of_unit = asked.repartition(tasks, *every), of_unit.repartition(tasks, *every)
    by_unit = asked.join(of_unit.hint("merge"), every).where(F.col("unit_type").isNull() | (F.col("unit_type") == F.col("known_type")))
    return by_sub.select(*columns).unionByName(by_unit.select(*columns)).withColumns({"score": F.lit(100.0), "method": F.lit("exact")})


def _least_shared(n: Column, m: Column, least: float, sql: bool) -> Column:
    """How many characters, repeats included, texts of these lengths share at least if they score ``least``."""
    bound = F.greatest(n, m) * least / 100 if sql else (n + m) * least / 200
    return F.ceil(bound - 1e-9).cast("int")


def candidates(asked: DataFrame, units: DataFrame, on: Sequence[str], least: float = REVIEW, sql: bool = False) -> DataFrame:
    """(on ..., a, b, most): the pairs of distinct keys ``a`` of ``asked`` and ``b`` of ``units`` that can score ``least``, each once, and what they score at most; none that does is missing.

    Such a pair shares a least number of characters, repeats included, that follows from its lengths. With the
    characters of every key in one order, the rarest first, both keys must have one of that order's first few in common
    (as many as may stay unshared, and one); so keys meet by block and character, and only those that share enough go on.
    A pair comes from the rarest character that it shares, so it needn't be made distinct.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be above 0, at most 100")
    on = list(on)

    def signs(df: DataFrame, key: str) -> DataFrame:
        keys = df.select(*on, key).distinct()
        return keys.select(*on, key, F.explode(C.numbered_characters(key if sql else C.sorted_tokens(F.col(key)))).alias("sign"))

    common = small(signs(units, "b").groupBy("sign").agg(F.count(F.lit(1)).alias("df")))

    def ordered(df: DataFrame, key: str, name: str) -> DataFrame:
        """(on ..., key, its characters with the rarest first, their number): one row for each of the first few, with its place."""
        rare = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sign")
        rows = signs(df, key).join(common, "sign", "left").groupBy(*on, key).agg(F.array_sort(F.collect_list(rare)).alias("s"))
        n = F.length(key) if sql else F.length(C.sorted_tokens(F.col(key)))
        rows = rows.select(*on, key, F.col("s.sign").alias(name), n.alias(f"n_{name}"))
        n = F.col(f"n_{name}")
        shortest = n if sql else F.ceil(n * least / (200 - least) - 1e-9)
        first = F.slice(name, F.lit(1), n - _least_shared(n, shortest, least, sql) + 1)
        return rows.select("*", F.posexplode(first).alias(f"at_{name}", "sign"))

    n, m = F.col("n_s"), F.col("n_t")
    shared = F.array_intersect("s", "t")
    enough = _least_shared(n, m, least, sql)
    pairs = ordered(asked, "a", "s").join(ordered(units, "b", "t").hint("merge"), [*on, "sign"])  # Spark takes what an explode makes for small
    pairs = pairs.where((enough <= F.least(n, m)) & (F.col("at_s") <= n - enough) & (F.col("at_t") <= m - enough))
    found = pairs.where((F.size(shared) >= enough) & (F.get(shared, F.lit(0)) == F.col("sign")))
    most = F.size(shared) * 100.0 / F.greatest(n, m, F.lit(1)) if sql else F.size(shared) * 200.0 / F.greatest(n + m, F.lit(1))
    return found.select(*on, "a", "b", F.when(n + m > 0, most).otherwise(100.0).alias("most"))


def _first_best(on: Sequence[str], least: float):
    """For tasks over rows (on ..., a, b, most, pos, unit_id) sorted by key, highest ``most`` and ``pos``: the best unit of each key.

    A key's pairs are scored until no later one can reach the best so far, so most pairs of a key with a near match aren't scored at all.
    """
    width = len(on) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, rows, batch = None, None, [], None
        for batch in batches:
            for *new, b, most, pos, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if new != key:
                    if best:
                        rows.append((*key, best[2], best[0]))
                    key, best = new, None
                if best and most < best[0] - 1e-9:
                    continue
                score = C.indel_score(key[-1], b)
                place = pos is not None, pos  # nulls first
                if score >= least and (not best or (-score, place) < (-best[0], best[1])):
                    best = score, place, unit
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds(batch))], names(batch))
                rows = []
        if best:
            rows.append((*key, best[2], best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds(batch))], names(batch))

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [*(batch.schema.types[:width]), batch.schema.types[-1], pa.float64()]

    def names(batch: pa.RecordBatch) -> list[str]:
        return [*batch.schema.names[:width], "unit_id", "score"]

    return work


#: Longer keys don't write out their texts with a character less; they meet candidates.
SPELT = 256
#: So many keys that are left meet candidates at once; of more those that are one character off are found first.
FEW_KEYS = 10_000


def _one_less(df: DataFrame) -> DataFrame:
    """Each ``_form`` of 1 to ``SPELT`` characters as the texts that it is with one character less."""
    n, at = F.length("_form"), F.col("_at")
    df = df.where(n.between(1, SPELT)).withColumn("_at", F.explode(F.sequence(F.lit(1), n)))
    return df.withColumn("_form", F.concat(F.substr("_form", F.lit(1), at - 1), F.substr("_form", at + 1))).drop("_at")


def one_off(keys: DataFrame, forms: DataFrame, on: Sequence[str], least: float = REVIEW, sql: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(on ..., a, unit_id, score) of keys (on ..., a, _form) that some of ``forms`` (on ..., _form, pos, unit_id) has with one character more, and with one less.

    Only an equal form scores more than one with a character more. One with a character less comes next by the Indel ratio, for keys of three characters or more;
    by the edit ratio changed characters score the same, so there is no second table. Keys meet by equi-joins, as often as they have characters.
    """
    n = F.length("_form")
    first = F.min_by("unit_id", F.struct(F.col("pos").isNotNull(), "pos"))  # nulls first
    more = keys.join(_one_less(forms).groupBy(*on, "_form").agg(first.alias("unit_id")).hint("merge"), [*on, "_form"])
    more = more.select(*on, "a", "unit_id", (F.lit(100.0) * n / (n + 1) if sql else F.lit(200.0) * n / (n + n + 1)).alias("score")).where(F.col("score") >= least)
    if sql:
        return more, None
    less = _one_less(keys.where(n >= 3)).join(forms.hint("merge"), [*on, "_form"]).groupBy(*on, "a", n.alias("_n")).agg(first.alias("unit_id"))
    return more, less.select(*on, "a", "unit_id", (F.lit(200.0) * F.col("_n") / (F.col("_n") + F.col("_n") + 1)).alias("score")).where(F.col("score") >= least)


def fuzzy_matches(items: DataFrame, known: DataFrame, full: bool = True, sql: bool = False, least: float = REVIEW) -> DataFrame:
    """The best known key of the block with a score of ``least`` or more; the first in order on a tie.

    Whole units compare by name; items with a sub-unit compare the composite key with units of their type that have one.
    Names repeat, so distinct keys meet, and a match is joined back to the items that have the key. Equal keys score 100 and need no comparison, and where many are left,
    those that are ``one_off`` neither: nothing else scores more. Of the others the ``candidates`` for ``FUZZY``, which are few, are compared, and only keys that nothing of that score answers
    meet those for ``least``: what scores less can't win before. Keys that are left are stored between these steps (checkpoints, where the session has a folder). ``sql`` takes the edit ratio.
    """
    items, known = keyed(items, full), keyed(known, full)
    columns = ["block", "input_pos", "item_pos", "unit_id", "confidence", "score"]

    def compared(asked: DataFrame, units: DataFrame, on: list[str], least: float) -> DataFrame:
        """(on ..., a, unit_id, score): the best of those that score ``least``."""
        pairs = candidates(asked, units, on, least, sql)
        if sql:
            scored = pairs.withColumn("score", C.edit_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
            return top_per_key(scored.join(units.hint("merge"), [*on, "b"]), [*on, "a"], 1, F.desc("score"), F.col("pos")).select(*on, "a", "unit_id", "score")
        rows = pairs.join(units.hint("merge"), [*on, "b"]).select(*on, "a", "b", "most", "pos", "unit_id").repartition(*on, "a").sortWithinPartitions(*on, "a", F.desc("most"), "pos")
        schema = StructType([*(rows.schema[c] for c in (*on, "a", "unit_id")), StructField("score", DoubleType())])
        return rows.mapInArrow(_first_best(on, least), schema)

    def best(asked: DataFrame, units: DataFrame, on: list[str]) -> DataFrame:
        form = (lambda c: F.col(c)) if sql else (lambda c: C.sorted_tokens(F.col(c)))
        first = F.struct(F.col("pos").isNotNull(), "pos")  # nulls first
        units = cut(units)
        forms = units.groupBy(*on, form("b").alias("_form")).agg(F.min_by("pos", first).alias("pos"), F.min_by("unit_id", first).alias("unit_id"))
        keys = cut(asked.select(*on, "a").distinct().withColumn("_form", form("a")))
        equal = keys.join(forms.hint("merge"), [*on, "_form"]).select(*on, "a", "unit_id", F.lit(100.0).alias("score"))
        won, rest = equal, keys

        def left(found: DataFrame) -> DataFrame:
            return cut(rest.join(found.select(*on, "a").hint("merge"), [*on, "a"], "left_anti"))

        rest = left(equal)
        for k in range(1 if sql else 2):
            if rest.limit(FEW_KEYS + 1).count() > FEW_KEYS:
                found = cut(one_off(rest, forms, on, least, sql)[k])
                won, rest = won.unionByName(found), left(found)
        rest = rest.select(*on, "a")
        if rest.isEmpty():
            return asked.join(won.hint("merge"), [*on, "a"]).select(*columns)
        units = units.join(small(rest.select(*on).distinct()), on, "left_semi")  # units that no key is left for aren't spelt out
        if least < FUZZY:
            near = cut(compared(rest, units, on, FUZZY))
            won, rest = won.unionByName(near), left(near)
        won = won.unionByName(compared(rest, units, on, least))
        return asked.join(won.hint("merge"), [*on, "a"]).select(*columns)

    units = known.groupBy("block", F.col("name_key").alias("b")).agg(F.min("pos").alias("pos"), F.min_by("unit_id", "pos").alias("unit_id"))
    whole = best(items.where("sub_key = ''").withColumnRenamed("name_key", "a"), units, ["block"])
    subs = known.where("sub_key <> ''").groupBy("block", "unit_type", F.col("full_key").alias("b")).agg(F.min("pos").alias("pos"), F.min_by("unit_id", "pos").alias("unit_id"))
    part = best(items.where("sub_key <> ''").withColumnRenamed("full_key", "a"), subs, ["block", "unit_type"])
    return whole.unionByName(part).withColumn("method", F.when(F.col("score") >= FUZZY, "fuzzy").otherwise("llm"))


def resolved(items: DataFrame, known: DataFrame, full: bool = True, sql: bool = False) -> DataFrame:
    """(block, unit_id, input_pos, item_pos, score, method, match_confidence): exact where a key exists, else fuzzy; each unit once.

    The first item in (input_pos, item_pos) order has the unit; a loser doesn't try again. So of the items of a name only the first without a type and
    the first of each type meet the unit's records: no other can win one.
    """
    asked, units = keyed(items, full), keyed(known, full)
    order = F.col("input_pos"), F.col("item_pos")
    place = ["block", "input_pos", "item_pos"]
    every_type = asked.where("sub_key = '' AND unit_type IS NULL")
    of_type = asked.where("sub_key = '' AND unit_type IS NOT NULL")
    with_sub = asked.where("sub_key <> ''")
    matched = (
        with_sub.join(units.select("block", "full_key").distinct().hint("merge"), ["block", "full_key"], "left_semi").select(*place)
        .unionByName(every_type.join(units.select("block", "name_key").distinct().hint("merge"), ["block", "name_key"], "left_semi").select(*place))
        .unionByName(of_type.join(units.select("block", "name_key", "unit_type").distinct().hint("merge"), ["block", "name_key", "unit_type"], "left_semi").select(*place))
    )
    rest = items.join(matched.distinct().hint("merge"), place, "left_anti")
    columns = ["block", "input_pos", "item_pos", "unit_id", "confidence"]
    last = units.groupBy("block", "full_key").agg(F.max_by("unit_id", "pos").alias("unit_id"))
    record = units.select("block", "name_key", "unit_type", "unit_id")

    def firsts(df: DataFrame, on: list[str], owners: DataFrame) -> DataFrame:
        return top_per_key(df.select(*on, "input_pos", "item_pos", "confidence"), on, 1, *order).join(owners.hint("merge"), on).select(*columns)

    exact = firsts(with_sub, ["block", "full_key"], last).unionByName(firsts(every_type, ["block", "name_key"], record.drop("unit_type")))
    exact = exact.unionByName(firsts(of_type, ["block", "name_key", "unit_type"], record)).withColumns({"score": F.lit(100.0), "method": F.lit("exact")})
    every = exact.unionByName(fuzzy_matches(rest, known, full, sql).select(*exact.columns))
    once = top_per_key(every, ["block", "unit_id"], 1, *order)
    return once.withColumn("match_confidence", C.match_confidence(F.col("score"), F.col("confidence"))).drop("confidence")


def covering_prefix(edges: DataFrame, known: DataFrame, entity: str, unit: str, rank: str) -> DataFrame:
    """The smallest document rank up to which all known units of an entity are covered, null if they never are."""
    first = edges.groupBy(entity, unit).agg(F.min(rank).alias("first_rank"))
    joined = known.select(entity, unit).distinct().join(first, [entity, unit], "left")
    return joined.groupBy(entity).agg(
        F.count(F.lit(1)).alias("units"), F.when(F.count("first_rank") == F.count(F.lit(1)), F.max("first_rank")).alias("stop_rank")
    )


def accepted_best(candidates: DataFrame, by: str, score: str, round_no: str, pos: str, least: float = 3, enough: float = 10) -> DataFrame:
    """The best candidate of each group, from the rounds up to the first that reaches ``enough``; none below ``least``."""
    reached = candidates.where(F.col(score) >= enough).groupBy(by).agg(F.min(round_no).alias("_stop"))
    tried = candidates.join(reached, by, "left").where(F.col("_stop").isNull() | (F.col(round_no) <= F.col("_stop"))).drop("_stop")
    return top_per_key(tried.where(F.col(score) >= least), [by], 1, F.desc(score), F.col(round_no), F.col(pos))


def candidate_rank(url: Column, position: Column, domain: Column, suffix: str = ".pdf") -> Column:
    """T5: own documents last-found first, own pages in order, then others in order."""
    own = F.contains(C.host(url), domain)
    document = own & F.contains(F.lower(url), F.lit(suffix))
    return F.struct(F.when(document, 0).when(own, 1).otherwise(2).alias("class"), F.when(document, -position).otherwise(position).alias("place"))


def unmatched(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items that no edge names: they need review."""
    return items.join(edges.select("block", "input_pos", "item_pos").distinct(), ["block", "input_pos", "item_pos"], "left_anti")
