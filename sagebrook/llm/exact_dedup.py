"""Exact deduplication with two passes of a Bloom filter.

Pass one sets two filter positions for every text hash and counts them with a
map-side combine; positions set twice or more form a bit filter. Pass two
probes the filter: a row of which either position was set only once has no
copy and passes straight through; only the others meet by their SHA-256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, packed, stored, text_of

BITS_PER_ROW = 16
#: Positions of one filter, at most; more rows than fit are told apart by hash, with a filter for each part.
MAX_BITS = 1 << 28


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """Positions of the filter: a power of two, at most ``max_bits``."""
    return min(max_bits, 1 << max(10, (rows * bits_per_row - 1).bit_length()))


def filter_parts(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """How many filters of ``max_bits`` it takes: a power of two."""
    return 1 << max(0, (max(1, rows * bits_per_row) - 1).bit_length() - (max_bits.bit_length() - 1))


def _positions(bits: int):
    h = F.col("hash")
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def position_words(digests: DataFrame, bits: int, least: int) -> DataFrame:
    """Words of 64 filter positions that were set ``least`` times or more: at most ``bits / 64`` rows."""
    counts = (
        digests.select(F.explode(F.array(*_positions(bits))).alias("position"))
        .groupBy("position").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )
    return counts.groupBy(F.shiftright("position", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(position & 63 as int))")).alias("bits")
    )


def with_maybe(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe``: both positions of the row's hash are in the filter, of which ``words`` has at most ``bits / 64`` rows."""
    hit = []
    for i, position in enumerate(_positions(bits)):
        own = F.broadcast(words.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}")))
        rows = rows.withColumn(f"position{i}", position)
        rows = rows.join(own, F.shiftright(f"position{i}", 6) == F.col(f"word{i}"), "left")
        hit.append(F.coalesce(F.expr(f"getbit(bits{i}, cast(position{i} & 63 as int)) = 1"), F.lit(False)))
    keep = [c for c in rows.columns if c not in {f"{n}{i}" for n in ("word", "bits", "position") for i in (0, 1)}]
    return rows.select(*keep, (hit[0] & hit[1]).alias("maybe"))


def _marked(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> tuple[DataFrame, int]:
    """(doc_id, hash, text_sha256, maybe) of every row, and their number.

    Where one filter is too small for all rows, the digests are written by the
    highest bits of their hash, and each part is counted and probed with a filter of its own.
    """
    text = text_of(text_col)
    digests = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("text_sha256")),
        "digests",
    )
    rows = digests.count()
    parts = filter_parts(rows, max_bits=max_bits)
    if parts == 1:
        bits = filter_bits(rows, max_bits=max_bits)
        return with_maybe(digests, stored(position_words(digests, bits, 2), "repeated-positions"), bits), rows
    part = F.shiftrightunsigned("hash", 65 - parts.bit_length()).cast("int")
    digests = stored(digests.withColumn("part", part), "digests-by-part", by=["part"])
    found = []
    for k in range(parts):
        own = digests.where(F.col("part") == k).drop("part")
        found.append(stored(with_maybe(own, stored(position_words(own, max_bits, 2), "repeated-positions"), max_bits), "marked"))
    return reduce(DataFrame.unionByName, found), rows


def _decisions(marked: DataFrame, rows: int) -> DataFrame:
    """(doc_id, hash, text_sha256, keep_id, group_size) of the rows that may be repeated."""
    maybe = marked.where("maybe").drop("maybe")
    groups = stored(
        maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    return attach(maybe, groups, "text_sha256", "group_size", rows)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same bytes; of equal texts the largest id
    stays. A null text counts as empty, and all empty texts are equal. A null
    id loses against any other; in a group of null ids all are kept here. Rows
    that repeat both id and text are each marked as their id is
    (``drop_exact_duplicates`` leaves one). An empty table gives an empty
    result. Other columns are ignored.
    """
    marked, rows = _marked(docs, id_col, text_col, max_bits)
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    met = _decisions(marked, rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each text, all columns as they came.

    Decisions as in ``exact_dedup``, over digests; of rows that repeat both id and text any one
    stays, and so does one of a group of null ids. Texts don't shuffle, but for rows that repeat id and text.
    """
    marked, rows = _marked(docs, id_col, text_col, max_bits)
    decided = stored(_decisions(marked, rows).select("doc_id", F.col("hash").alias("text_hash"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "group_size"), "decided")
    once = decided.where(F.col("kept") & (F.col("group_size") > 1)).groupBy("doc_id", "text_hash").count().where("count > 1")
    return without_rows(docs, id_col, text_col, decided.where(~F.col("kept")), once)


_KEYS = ("doc_id", "text_hash")


def _same(keys: DataFrame) -> tuple[DataFrame, Column]:
    """``keys`` under other names, and the null-safe condition that a row has the same."""
    other = keys.select(*[F.col(k).alias(f"other_{k}") for k in _KEYS])
    return other, F.col("doc_id").eqNullSafe(F.col("other_doc_id")) & (F.col("text_hash") == F.col("other_text_hash"))


def _flagged(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``maybe``: whether they may have one of the distinct ``keys``, by a bit filter."""
    bits = filter_bits(keys.count())
    return with_maybe(rows, stored(position_words(keys, bits, 1), name), bits)


def without_rows(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows of ``dropped`` (doc_id, text_hash: xxhash64 of the text, null as empty), all columns as they came.

    Of rows with a key of ``once`` any one stays. A bit filter of the keys tells which rows
    may go. Of those the few that only seem to be dropped are found by their narrow keys, and
    through a second filter they alone move with their texts. Null ids equal each other.
    """
    key = F.xxhash64(*_KEYS)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash")).withColumn("hash", key)
    full = packed(docs, doc_id=F.col(id_col), text_hash=F.xxhash64(text_of(text_col))).withColumn("hash", key)
    single = None
    gone = dropped.select(*_KEYS)
    if once is not None:
        once = stored(once.select(*_KEYS).withColumn("hash", key), "repeated-rows")
        if not once.isEmpty():
            gone = gone.unionByName(once.select(*_KEYS))
            other, same = _same(once)
            single = _flagged(full, once, "repeated-rows-filter").where("maybe").join(other, same, "left_semi").dropDuplicates(list(_KEYS)).select("row.*")
    gone = stored(gone.distinct().withColumn("hash", key), "dropped")
    if gone.isEmpty():
        return docs
    flagged = _flagged(full, gone, "dropped-filter")
    other, same = _same(gone)
    spared = stored(_flagged(narrow, gone, "dropped-filter").where("maybe").drop("maybe").join(other, same, "left_anti").distinct(), "spared")
    out = flagged.where(~F.col("maybe")).select("row.*")
    if not spared.isEmpty():
        other, same = _same(spared)
        again = _flagged(flagged.where("maybe").drop("maybe"), spared, "spared-filter").where("maybe").join(other, same, "left_semi")
        out = out.unionByName(again.select("row.*"))
    return out if single is None else out.unionByName(single)
